"""Lexical search against a loop over all pairs of query and document, with every defined edge case."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, rank string, doc_id string"


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k):
    docs = [(r[0], Counter(words(r[1]))) for r in rows if words(r[1])]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for doc_id, c in docs:
            m = 25 + (75 * sum(c.values()) * n) // total
            w = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def items(rows):
    picked = [rows[i][1][:300] for i in (0, 9, 45, 50, 52)] + ["W1 w1, w2", "nowhere", "", None, rows[8][1]]
    return [(i, t) for i, t in enumerate(picked)] + [(0, "w3 w4"), (1, rows[9][1][:300]), (None, "w5 w6")]


@pytest.mark.parametrize("shard_docs, block", [(1 << 15, 256), (7, 3)])
def test_search_equals_brute_force(spark, docs, rows, items, shard_docs, block, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", block)
    asked = spark.createDataFrame([(i, t, "r", "d") for i, t in items], ITEMS)
    found = Counter(tuple(r) for r in lexical.lexical_search(docs, asked, k=6).collect())
    assert found == brute(rows, items, 6)


def test_probing_keeps_ties_and_skips_the_rest():
    """A common term's list is only probed, and documents that tie at the bar stay."""
    rng = np.random.default_rng(4)
    n, tf = 400, rng.integers(1, 5, 400)
    rare = np.sort(rng.choice(n, 40, replace=False))
    row = {
        "ids": np.arange(n).tobytes(),
        "named": np.ones(n, bool).tobytes(),
        "lengths": np.full(n, 20).tobytes(),
        "terms": [b"common", b"rare"],
        "dfs": [n, len(rare)],
        "docs": np.concatenate([np.arange(n), rare]).astype(np.int32).tobytes(),
        "tfs": np.concatenate([tf, np.ones(len(rare))]).astype(np.int32).tobytes(),
    }
    shard = lexical.Shard(row, n, 20 * n)
    rows, scores = lexical.max_score(shard, [(b"common", 1), (b"rare", 5000)], 5, 0)
    whole = np.zeros(n, np.int64)
    for term, weight in ((b"common", 1), (b"rare", 5000)):
        docs, gains, _ = shard.list_of(term)
        whole[docs] += weight * gains
    bar = np.sort(whole)[-5]
    assert set(np.flatnonzero(whole >= bar)) <= set(rows) <= set(rare)
    assert (whole[rows] == scores).all()


def test_hundreds_of_equal_documents(spark):
    rows = [(i % 300, "same words here") for i in range(1000)] + [(5000 + i, "other text") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lexical.lexical_search(docs, spark.createDataFrame([(1, "here same")], "item_id long, text string")).collect()
    assert sorted((r["rank"], r.doc_id) for r in found) == list(enumerate([0, 0, 0, 0, 1, 1, 1, 1, 2, 2], 1))


def test_empty_tables(spark, docs, empty):
    one = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.lexical_search(empty, one).count() == 0
    assert lexical.lexical_search(docs, one.where("item_id > 1")).count() == 0
