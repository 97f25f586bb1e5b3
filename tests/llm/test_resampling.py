"""Importance resampling against a loop that builds every n-gram, on small texts with every defined edge case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, n, buckets=10000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for r in rows for f in features(r[1], n))
    t = Counter(bucket(f) for x in target for f in features(x, n))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for r in rows:
        fs = features(r[1], n)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((r[0], len(fs), weight, score, len(features(r[1], 1)) >= 20))
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    return out, drawn[: 10 * len(drawn) // 100]


@pytest.mark.parametrize("n", [1, 3])
def test_draw_equals_brute_force(spark, docs, rows, n, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK_WORDS", 500)
    target = [rows[0][1], "W1 w2, w3 Ünï\x00w4", None, ""]
    bench = spark.createDataFrame([(i, x, 1) for i, x in enumerate(target)], "item_id long, text string, weight long")
    found = [tuple(r) for r in resampling.importance_resample(docs, bench, n=n).collect()]
    expected, drawn = brute(rows, target, n)
    assert Counter(r[:4] for r in found) == Counter(r[:4] for r in expected)
    ranked = sorted((r for r in found if r[4]), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[:4] for r in ranked] == [r[:4] for r in drawn]


def test_composed_crcs_equal_those_of_strings():
    rng = random.Random(5)
    words = [bytes(rng.randrange(97, 123) for _ in range(rng.choice([1, 7, 300]))) for _ in range(60)]
    crcs = np.array([zlib.crc32(w) for w in words], np.uint32)
    lengths = np.array([len(w) for w in words])
    for k, runs in enumerate(resampling.run_crcs(crcs, lengths, 70)):
        assert runs.tolist() == [zlib.crc32(b" ".join(words[i : i + k + 1])) for i in range(len(words) - k)]


def test_many_equal_rows_get_distinct_ranks(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(7, text)] * 1000 + [(None, text)] * 500, "doc_id long, text string")
    found = resampling.importance_resample(docs, docs.limit(1)).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 151))


def test_empty_tables(spark, docs, empty):
    assert resampling.importance_resample(empty, docs.select("text")).count() == 0
    assert resampling.importance_resample(docs, empty).count() == docs.count()
