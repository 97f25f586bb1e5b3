"""Every stage of the pipeline against brute force on its own input, over rows with every defined edge case."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import mixing, simhash, toxicity

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in BLANK.split(text or "") if w]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """Documents with nulls, repeats, empty and long texts and clashing columns; labels that mark some words toxic."""
    root = tmp_path_factory.mktemp("tables")
    more = [(1000 + i, f"vile scorn number {i} awful words {i * 7} and nothing else {i % 5}", "de", "s", 1, "r", 2, "m") for i in range(40)]
    near = " ".join(f"n{i}" for i in range(400))
    more += [(2000, near, "en", "s", 1, "r", 1, "m"), (2001, near.replace(" n7 ", "\n") + " tail of another kind", "en", "s", 1, "r", 1, "m")]
    every = [*rows, *more]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, mark string"
    spark.createDataFrame(every, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(r[0], int((r[0] or 0) % 3 > 0), int("vile" in (r[1] or ""))) for r in every] + [(None, None, 1), (9999, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{out}/{name}")
        after = spark.read.parquet(f"{out}/{name}")
        found.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in found}


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_columns_stay(steps):
    for name, (before, after) in steps.items():
        assert name == "packing" or after.columns == before.columns


def test_toxicity(spark, steps, folder):
    before, after = steps["toxicity"]
    net = toxicity.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = before.collect()
    given = toxicity.scores([toxicity.hashed(r.text) for r in rows], net, net.tables())
    limits = [net.thresholds.get(r.lang, net.threshold) for r in rows]
    assert counted(after) == Counter(tuple(r) for r, s, t in zip(rows, given, limits, strict=True) if s < t)
    assert not after.where("text LIKE '%vile%'").count() and after.count() >= 60


def test_lines(steps):
    before, after = steps["line_dedup"]
    order = sorted({(r.doc_id, r.text) for r in before.collect() if r.text is not None}, key=lambda x: (x[0] is None, x[0] or 0))
    ids = Counter(i for i, _ in order)
    earlier, kept = [], {}
    for i, text in order:
        lines = []
        for x in text.split("\n"):
            s = set(split(x))
            if not (s and any(5 * len(s & e) >= 4 * len(s | e) for e in earlier)):
                lines.append(x)
            if s:
                earlier.append(s)
        kept[i, text] = "\n".join(lines)
    # Rows that share a doc_id but not a text have an order of their own; they are checked by the operator's test.
    plain = [r for r in before.collect() if r.text is None or ids[r.doc_id] == 1]
    expected = Counter()
    for r in plain:
        text = None if r.text is None else kept[r.doc_id, r.text]
        if split(text) or not split(r.text):
            expected[r.doc_id, text, len(text or "")] += 1
    found = Counter((r.doc_id, r.text, r.n_chars) for r in after.collect() if r.text is None or ids[r.doc_id] == 1)
    assert found == expected


def test_near_duplicates(steps):
    before, after = steps["simhash"]
    rows = before.collect()
    prints = [simhash.fingerprint(r.text, 5) & (2**64 - 1) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 7:
                group = [group[b] if g == group[a] else g for g in group]
    found = after.collect()
    assert len(found) == len(set(group))
    where = {(r.doc_id, r.text): g for r, g in zip(rows, group, strict=True)}
    assert len({where[r.doc_id, r.text] for r in found}) == len(found)


def test_mixing(steps, spark, folder):
    before, after = steps["mixing"]
    least, many = counted(before), counted(after)
    assert set(least) == set(many)
    assert all(least[r] <= many[r] <= corpus_pipeline.CEILING * least[r] for r in least)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rates = mixing.document_rates(before, labels, corpus_pipeline.WEIGHTS, floor=1.0, ceiling=2.0).collect()
    # Brute force: a long projected gradient between the bounds leaves no smaller gap.
    tokens, p = np.array([r.tokens for r in rates], float), np.array([[r.p_0, r.p_1] for r in rates])
    own = p.T @ tokens
    goal = np.array([0.1, 0.9]) * max(own.sum(), *(own / [0.1, 0.9]))
    steepest = np.linalg.eigvalsh((p * tokens[:, None]).T @ p)[-1]
    plain = np.ones(len(rates))
    for _ in range(3000):
        plain = np.clip(plain - p @ (p.T @ (plain * tokens) - goal) / steepest, 1, 2)
    gap = lambda r: np.linalg.norm(p.T @ (r * tokens) - goal)
    assert gap(np.array([r.rate for r in rates])) <= 1.01 * gap(plain) + 1e-3 * goal.max()


def test_packing(steps):
    before, after = steps["packing"]
    assert Counter((r.doc_id, r.n_tokens) for r in after.collect()) == Counter((r.doc_id, len(split(r.text))) for r in before.collect())


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
