"""The classifier, the mixing fit, the top-k search and the pipeline."""

import inspect
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, topk, toxicity


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.25
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "Awful!", "scorn"]))
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), "s", 1, "x"))
        labels.append((i, int(rng.random() < 0.8), int(toxic)))
    rows += [(900, None, None, None, 0, "x"), (901, "", "en", "s", 0, "x"), (None, "vile scorn", "en", "s", 0, "x"), (5, *rows[5][1:])]
    labels += [(None, 1, 1), (7000, None, None), (7001, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_toxicity_held_out_accuracy(marked):
    docs, labels, rows, given = marked
    truth = {i: t for i, _, t in given}
    found = toxicity.toxicity_scores(docs, labels).collect()
    assert len(found) == len(rows)
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and sum(p == t for p, t in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert len({r.score for r in found if r.doc_id == 5}) == 1
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert sum(i in left for i, t in truth.items() if i is not None and i < 900 and t == 0) > 0.97 * sum(t == 0 for t in truth.values())


def test_toxicity_without_labels(marked):
    docs, labels, rows, _ = marked
    found = toxicity.toxicity_scores(docs, labels.limit(0)).collect()
    assert len(found) == len(rows) and len({r.score for r in found}) == 1
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_long_texts_are_scanned_whole():
    net = toxicity.train([np.array([1, 2], np.uint32)] * 30 + [np.array([3, 4], np.uint32)] * 30, np.repeat([0, 1], 30), ["en"] * 60)
    words = np.full(3 * toxicity.PIECE, 1, np.uint32)
    words[2 * toxicity.PIECE : 2 * toxicity.PIECE + 2] = [3, 4]
    plain, hidden = toxicity.scores([np.full(3 * toxicity.PIECE, 1, np.uint32), words], net, net.tables())
    assert hidden > plain


def test_mixing_meets_targets(marked):
    docs, labels, rows, _ = marked
    found = mixing.document_rates(docs, labels, {0: 0.3, 1: 0.7}).collect()
    assert len(found) == len(rows) and all(r.rate >= 0 for r in found)
    total = sum(r.tokens for r in found)
    posterior = np.array([[r.p_0, r.p_1] for r in found])
    tokens = np.array([r.tokens for r in found], float)
    # Brute force: projected gradient in numpy, run far longer.
    rate = np.ones(len(found))
    sums = posterior.T @ tokens
    for _ in range(4000):
        rate = np.maximum(0, rate - posterior @ ((posterior.T @ (rate * tokens) - np.array([0.3, 0.7]) * total) / sums))
    got = posterior.T @ (np.array([r.rate for r in found]) * tokens)
    loss = lambda s: float((((s - np.array([0.3, 0.7]) * total) / sums) ** 2).sum())
    assert loss(got) <= loss(posterior.T @ (rate * tokens)) + 0.01
    many = mixing.mix_documents(docs, labels, {0: 0.3, 1: 0.7}, floor=1.0)
    assert many.columns == docs.columns
    least = Counter(map(tuple, docs.collect()))
    assert not least - Counter(map(tuple, many.collect()))
    assert mixing.document_rates(docs.limit(0), labels, {0: 0.5, 1: 0.5}).count() == 0
    assert mixing.document_rates(docs, labels.limit(0), {0: 0.5, 1: 0.5}).count() == len(rows)


def test_mixing_stops_only_when_converged(spark):
    rng = np.random.default_rng(0)
    tokens = np.floor(np.exp(rng.normal(5, 1.5, 300))) + 1
    p = 1 / (1 + np.exp(rng.normal(-1, 20, 300)))
    p = np.stack([1 - p, p], axis=1)
    own = p.T @ tokens
    goal = np.array([0.1, 0.9]) * max(own.sum(), *(own / [0.1, 0.9]))
    rows = spark.createDataFrame([(int(t), float(a), float(b)) for t, (a, b) in zip(tokens, p, strict=True)], "_tokens long, _p0 double, _p1 double").coalesce(1)
    fit = inspect.signature(mixing.fit_rates).parameters["steps"]
    rate = mixing.fitted_rates(rows, goal.tolist(), 1.0, fit.default, 1e-4)
    rate = np.array([r[0] for r in rows.select(rate).collect()])
    assert rate.min() >= 1
    # Brute force: the projected gradient in numpy has next to nothing left to gain, and a long plain descent ends no lower.
    steepest = np.linalg.eigvalsh((p * tokens[:, None]).T @ p)[-1]
    gap = p.T @ (rate * tokens) - goal
    apart = rate - np.maximum(1, rate - p @ gap / steepest)
    assert np.abs(gap).max() <= 1e-4 * goal.max() or np.sqrt(steepest * (tokens * apart**2).sum()) <= 1.001e-5 * goal.max()
    plain = np.ones(300)
    for _ in range(2000):
        plain = np.maximum(1, plain - p @ (p.T @ (plain * tokens) - goal) / steepest)
    assert np.linalg.norm(gap) <= 1.01 * np.linalg.norm(p.T @ (plain * tokens) - goal)


def test_a_domain_with_one_labelled_row_is_learned(marked, spark):
    docs, labels, rows, _ = marked
    one = labels.where("quality IN (0, 1)").limit(1).select("doc_id").first()[0]
    more = labels.withColumn("quality", F.when(F.col("doc_id") == one, 2).otherwise(F.col("quality")))
    found = mixing.document_rates(docs, more, {0: 0.4, 1: 0.4, 2: 0.1, 3: 0.1}).collect()
    for column in ("p_0", "p_1", "p_2", "p_3"):
        assert len({r[column] for r in found}) > 1, column
    assert all(abs(r.p_0 + r.p_1 + r.p_2 + r.p_3 - 1) < 1e-5 for r in found)


def test_an_unmet_target_warns(marked):
    docs, labels, _, _ = marked
    with pytest.warns(UserWarning, match="mixing"):
        found = mixing.document_rates(docs, labels, {0: 0.9, 1: 0.1}, floor=1.0, ceiling=1.0).collect()
    assert {r.rate for r in found} == {1.0}


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_top_k_is_exact(spark, block_rows):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.3, (700, 12))
    vectors[100:260] = vectors[100]  # a very common vector
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(1000, None, "x"), (1050, [None] + [0.1] * 11, "x"), (1100, [float("nan")] * 12, "x"), (1150, [float("inf")] * 12, "x")]
    rows += [(None, [1.0] * 12, "x"), (1200, [0.5] * 3, "x"), (1250, [], "x"), (7, vectors[7].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    valid = [(i, np.pad(np.floor(256 * np.array(v)).astype(int), (0, 12 - len(v)))) for i, v, _ in rows if i not in (None, 1000, 1050, 1100, 1150)]
    expected = set()
    for q, a in valid:
        if q % 50 == 0:
            best = sorted(((-int(a @ b), i) for i, b in valid if i != q))[:5]
            expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    found = topk.exact_top_k(df, block_rows=block_rows, query_rows=5)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()} == expected
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_top_k_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [0.5])], "vec_id long, embedding array<float>")
    found = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(df).collect()}
    assert found == {(0, 1, 50, 256 * 128), (50, 1, 0, 256 * 128)}


def test_pipeline_keeps_columns_and_drops_what_it_should(spark, tmp_path):
    import corpus_pipeline as p

    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, root)
        path = str(tmp_path / f"{len(sizes)}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2] and sizes[4] >= sizes[3]
    packed = p.STAGES[-1][1](spark, docs, root)
    assert packed.count() == sizes[4]
    assert set(r.doc_id for r in packed.collect()) == set(r.doc_id for r in docs.select("doc_id").collect())
