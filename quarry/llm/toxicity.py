"""Toxicity by a convolutional text classifier, trained in numpy.

Words are lower-cased, cut at white space and ASCII punctuation, and hashed into two small embedding tables whose
rows are added. Filters of several widths slide over the embeddings, the largest response of each filter over the
whole text goes through a leaky rectifier, and a logistic layer gives the score. Two channels of the embeddings hold a
bucket's smoothed log-odds on the labelled sample; for training they are cross-fitted (each half of the sample sees
the other half's), the other channels, the filters and the output layer are learned with Adagrad. Thresholds are
calibrated for each language on labelled rows that the training did not see.

At scoring time each filter is folded into the tables, so a text costs a few table look-ups a word, and long texts
are scanned whole in pieces that overlap by the widest filter.

The classifier is fitted on at most `max_rows` labelled rows (a bounded sample, drawn by a hash of doc_id, of at most
`max_words` words; rows beyond that are left out whole); it scores every row of the table. Labels, language, source and doc_id never enter a score.

Defined results: null, empty and blank texts get the score of a text without words; null labels and labelled rows
without a document are not learned from; repeated rows get equal scores; with labels of one kind only, or none,
every score is the smoothed share of toxic labels; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
DIMS, FILTERS, PIECE = 8, 8, 1 << 15
#: Slope of the rectifier below zero.
LEAK = 0.1
#: ASCII punctuation becomes a blank, A-Z become lower case.
FOLDED = bytes(
    32 if chr(c).isascii() and not chr(c).isalnum() and c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def hashed(text: str | None) -> np.ndarray:
    """The words of a whole text as 32-bit hashes; each half names a bucket of one table."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(FOLDED).split()
    return np.fromiter(map(xxhash.xxh32_intdigest, parts), np.uint32, len(parts))


@dataclass
class Network:
    """Embeddings of both tables, filters by width (width, DIMS, FILTERS), biases and the output layer."""

    first: np.ndarray
    second: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3
    constant: float | None = None

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each offset the responses of all filters at least that wide, by bucket, for both tables."""
        found = []
        for j in range(max(WIDTHS)):
            weights = np.concatenate([self.filters[w][j] for w in WIDTHS if w > j], axis=1)
            found.append(((self.first @ weights).astype(np.float32), (self.second @ weights).astype(np.float32)))
        return found


def pooled(docs: list[np.ndarray], tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The largest response of every filter over every text; windows may run past the end, over blanks."""
    halo = max(WIDTHS) - 1
    columns = FILTERS * len(WIDTHS)
    out = np.zeros((len(docs), columns), np.float32)
    pieces = [(i, a) for i, d in enumerate(docs) for a in range(0, len(d), PIECE)]
    seen = np.zeros(len(docs), bool)
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (size == 0 or size < 4 * PIECE):
            size += min(PIECE, len(docs[pieces[end][0]]) - pieces[end][1]) + halo
            end += 1
        words, blank, starts = np.zeros(size, np.uint32), np.ones(size, bool), []
        place = 0
        for i, a in pieces[at:end]:
            part, rest = docs[i][a : a + PIECE + halo], min(PIECE, len(docs[i]) - a) + halo
            words[place : place + len(part)], blank[place : place + len(part)] = part, False
            starts.append((place, place + rest - halo))
            place += rest
        low, high = words & 0xFFFF, words >> 16
        response = np.zeros((size, columns), np.float32)
        for j, (one, two) in enumerate(tables):
            got = one[low[j:]] + two[high[j:]]
            got[blank[j:]] = 0
            response[: size - j, columns - got.shape[1] :] += got
        edges = np.array(starts).ravel()
        best = np.maximum.reduceat(np.concatenate([response, response[-1:]]), edges, axis=0)[::2]
        for (i, _), row in zip(pieces[at:end], best, strict=True):
            out[i] = np.maximum(out[i], row) if seen[i] else row
            seen[i] = True
        at = end
    return out


def scores(docs: list[np.ndarray], net: Network, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    if net.constant is not None:
        return np.full(len(docs), net.constant)
    hidden = pooled(docs, tables).astype(np.float64) + net.bias
    hidden = np.maximum(hidden, LEAK * hidden)
    return 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.shift, -30, 30)))


def log_odds(docs: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much a bucket's presence moves the log-odds of toxic, for both tables; rare buckets shrink to nothing."""
    found, counts_of = [], np.bincount(labels, minlength=2)
    for take in (lambda d: d & 0xFFFF, lambda d: d >> 16):
        counts = np.zeros((2, BUCKETS))
        for d, y in zip(docs, labels, strict=True):
            counts[y, np.unique(take(d))] += 1
        share = (counts_of[1] + 0.5) / (len(labels) + 1)
        here = (counts[1] + 4 * share) / (counts.sum(axis=0) + 4)
        odds = np.log(here / (1 - here)) - math.log(share / (1 - share))
        found.append(np.clip(odds, -4, 8) / 2)
    return found[0], found[1]


def train(docs: list[np.ndarray], labels: np.ndarray, langs: list[str], passes: int = 30000, seed: int = 5) -> Network:
    """Fit the network on hashed texts, in 3 to 20 epochs of about `passes` texts in all.

    Every fifth row only calibrates the thresholds.
    """
    rng = np.random.default_rng(seed)
    held = np.arange(len(docs)) % 5 == 4
    fit = np.flatnonzero(~held)
    share = (labels[fit].sum() + 0.5) / (len(fit) + 1)
    shape = (BUCKETS, DIMS)
    net = Network(
        rng.normal(0, 0.02, shape).astype(np.float32), rng.normal(0, 0.02, shape).astype(np.float32),
        {w: rng.normal(0, 0.1, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.full(FILTERS * len(WIDTHS), -1.0), np.full(FILTERS * len(WIDTHS), 0.1), math.log(share / (1 - share)),
    )
    if len(np.unique(labels[fit])) < 2:
        net.constant = float(share)
        return net
    for w in WIDTHS:
        net.filters[w][0, :2] = 1
    halves = [fit[::2], fit[1::2]]
    odds = [log_odds([docs[i] for i in half], labels[half]) for half in halves]
    memory = {k: np.full(v.shape, 1e-6) for k, v in (("first", net.first), ("second", net.second), ("bias", net.bias), ("out", net.out))}
    memory |= {w: np.full(f.shape, 1e-6) for w, f in net.filters.items()}
    shift_memory = 1e-6
    rate = 0.05
    for _ in range(min(20, max(3, passes // len(fit)))):
        for half, other in ((0, 1), (1, 0)):
            net.first[:, 0], net.second[:, 1] = odds[other]
            net.first[:, 1] = net.second[:, 0] = 0
            order = rng.permutation(halves[half])
            for b in range(0, len(order), 64):
                batch = order[b : b + 64]
                step = _gradients(net, [docs[i] for i in batch], labels[batch])
                for name in ("bias", "out"):
                    memory[name] += step[name] ** 2
                    getattr(net, name)[:] -= rate * step[name] / np.sqrt(memory[name])
                shift_memory += step["shift"] ** 2
                net.shift -= rate * step["shift"] / math.sqrt(shift_memory)
                for w in WIDTHS:
                    memory[w] += step[w] ** 2
                    net.filters[w] -= rate * step[w] / np.sqrt(memory[w])
                for name in ("first", "second"):
                    rows, grads = step[name]
                    grads[:, :2] = 0  # the log-odds stay as they are
                    memory[name][rows] += grads**2
                    getattr(net, name)[rows] -= rate * grads / np.sqrt(memory[name][rows])
    net.first[:, 0], net.second[:, 1] = log_odds([docs[i] for i in fit], labels[fit])
    _calibrate(net, [docs[i] for i in np.flatnonzero(held)], labels[held], [langs[i] for i in np.flatnonzero(held)])
    return net


def _gradients(net: Network, docs: list[np.ndarray], labels: np.ndarray) -> dict:
    """Gradients of the mean logistic loss of a batch; only the windows that win the pooling carry any."""
    halo, n = max(WIDTHS) - 1, len(docs)
    sizes = [max(1, len(d)) for d in docs]
    starts = np.concatenate([[0], np.cumsum([s + halo for s in sizes])])
    words, real = np.zeros(starts[-1], np.uint32), np.zeros(starts[-1], bool)
    for d, s in zip(docs, starts, strict=False):
        words[s : s + len(d)], real[s : s + len(d)] = d, True
    low, high = words & 0xFFFF, words >> 16
    x = np.ascontiguousarray(((net.first[low] + net.second[high]) * real[:, None]).T)
    columns = FILTERS * len(WIDTHS)
    hidden, where = np.zeros((n, columns)), np.zeros((n, columns), np.int64)
    for k, w in enumerate(WIDTHS):
        last = x.shape[1] - w + 1
        response = sum(net.filters[w][j].T @ x[:, j : j + last] for j in range(w))
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        for i in range(n):
            part = response[:, starts[i] : starts[i] + sizes[i]]
            best = part.argmax(axis=1)
            where[i, cols], hidden[i, cols] = best + starts[i], part[np.arange(FILTERS), best]
    hidden = hidden + net.bias
    active = np.where(hidden > 0, 1, LEAK)
    hidden = hidden * active
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.shift, -30, 30)))
    error = (p - labels) / n
    step: dict = {"out": hidden.T @ error + 1e-4 * net.out, "shift": float(error.sum())}
    back = error[:, None] * net.out * active
    step["bias"] = back.sum(axis=0)
    rows, grads = [], []
    for k, w in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        g = back[:, cols]
        step[w] = np.zeros_like(net.filters[w])
        for j in range(w):
            at = where[:, cols] + j
            step[w][j] = np.einsum("bf,dbf->df", g, x[:, at]) + 1e-4 * net.filters[w][j]
            push = g[:, :, None] * net.filters[w][j].T[None] * real[at][:, :, None]
            rows.append(at.ravel())
            grads.append(push.reshape(-1, DIMS))
    at, grad = np.concatenate(rows), np.concatenate(grads)
    for name, buckets in (("first", low[at]), ("second", high[at])):
        unique, inverse = np.unique(buckets, return_inverse=True)
        total = np.zeros((len(unique), DIMS))
        np.add.at(total, inverse, grad)
        step[name] = unique, total
    return step


def _calibrate(net: Network, docs: list[np.ndarray], labels: np.ndarray, langs: list[str], least: int = 10) -> None:
    """Thresholds with the best F1 for each language with at least `least` toxic rows, and for all rows together."""
    given = scores(docs, net, net.tables()) if docs else np.zeros(0)

    def best(mine: np.ndarray, default: float) -> float:
        if labels[mine].sum() < least:
            return default
        grid = np.linspace(0.2, 0.8, 13)
        f1 = [2 * (labels[mine] & (given[mine] >= t)).sum() / max(1, labels[mine].sum() + (given[mine] >= t).sum()) for t in grid]
        top = np.flatnonzero(np.isclose(f1, max(f1)))
        return float(grid[top[len(top) // 2]])

    everyone = np.ones(len(docs), bool)
    net.threshold = best(everyone, 0.3)
    for lang in sorted({x for x in langs if x is not None}):
        net.thresholds[lang] = best(np.array([x == lang for x in langs]), net.threshold)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, max_words: int = 20_000_000) -> Network:
    """Train on at most `max_rows` labelled rows outside the held-out fold, and `max_words` words of them in all.

    A labelled doc_id gives one row (the text with the least hash). The sample is hashed where it lies and trained on
    in one task, so only the finished network (some 4 MB) reaches the driver.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    drawn = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").join(drawn, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("text")).alias("one")).select("doc_id", "toxic", "one.*")

    def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [hashed(t.as_py()).tobytes() for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("lang"), batch.column("toxic"), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "toxic", "words"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, toxic, left = [], [], [], max_words
        for batch in batches:
            for words, lang, label in zip(*(batch.column(c).to_pylist() for c in ("words", "lang", "toxic")), strict=True):
                left -= len(words) // 4
                if left >= 0:
                    texts.append(np.frombuffer(words, np.uint32))
                    langs.append(lang)
                    toxic.append(label)
        net = train(texts, np.array(toxic, np.int64), langs)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    sample = rows.mapInArrow(hash_words, "doc_id long, lang string, toxic int, words binary")
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = sample.mapInArrow(learn, "net binary").collect()
    return pickle.loads(found[0].net) if found else train([], np.zeros(0, np.int64), [])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, text_key, lang and score for every row of (doc_id, lang, text); text_key is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        folded = model.tables()
        for batch in batches:
            given = scores([hashed(t.as_py()) for t in batch.column("text")], model, folded)
            columns = [*(batch.column(c) for c in ("doc_id", "text_key", "lang")), pa.array(given, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "lang", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, lang string, score double")


def language_threshold(net: Network, lang: Column) -> Column:
    out = F.lit(net.threshold)
    for name, value in sorted(net.thresholds.items()):
        out = F.when(lang == name, value).otherwise(out)
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= cut), rejected (score >= the language's threshold)."""
    net = fit(docs, labels, max_rows)
    return score(docs, net).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
        (F.col("score") >= language_threshold(net, F.col("lang"))).alias("rejected"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 12000) -> DataFrame:
    """The rows of `docs` whose score stays below the threshold of their language; columns and rows are unchanged."""
    net = fit(docs, labels, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    thresholds, default = dict(net.thresholds), net.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        folded = model.tables()
        for batch in batches:
            given = scores([hashed(t.as_py()) for t in batch.column("text")], model, folded)
            limits = np.array([thresholds.get(x, default) for x in batch.column("lang").to_pylist()], np.float64)
            yield batch.filter(pa.array(given < limits))

    return docs.mapInArrow(run, docs.schema)
