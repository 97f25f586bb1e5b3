"""Importance resampling towards a target corpus, on hashed n-grams.

Features are all runs of 1 to n consecutive words of a text; a feature's bucket is the CRC-32 of the run (words joined by
one space) modulo the number of buckets. No run is ever built: each word's CRC is taken once, and the CRC of a longer run
follows from its parts, as crc(A + B) = shift(crc(A), len(B)) xor crc(B), where shifting by a length is a linear map over
GF(2). The maps for 1, 2, 4, ... bytes are 32 x 32 bit matrices, kept as four lookup tables of 256 columns' sums each.

Spark counts the buckets of the raw and of the target texts (each task sends one row a bucket), the driver turns the two
fixed-size histograms into one gain a bucket, a second pass sums gains by document, and Gumbel noise from a hash of the
document's id makes the highest scores a draw without replacement in proportion to the importance weights.

Defined results: null, empty and blank texts have no features, weight 0 and are never drawn; a null doc_id is hashed as an
empty string and comes last among ties; repeated rows are scored and may be drawn each, rows that are equal in every
figure are interchangeable; extra columns are ignored; an empty table gives an empty result, and empty target or raw texts
count as no features.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import numbered, saved
from quarry.llm.terms import LOWER_SQL, TERM, terms

#: Words whose runs are composed at a time, and distinct words whose CRC a task remembers.
CHUNK_WORDS, KNOWN_WORDS = 1 << 18, 1 << 19


@functools.cache
def shift_tables() -> np.ndarray:
    """uint32[k, j, b]: what byte j of a CRC, at value b, adds to the CRC shifted by 2**k bytes."""
    one_byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    columns = np.array([(1 << i >> 8) ^ int(one_byte[1 << i & 255]) for i in range(32)], np.uint32)
    out = np.zeros((32, 4, 256), np.uint32)
    for k in range(32):
        for i in range(32):
            with_bit = np.arange(256) >> (i % 8) & 1 == 1
            out[k, i // 8, with_bit] ^= columns[i]
        columns = _mapped(out[k], columns)
    return out


def _mapped(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    byte = lambda j: crcs >> np.uint32(8 * j) & np.uint32(255)
    return tables[0][byte(0)] ^ tables[1][byte(1)] ^ tables[2][byte(2)] ^ tables[3][byte(3)]


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved past as many bytes as `lengths` says: one matrix for each bit of a length."""
    out = crcs.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        odd = (lengths >> k & 1).astype(bool)
        out[odd] = _mapped(shift_tables()[k], out[odd])
    return out


def run_crcs(crcs: np.ndarray, lengths: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For 1 to n: the CRCs of all runs of so many consecutive words, joined by spaces, from the CRCs of words."""
    spaced = shifted(np.full(len(crcs), zlib.crc32(b" "), np.uint32), lengths) ^ crcs if n > 1 else crcs
    runs = crcs
    yield runs
    for k in range(1, n):
        if k >= len(crcs):
            return
        runs = shifted(runs[:-1], lengths[k:] + 1) ^ spaced[k:]
        yield runs


class _Crcs(dict):
    """CRC-32 by word, each taken once while the word is remembered."""

    def __missing__(self, word: bytes) -> int:
        crc = zlib.crc32(word)
        if len(self) < KNOWN_WORDS:
            self[word] = crc
        return crc


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[list[bytes]]]]:
    """The rows without their text, and their words, by chunks of some CHUNK_WORDS words."""
    for batch in batches:
        rest, texts = batch.drop_columns("text"), batch.column("text")
        first, held, size = 0, [], 0
        for i in range(batch.num_rows):
            held.append(terms(texts[i].as_py()))
            size += len(held[-1])
            if size >= CHUNK_WORDS or i + 1 == batch.num_rows:
                yield rest.slice(first, len(held)), held
                first, held, size = i + 1, [], 0


def _buckets(held: list[list[bytes]], known: _Crcs, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length the place of every run's first word in the chunk, and the run's bucket."""
    counts = np.fromiter(map(len, held), np.int64, len(held))
    total = int(counts.sum())
    crcs = np.fromiter((known[w] for words in held for w in words), np.uint32, total)
    lengths = np.fromiter((len(w) for words in held for w in words), np.int64, total) if n > 1 else np.zeros(total, np.int64)
    ends = np.repeat(np.cumsum(counts), counts)
    for k, runs in enumerate(run_crcs(crcs, lengths, n)):
        inside = np.flatnonzero(np.arange(len(runs)) + k < ends[: len(runs)])
        yield inside, runs[inside] % np.uint32(buckets)


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = 10000) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = _Crcs(), np.zeros(buckets, np.int64)
        for _, held in _chunks(batches):
            for _, found in _buckets(held, known, n, buckets):
                sums += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log-ratio of target to raw frequency of each bucket, rounded down."""
    size = len(raw)
    all_raw, all_target = int(raw.sum()) + size, int(target.sum()) + size
    ratios = [(t + 1) * all_raw / ((s + 1) * all_target) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def importance_weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10000) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of every row of `docs`."""
    gains = bucket_gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    names = ["doc_id", "n_words", "n_features", "weight"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Crcs()
        for rest, held in _chunks(batches):
            counts = np.fromiter(map(len, held), np.int64, len(held))
            ends = np.cumsum(counts)
            by_word = np.zeros(int(counts.sum()), np.int64)
            features = np.zeros(len(held), np.int64)
            for k, (places, found) in enumerate(_buckets(held, known, n, buckets)):
                by_word[places] += gains[found]
                features += np.maximum(counts - k, 0)
            sums = np.concatenate([[0], np.cumsum(by_word)])
            columns = [pa.array(x) for x in (counts, features, sums[ends] - sums[ends - counts])]
            yield pa.RecordBatch.from_arrays([rest.column("doc_id"), *columns], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(weigh, ", ".join(f"{c} long" for c in names))


def gumbel(key: Column) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of a key's SHA-256, rounded down."""
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = 1,
    buckets: int = 10000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, and rank in the draw of `percent` of the long enough ones."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    scored = importance_weights(docs, target, n, buckets).withColumn("score", F.col("weight") + gumbel(key))
    scored = saved(scored, "resampling-scores")
    drawn = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    # The salt only spreads rows that are equal in all figures over the sorted partitions.
    ordered = scored.select(
        "*",
        (F.col("n_words") < least_words).alias("short"),
        (-F.col("score")).alias("falling"),
        F.col("doc_id").isNull().alias("none"),
        F.monotonically_increasing_id().alias("salt"),
    )
    placed, _ = numbered(ordered, ["short", "falling", "none", "doc_id", "n_features", "weight", "salt"], "resampling-ranks")
    rank = F.when(F.col("row_no") < drawn, F.col("row_no") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


RESAMPLE_SQL = rf"""
WITH RECURSIVE steps(b, c, i) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE i = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER_SQL}, '{TERM}') AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all({LOWER_SQL}, '{TERM}')) AS w FROM benchmark),
v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
bytes AS (SELECT w, hex(encode(w)) AS h FROM v),
crcs AS (
  SELECT w, xor(4294967295, list_reduce(
    list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket FROM bytes, crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crcs USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crcs USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(
    (coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
x AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN crcs USING (w) JOIN g USING (bucket) GROUP BY r),
y AS (
  SELECT doc_id, coalesce(len(ws), 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN x USING (r)),
o AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id NULLS LAST, n_features, weight) AS k FROM y)
SELECT doc_id, n_features, weight, score,
  CASE WHEN k <= 10 * (SELECT count(*) FROM y WHERE n_features >= 20) // 100 THEN k END AS rank FROM o"""
