"""Ranked lexical search by MaxScore, shard by shard.

One pass over the documents turns them into shards: the postings of each term in some thousands of documents, with the
documents' lengths. A shard never leaves the row it is written in. Terms that no query holds are left out by a bitmap of
fixed size over term hashes; terms that slip through it meet no query.

Queries come in blocks of bounded size. For each of its terms a shard knows the largest contribution, the term's upper
bound. A query's lists are taken by falling bound. While all lists still to come could together lift an unseen document
to the bar (the score of the k-th best document so far, of this shard or of those that the task read before), lists are
essential: their postings are added up. Then no unseen document can qualify, and the other lists are only probed for the
documents whose sum and remaining bounds still reach the bar, which rises and thins them out from list to list. All scores
are integers, so bounds are exact and ties are kept. A task sends on its k best documents of each query, and these are
ranked by Spark.

Defined results: null, empty and wordless texts count neither as documents nor as answers; a query without words or
without matches has no rows; every row is a document, so repeated rows answer each, with equal scores in the order of
doc_id; a null doc_id comes last among ties and is returned as null; equal rows of one item_id are one query, different
texts under one item_id are queries of their own; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import numbered, saved
from quarry.llm.terms import LOWER_SQL, TERM, terms

#: Bits of the filter on term hashes.
FILTER_BITS = 1 << 20
#: A shard ends at so many bytes of text (a longer document is a shard of its own) or documents.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 15
#: Queries of a block.
BLOCK_QUERIES = 256

_SHARD = {
    "shard": pa.int64(),
    "n_docs": pa.int64(),
    "n_terms": pa.int64(),
    "ids": pa.binary(),
    "named": pa.binary(),
    "lengths": pa.binary(),
    "terms": pa.list_(pa.binary()),
    "dfs": pa.list_(pa.int64()),
    "docs": pa.binary(),
    "tfs": pa.binary(),
}
_SHARD_SQL = (
    "shard long, n_docs long, n_terms long, ids binary, named binary, lengths binary, "
    "terms array<binary>, dfs array<long>, docs binary, tfs binary"
)


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, item_key, term, qtf of every distinct (item_id, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms(t.as_py())) for t in batch.column("text")]
            rows = np.repeat(np.arange(len(found)), [len(c) for c in found])
            keys = batch.select(["item_id", "item_key"]).take(pa.array(rows))
            words = pa.array([w for c in found for w in c], pa.binary())
            counts = pa.array([n for c in found for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([*keys.columns, words, counts], ["item_id", "item_key", "term", "qtf"])

    texts = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    keyed = texts.select("item_id", F.sha2("text", 256).alias("item_key"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    return keyed.mapInArrow(split, f"item_id {kind}, item_key string, term binary, qtf long")


def term_filter(asked: DataFrame) -> np.ndarray:
    """A bitmap over CRC-32 modulo FILTER_BITS of the terms that queries hold: at most FILTER_BITS numbers are collected."""
    bits = np.zeros(FILTER_BITS, bool)
    bits[asked.select(F.pmod(F.crc32("term"), F.lit(FILTER_BITS)).alias("b")).distinct().toArrow()["b"].to_numpy()] = True
    return bits


class _Numbers(dict):
    """Numbers of the terms of a shard; -1 for those that the filter rules out."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits, self.known = bits, []

    def __missing__(self, term: bytes) -> int:
        self[term] = -1
        if self.bits[zlib.crc32(term) % len(self.bits)]:
            self[term] = len(self.known)
            self.known.append(term)
        return self[term]


def shards(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The index: one row a shard, with postings sorted by term, then document."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, lengths, spread, nums, tfs = [], array("q"), array("q"), array("q"), array("q")
        numbers, size = _Numbers(bits), 0

        def shard() -> pa.RecordBatch:
            number, tf = np.array(nums, np.int64), np.array(tfs, np.int64)
            doc = np.repeat(np.arange(len(ids)), np.array(spread, np.int64))
            order = np.argsort(number, kind="stable")
            order = order[np.searchsorted(number[order], 0) :]
            row = {
                "shard": part << 32 | made,
                "n_docs": len(ids),
                "n_terms": sum(lengths),
                "ids": np.array([i or 0 for i in ids], np.int64).tobytes(),
                "named": np.array([i is not None for i in ids], bool).tobytes(),
                "lengths": np.array(lengths, np.int64).tobytes(),
                "terms": numbers.known,
                "dfs": np.bincount(number[order], minlength=len(numbers.known)).tolist(),
                "docs": doc[order].astype(np.int32).tobytes(),
                "tfs": tf[order].astype(np.int32).tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], pa.schema(list(_SHARD.items())))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py()
                words = terms(text)
                if not words:
                    continue
                if ids and (size + len(text) > SHARD_BYTES or len(ids) == SHARD_DOCS):
                    yield shard()
                    ids, lengths, spread, nums, tfs = [], array("q"), array("q"), array("q"), array("q")
                    numbers, size, made = _Numbers(bits), 0, made + 1
                found = Counter(words)
                ids.append(doc_id.as_py())
                lengths.append(len(words))
                spread.append(len(found))
                nums.extend(map(numbers.__getitem__, found))
                tfs.extend(found.values())
                size += len(text)
        if ids:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(build, _SHARD_SQL)


class Shard:
    """A shard's postings, read as a query asks for them."""

    def __init__(self, row: dict, n: int, total: int):
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.named, self.docs, self.tfs = read("ids", np.int64), read("named", bool), read("docs", np.int32), read("tfs", np.int32)
        self.place = {t: i for i, t in enumerate(row["terms"])}
        self.starts = np.concatenate([[0], np.cumsum(np.array(row["dfs"], np.int64))])
        self.norms = 8 * (25 + 75 * read("lengths", np.int64) * n // total)
        self.read: dict[int, tuple] = {}

    def list_of(self, term: bytes) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Documents (rising), what one occurrence of the term in a query adds to each before its weight, and the largest."""
        i = self.place.get(term)
        if i is None:
            return None
        if i not in self.read:
            span = slice(self.starts[i], self.starts[i + 1])
            docs, tf = self.docs[span], self.tfs[span].astype(np.int64)
            gains = 1000000000 * tf // (1000 * tf + self.norms[docs])
            self.read[i] = docs, gains, int(gains.max(initial=0))
        return self.read[i]


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value; 0 where there are fewer."""
    return int(np.partition(values, -k)[-k]) if len(values) >= k else 0


def max_score(shard: Shard, query: list[tuple[bytes, int]], k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that may be among the k best of a query given as (term, weight), with their scores.

    `bar` is a score that k documents elsewhere reach already, or 0. Documents scoring below the bar may be missing.
    """
    lists = [(w * found[2], w, found[0], found[1]) for t, w in query if (found := shard.list_of(t))]
    lists.sort(key=lambda x: -x[0])
    left = sum(x[0] for x in lists)
    sums, at = np.zeros(len(shard.ids), np.int64), 0
    while at < len(lists) and left >= bar:  # essential lists
        bound, weight, docs, gains = lists[at]
        sums[docs] += weight * gains
        left, at = left - bound, at + 1
        bar = max(bar, kth(sums, k))
    rows = np.flatnonzero((sums > 0) & (sums + left >= bar))
    scores = sums[rows]
    for bound, weight, docs, gains in lists[at:]:  # the others are probed
        if not len(rows):
            break
        place = np.minimum(np.searchsorted(docs, rows), len(docs) - 1)
        scores = scores + np.where(docs[place] == rows, weight * gains[place], 0)
        left -= bound
        bar = max(bar, kth(scores, k))
        stay = scores + left >= bar
        rows, scores = rows[stay], scores[stay]
    return rows, scores


def _best(index: DataFrame, block: list, n: int, total: int, k: int) -> DataFrame:
    """The k best documents of every query of a block, by task."""
    queries: dict[int, list[tuple[bytes, int]]] = {}
    for r in block:
        queries.setdefault(r.item_no, []).append((bytes(r.term), r.weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q: (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for q in queries}
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[row].as_py() for c in batch.schema.names}, n, total)
                for q, query in queries.items():
                    held = best[q]
                    rows, scores = max_score(shard, query, k, kth(held[2], k))
                    ids, named = np.append(held[0], shard.ids[rows]), np.append(held[1], shard.named[rows])
                    scores = np.append(held[2], scores)
                    keep = np.lexsort((ids, ~named, -scores))[:k]
                    best[q] = ids[keep], named[keep], scores[keep]
        items = np.repeat(np.array(list(best), np.int64), [len(v[0]) for v in best.values()])
        ids, named, scores = (np.concatenate([v[i] for v in best.values()] or [[]]) for i in range(3))
        names = ["item_no", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(items), pa.array(ids.astype(np.int64), mask=~named.astype(bool)), pa.array(scores.astype(np.int64))], names
        )

    columns = index.select("ids", "named", "lengths", "terms", "dfs", "docs", "tfs")
    return columns.mapInArrow(search, "item_no long, doc_id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents with a score above 0 for every row of `items`."""
    asked = saved(query_terms(items), "lexical-asked")
    index = saved(shards(docs, term_filter(asked)), "lexical-shards")
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    lists = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("l")).select(F.col("l.terms").alias("term"), "l.dfs")
    dfs = lists.groupBy("term").agg(F.sum("dfs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(dfs, "term").select("item_key", "item_id", "term", (F.col("qtf") * weight).alias("weight"))
    keys, n_items = numbered(asked.select("item_id", "item_key").distinct(), ["item_id", "item_key"], "lexical-items", "item_no")
    keys = saved(keys, "lexical-numbers")
    same = (F.col("a.item_key") == F.col("b.item_key")) & F.col("a.item_id").eqNullSafe(F.col("b.item_id"))
    queries = weighted.where("weight > 0").alias("a").join(keys.alias("b"), same).select("item_no", "term", "weight")
    block = F.floor(F.col("item_no") / BLOCK_QUERIES).cast("int")
    queries = saved(queries.withColumn("block", block).repartition("block").sortWithinPartitions("block"), "lexical-queries")
    found = [
        _best(index, queries.where(F.col("block") == b).collect(), n, total, k)
        for b in range(max(1, -(-n_items // BLOCK_QUERIES)))
    ]
    order = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = functools.reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).join(keys, "item_no").select("item_id", "rank", "doc_id", "score")


LEXICAL_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER_SQL}, '{TERM}') AS ws FROM documents),
x AS (SELECT r, doc_id, ws, len(ws) AS n FROM d WHERE len(ws) > 0),
c AS (SELECT count(*) AS docs, coalesce(sum(n), 0)::BIGINT AS total FROM x),
p AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM x) GROUP BY r, w),
v AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY w, docs),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, w, count(*) AS qtf FROM (
  SELECT item_id, text, unnest(regexp_extract_all({LOWER_SQL}, '{TERM}')) AS w FROM i) GROUP BY item_id, text, w),
s AS (
  SELECT q.item_id, q.text, x.doc_id, x.r,
    sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN v USING (w) JOIN p USING (w) JOIN x USING (r), c GROUP BY q.item_id, q.text, x.doc_id, x.r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST, r))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""
