"""Exact top-k inner products through a bit-sliced index.

The index cuts all rows into blocks. A block holds, for every vector component, bitmaps of the high bits of its
quantised value (its slices) and the exact values. A query adds the slices, weighted by the bits of its own
components, with carry-save bitmap arithmetic; the sums, again slices, are walked from the most significant one
down to find the k-th largest coarse sum. The dropped low bits bound the error, so the rows that can still reach
the k best are known, and their scores are computed exactly.

Query blocks meet row blocks by an equi-join on block numbers; only each block's k best rows for a query go on.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; a shorter vector counts as padded with zeros; a row never answers a query with its own id; repeated rows are
candidates each; ties go to the smaller id; a query with fewer candidates returns them all; extra columns are
ignored; an empty table gives an empty result. Quantised values must fit in 31 bits and scores in 63.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import saved

ALL = np.uint64(2**64 - 1)


def quantised(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as a matrix; short rows are padded with zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(scale * np.asarray(v, np.float64))
    return out


def slices_of(exact: np.ndarray, dropped: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps (component, bit, word) of the values without their `dropped` low bits, counted from each least one."""
    coarse = exact >> dropped
    low = coarse.min(axis=0)
    above = (coarse - low).astype(np.uint64)
    bits = max(1, int(above.max(initial=0)).bit_length())
    words = -(-len(exact) // 64)
    out = np.zeros((exact.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((above >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        out[:, b, : len(packed)] = packed.T
    return out.view(np.uint64), low, bits


def weighted_sum(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices of the sum over components of |q| times the value (q >= 0) or its complement (q < 0)."""
    dims, bits, words = slices.shape
    signed = slices ^ np.where(query < 0, ALL, np.uint64(0))[:, None, None]
    weight = np.abs(query)
    top = int(weight.max(initial=0)).bit_length()
    piles: list[list[np.ndarray]] = [[] for _ in range(top + bits)]
    for j in range(top):
        chosen = signed[(weight >> j & 1).astype(bool)]
        if len(chosen):
            for b in range(bits):
                piles[j + b].append(chosen[:, b])
    out, place = [], 0
    while place < len(piles):
        pile = np.concatenate(piles[place]) if piles[place] else np.zeros((0, words), np.uint64)
        while len(pile) > 1:
            if place + 1 == len(piles):
                piles.append([])
            third = len(pile) // 3
            if third:
                a, b, c = pile[:third], pile[third : 2 * third], pile[2 * third : 3 * third]
                half = a ^ b
                piles[place + 1].append(a & b | c & half)
                pile = np.concatenate([half ^ c, pile[3 * third :]])
            else:
                piles[place + 1].append(pile[:1] & pile[1:])
                pile = pile[:1] ^ pile[1:]
        out.append(pile[0] if len(pile) else np.zeros(words, np.uint64))
        place += 1
    return out


def kth_largest(sums: list[np.ndarray], among: np.ndarray, k: int) -> int:
    """The k-th largest value of the sliced sums among the marked rows, from the most significant slice down."""
    tied, need, value = among, k, 0
    for place in reversed(range(len(sums))):
        ones = tied & sums[place]
        n = int(np.bitwise_count(ones).sum())
        if n >= need:
            tied, value = ones, value | 1 << place
        else:
            tied, need = tied & ~sums[place], need - n
    return value


def at_least(sums: list[np.ndarray], among: np.ndarray, bound: int) -> np.ndarray:
    """The marked rows whose sliced sum reaches `bound`."""
    if bound <= 0:
        return among
    if bound.bit_length() > len(sums):
        return np.zeros_like(among)
    above, tied = np.zeros_like(among), among
    for place in reversed(range(len(sums))):
        if bound >> place & 1:
            tied = tied & sums[place]
        else:
            above |= tied & sums[place]
            tied = tied & ~sums[place]
    return above | tied


def best_rows(
    query: np.ndarray, own: int, ids: np.ndarray, exact: np.ndarray, slices: np.ndarray, dropped: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and exact scores of the k best rows of a block for one query."""
    marks = np.zeros(slices.shape[2] * 8, np.uint8)
    packed = np.packbits(ids != own, bitorder="little")
    marks[: len(packed)] = packed
    among = marks.view(np.uint64)
    if int(np.bitwise_count(among).sum()) > k:
        sums = weighted_sum(slices, query)
        error = int(np.abs(query).sum()) * ((1 << dropped) - 1)
        bound = kth_largest(sums, among, k) - error // (1 << dropped)
        among = at_least(sums, among, bound)
    rows = np.flatnonzero(np.unpackbits(among.view(np.uint8), count=len(ids), bitorder="little"))
    scores = exact[rows].astype(np.int64) @ query
    keep = np.lexsort((ids[rows], -scores))[:k]
    return rows[keep], scores[keep]


def _valid(vectors: DataFrame, scale: int) -> DataFrame:
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf))
    )
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    )


def _blocks(vectors: DataFrame, rows: int, count: int, scale: int, dropped: int | None) -> DataFrame:
    """One row for each block: ids, exact values and, if `dropped` is given, slices."""
    n = max(1, -(-count // rows))

    def build(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy().astype(np.int64)
        exact = quantised(table["embedding"].to_pylist(), scale)
        kind = np.int16 if np.abs(exact).max(initial=0) < 1 << 15 else np.int32
        if np.abs(exact).max(initial=0) >= 1 << 31:
            raise ValueError("a quantised component needs more than 31 bits")
        order = np.argsort(ids, kind="stable")
        ids, exact = ids[order], exact[order]
        sliced = slices_of(exact, dropped) if dropped is not None else (np.zeros(0, np.uint64), None, 0)
        row = {
            "block": [table["block"][0].as_py()],
            "ids": [ids.tobytes()],
            "width": [exact.shape[1]],
            "wide": [kind is np.int32],
            "exact": [exact.astype(kind).tobytes()],
            "bits": [sliced[2]],
            "slices": [sliced[0].tobytes()],
        }
        return pa.table(row, schema=pa.schema(list(zip(row, _KINDS, strict=True))))

    return (
        vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
        .groupBy("block")
        .applyInArrow(build, "block int, ids binary, width int, wide boolean, exact binary, bits int, slices binary")
    )


_KINDS = (pa.int32(), pa.binary(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.binary())


def _matrix(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[side + "ids"], np.int64)
    kind = np.int32 if row[side + "wide"] else np.int16
    return ids, np.frombuffer(row[side + "exact"], kind).reshape(len(ids), row[side + "width"])


def exact_top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    dropped: int = 2,
    block_rows: int = 16384,
    query_rows: int = 128,
) -> DataFrame:
    """The k rows with the largest quantised inner product for each query row (vec_id divisible by `every`)."""
    valid = _valid(vectors, scale)
    asked = valid.where(F.col("vec_id") % every == 0)
    total, n_asked = valid.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    index = saved(_blocks(valid, block_rows, total, scale, dropped), "topk-index")
    queries = _blocks(asked, query_rows, n_asked, scale, None).select(
        F.col("block").alias("q_block"), *[F.col(c).alias("q_" + c) for c in ("ids", "width", "wide", "exact")]
    )
    n_blocks, n_query_blocks = max(1, -(-total // block_rows)), max(1, -(-n_asked // query_rows))
    left = index.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids, exact = _matrix(row, "")
                q_ids, q_exact = _matrix(row, "q_")
                width = max(exact.shape[1], q_exact.shape[1])
                exact = np.pad(exact, ((0, 0), (0, width - exact.shape[1])))
                q_exact = np.pad(q_exact, ((0, 0), (0, width - q_exact.shape[1]))).astype(np.int64)
                words = -(-len(ids) // 64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(row["width"], row["bits"], words)
                found = [
                    (own, *best_rows(q[: row["width"]], own, ids, exact[:, : row["width"]], slices, dropped, k))
                    for own, q in zip(q_ids.tolist(), q_exact, strict=True)
                ]
                counts = [len(rows) for _, rows, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, counts)),
                        pa.array(ids[np.concatenate([rows for _, rows, _ in found])] if found else [], pa.int64()),
                        pa.array(np.concatenate([s for *_, s in found]) if found else [], pa.int64()),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    best = left.join(right, ["block", "q_block"]).mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM p QUALIFY rank <= 5"""
