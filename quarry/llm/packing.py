"""Packing by optimal length buckets.

A global histogram of document lengths goes through dynamic programming that chooses the bucket boundaries with
the least padding; inside each bucket documents form batches of as many rows as the token budget holds at the
bucket's padded length.

The histogram has one bin for each length up to 1024 and 512 bins for each doubling above, so its size is bounded
by the logarithm of the longest document and it alone reaches the driver. A bin's edge is the longest length seen
in it.

Defined results: null and blank texts have no tokens and fill the shortest bucket; a document longer than the
budget makes a batch of its own, nothing is cut or dropped; repeated rows each take a slot; rows that tie in every
ordering column are interchangeable; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, numbered, saved, word_count


def length_bin(column: str) -> Column:
    """The bin of a length: itself up to 1024, above that rounded up to a step of a 512th to a 1024th of it."""
    step = f"shiftleft(1L, length(bin({column} - 1)) - 10)"
    return F.expr(f"CASE WHEN {column} <= 1024 THEN {column} ELSE ({column} + {step} - 1) div {step} * {step} END")


def optimal_boundaries(edges: list[int], counts: list[int], buckets: int) -> list[int]:
    """Indices of the bins that end each bucket, so that the sum of padded lengths is least.

    cost(k, j) is the least padded total of the first j + 1 bins in k buckets; the last bucket starts after bin i.
    Ties take the smaller i.
    """
    size = len(edges)
    edge, before = np.asarray(edges, np.int64), np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    cost, back = edge * before[1:], []
    for k in range(1, min(buckets, size)):
        new, arg = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
        for j in range(k, size):
            options = cost[k - 1 : j] + edge[j] * (before[j + 1] - before[k : j + 1])
            best = int(options.argmin())
            new[j], arg[j] = options[best], best + k - 1
        cost, back = new, [*back, arg]
    ends, j = [size - 1], size - 1
    for arg in reversed(back):
        j = int(arg[j])
        ends.append(j)
    return ends[::-1]


def pack_buckets(
    docs: DataFrame, buckets: int = 8, token_budget: int = 32768, tokens: Column | None = None
) -> DataFrame:
    """Pack every row of (doc_id, text): doc_id, n_tokens, bucket, padded_len, batch_id, slot.

    `tokens` counts a document's tokens; words by default.
    """
    spark = docs.sparkSession
    counted = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (word_count(F.col("text")) if tokens is None else tokens).cast("long").alias("_n"),
        ),
        "packing-tokens",
    )
    histogram = sorted(
        (row.edge, row.n)
        for row in counted.groupBy(length_bin("_n").alias("bin"))
        .agg(F.max("_n").alias("edge"), F.count("*").alias("n"))
        .collect()
    )
    if not histogram:
        return counted.select(
            "doc_id", F.col("_n").alias("n_tokens"), F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("padded_len"),
            F.lit(0).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("slot"),
        )
    edges, counts = map(list, zip(*histogram, strict=True))
    plan, first_row, first_batch, start = [], 0, 0, 0
    for bucket, end in enumerate(optimal_boundaries(edges, counts, buckets)):
        rows, length = sum(counts[start : end + 1]), edges[end]
        per_batch = max(1, token_budget // max(length, 1))
        plan.append((bucket, length, first_row, first_batch, per_batch))
        first_row, first_batch, start = first_row + rows, first_batch - (-rows // per_batch), end + 1
    bucket_of = F.lit(plan[-1][0])
    for bucket, length, *_ in reversed(plan[:-1]):
        bucket_of = F.when(F.col("_n") <= length, bucket).otherwise(bucket_of)
    keyed = counted.select("doc_id", "_n", bucket_of.alias("bucket"), F.md5(F.col("doc_id").cast("string")).alias("_key"))
    rows, _ = numbered(keyed, ["bucket", "_key", "doc_id", "_n"], "packing")
    table = F.broadcast(
        spark.createDataFrame(plan, "bucket int, padded_len long, _first_row long, _first_batch long, _per_batch long")
    )
    return rows.join(table, "bucket").select(
        "doc_id",
        F.col("_n").alias("n_tokens"),
        "bucket",
        "padded_len",
        F.expr("_first_batch + (row_no - _first_row) div _per_batch").alias("batch_id"),
        F.expr("(row_no - _first_row) % _per_batch").alias("slot"),
    )


def packing_sql(buckets: int = 8, token_budget: int = 32768) -> str:
    """The same result in DuckDB: one common table expression for each bucket of the dynamic program."""
    steps = ["d1 AS (SELECT j, edge * upto AS cost, [edge] AS ends FROM c)"]
    steps += [
        f"d{k} AS (SELECT c.j, min(p.cost + c.edge * (c.upto - q.upto)) AS cost, "
        f"list_append(arg_min(p.ends, [p.cost + c.edge * (c.upto - q.upto), p.j]), any_value(c.edge)) AS ends "
        f"FROM d{k - 1} p JOIN c q ON q.j = p.j JOIN c ON c.j > p.j GROUP BY c.j)"
        for k in range(2, buckets + 1)
    ]
    ends = " UNION ALL ".join(
        f"SELECT {k} AS k, ends FROM d{k} WHERE j = (SELECT max(j) FROM c)" for k in range(1, buckets + 1)
    )
    return f"""
WITH t AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n FROM documents),
b AS (
  SELECT max(n) AS edge, count(*) AS cnt FROM t
  GROUP BY CASE WHEN n <= 1024 THEN n ELSE
    (n + (1::BIGINT << (length(bin(n - 1)) - 10)) - 1) // (1::BIGINT << (length(bin(n - 1)) - 10))
    * (1::BIGINT << (length(bin(n - 1)) - 10)) END),
c AS (
  SELECT edge, row_number() OVER (ORDER BY edge) AS j, (sum(cnt) OVER (ORDER BY edge))::BIGINT AS upto FROM b),
{", ".join(steps)},
best AS (SELECT arg_max(ends, k) AS ends FROM ({ends})),
u AS (SELECT unnest(ends) AS padded_len, unnest(range(len(ends))) AS bucket FROM best),
r AS (
  SELECT doc_id, n, padded_len, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(doc_id::VARCHAR), doc_id, n) - 1 AS i
  FROM (SELECT t.*, (SELECT min(bucket) FROM u WHERE u.padded_len >= t.n) AS bucket FROM t) JOIN u USING (bucket)),
s AS (
  SELECT bucket, (sum(ceil(cnt / greatest(1, {token_budget} // greatest(padded_len, 1)))) OVER (ORDER BY bucket ROWS
    BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS first_batch
  FROM (SELECT bucket, padded_len, count(*) AS cnt FROM r GROUP BY ALL))
SELECT doc_id, n AS n_tokens, r.bucket::INT AS bucket, padded_len,
  coalesce(first_batch, 0) + i // greatest(1, {token_budget} // greatest(padded_len, 1)) AS batch_id,
  i % greatest(1, {token_budget} // greatest(padded_len, 1)) AS slot
FROM r JOIN s ON s.bucket = r.bucket"""
