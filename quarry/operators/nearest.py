"""Exact nearest vectors by cosine: every twentieth vector asks, all rows answer.

Rows fall into blocks of bounded size inside their group, queries into chunks; a block and a chunk meet in one task as
two matrices and give each query's best rows there, then a window ranks each query's few survivors. Nothing is
broadcast, and a group of any size is many blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import cosine
from quarry.plans.registry import Tables, query

BLOCK, CHUNK = 8192, 2048
#: A pool with more rows than this is reported as too large for an exact answer in the serving path.
POOL = 2000


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors scaled to length one, as rows; a vector of another width or without length is all zero."""
    rows = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            rows[i] = v
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def nearest(queries: DataFrame, rows: DataFrame, k: int, floor: float = -1.0) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best rows of each query's group, without the query itself, ties to the smaller id.

    Both sides have id, pool and embedding. Scores are rounded to six digits and not below zero.
    """
    blocks = rows.groupBy("pool").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    chunks = queries.groupBy("pool").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    sizes = blocks.join(chunks, "pool")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    index = rows.join(sizes, "pool").select("pool", F.pmod(F.xxhash64("id"), "blocks").alias("b"), each("chunks").alias("c"), "id", "embedding")
    # New names, as both sides may come from one table.
    asked = queries.join(sizes, "pool").select("pool", each("blocks").alias("b"), F.pmod(F.xxhash64("id"), "chunks").alias("c"), "id", "embedding")
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asks = left["id"].to_numpy(), right["q_id"].to_numpy()
        found = []
        if len(ids) and len(asks):
            width = len(right["q_embedding"][0].as_py() or [])
            order = np.argsort(ids, kind="stable")
            ids, base = ids[order], matrix(left["embedding"], width)[order]
            scores = np.round(np.maximum(0.0, matrix(right["q_embedding"], width) @ base.T), 6)
            for q, row in zip(asks, scores, strict=True):
                row[ids == q] = -2
                top = np.argsort(-row, kind="stable")[:k]
                found += [(q, ids[i], row[i]) for i in top[row[top] >= max(floor, 0.0)]]
        a, b, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ["pool", "b", "c"]
    best = index.groupBy(*keys).cogroup(asked.groupBy(*[f"q_{k}" for k in keys])).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def asking(t: Tables, pool: str) -> tuple[DataFrame, DataFrame]:
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.expr(pool).alias("pool"), "embedding").where("pool IS NOT NULL")
    return rows.where("id % 20 = 0"), rows


_S = "round(greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6)"
_PAIRS = f"SELECT a.vec_id AS query_id, a.label, b.vec_id, {_S} AS score FROM embeddings a JOIN embeddings b ON {{on}} AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"


@query(
    "knn_global",
    f"""WITH p AS ({_PAIRS.format(on='true')}), r AS (SELECT *, {_RANK} AS n FROM p QUALIFY n <= 400)
    SELECT query_id, r.vec_id, score FROM r JOIN embeddings e ON e.vec_id = r.vec_id WHERE e.label = r.label QUALIFY {_RANK.replace("vec_id)", "r.vec_id)")} <= 120""",
)
def knn_global(t: Tables) -> DataFrame:
    """The 400 nearest of all rows for each query, then the filter (one label), then at most 120."""
    found = nearest(*asking(t, "0"), 400)
    label = t.embeddings.select("vec_id", "label")
    kept = found.join(label, "vec_id").join(label.toDF("query_id", "asked"), "query_id").where("label = asked")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("n", again).where("n <= 120").select("query_id", "vec_id", "score")


@query(
    "knn_category_exact",
    f"""WITH p AS ({_PAIRS.format(on='a.label = b.label')}), n AS (SELECT label, count(*) AS pool FROM embeddings GROUP BY label)
    SELECT query_id, vec_id, score, pool > {POOL} AS overflow FROM (SELECT * FROM p QUALIFY {_RANK} <= 40) JOIN n USING (label)""",
)
def knn_category_exact(t: Tables) -> DataFrame:
    """The 40 nearest inside the query's label, and whether that pool is too large to be served exactly."""
    asked, rows = asking(t, "label")
    pools = rows.groupBy("pool").agg((F.count("*") > POOL).alias("overflow"))
    of = asked.join(pools, "pool").select(F.col("id").alias("query_id"), "overflow")
    return nearest(asked, rows, 40).join(of, "query_id").select("query_id", "vec_id", "score", "overflow")


@query(
    "flt_semantic_gate",
    f"""WITH p AS ({_PAIRS.format(on='a.label = b.label')}), g AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, {_RANK} AS n FROM p)
    SELECT query_id, vec_id, score FROM g WHERE n <= 48 AND score >= 0.30 AND score >= best - 0.12""",
)
def flt_semantic_gate(t: Tables) -> DataFrame:
    """Of each query's 48 nearest those above a floor and close enough to the best."""
    found = nearest(*asking(t, "label"), 48)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return found.withColumn("best", best).where("score >= 0.30 AND score >= best - 0.12").select("query_id", "vec_id", "score")


@query(
    "knn_similarity_lookup",
    f"SELECT a.vec_id AS query_id, b.vec_id, {_S} AS score FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 3, a.vec_id * 2 + 5) WHERE a.vec_id % 20 = 0",
)
def knn_similarity_lookup(t: Tables) -> DataFrame:
    """The similarity of given pairs of ids: two equi-joins."""
    given = F.explode(F.array_distinct(F.expr("array(vec_id + 1, vec_id + 3, vec_id * 2 + 5)"))).alias("vec_id")
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), given)
    rows = asked.join(t.embeddings.select("vec_id", "embedding"), "vec_id")
    return rows.select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score"))


@query(
    "knn_edges",
    f"""WITH i AS (SELECT vec_id, label, label::VARCHAR || '-' || vec_id // 5 AS product_id, embedding FROM embeddings),
    c AS (SELECT product_id, list(m ORDER BY d) AS embedding FROM (SELECT product_id, d, avg(x) AS m FROM (
      SELECT product_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM i) GROUP BY product_id, d) GROUP BY product_id),
    n AS (SELECT product_id, count(*) < 5 AS thin FROM i GROUP BY product_id),
    p AS (SELECT a.vec_id AS query_id, a.product_id AS one, b.vec_id, b.product_id AS two, {_S} AS score FROM i a JOIN i b ON a.label = b.label AND a.vec_id <> b.vec_id),
    s AS (SELECT DISTINCT one, two FROM (SELECT * FROM p QUALIFY {_RANK} <= 60) WHERE one <> two),
    u AS (SELECT one, two FROM s UNION SELECT two, one FROM s),
    e AS (SELECT one AS a, two AS b, {_S.replace('6)', '4)')} AS score FROM u JOIN c a ON a.product_id = one JOIN c b ON b.product_id = two)
    SELECT e.a, e.b, e.score, thin FROM e JOIN n ON n.product_id = e.a WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY e.a ORDER BY score DESC, e.b) <= 8""",
)
def knn_edges(t: Tables) -> DataFrame:
    """Edges between products: candidates from the 60 nearest of each item, scores between centroids, the best eight both ways.

    A product is the items of one label with neighbouring ids; `thin` marks those with under five items.
    """
    items = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("pool"), "embedding", F.concat_ws("-", F.col("label").cast("string"), F.expr("vec_id div 5").cast("string")).alias("product_id"))
    found = nearest(items, items, 60)
    of = items.select("id", "product_id")
    pairs = found.join(of.toDF("query_id", "a"), "query_id").join(of.toDF("vec_id", "b"), "vec_id").where("a <> b").select("a", "b").distinct()
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    parts = items.select("product_id", F.posexplode("embedding").alias("d", "x")).groupBy("product_id", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = parts.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("v")).select("product_id", F.col("v.m").alias("v"))
    thin = items.groupBy("product_id").agg((F.count("*") < 5).alias("thin"))
    rows = pairs.join(centroids.toDF("a", "x"), "a").join(centroids.toDF("b", "y"), "b")
    rows = rows.select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 4).alias("score")).where("score >= 0.45")
    top = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return rows.withColumn("n", top).where("n <= 8").drop("n").join(thin.toDF("a", "thin"), "a")
