"""Record matching and nearest neighbours: exact keys, scores, clusters, edges and rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import cosine
from quarry.plans.registry import Tables, query


@query(
    "er_candidate_pairs",
    """WITH g AS (SELECT brand, size, count(*) AS n FROM products GROUP BY ALL) SELECT a.product_id AS a, b.product_id AS b FROM products a JOIN products b USING (brand, size) JOIN g USING (brand, size)
    WHERE a.product_id < b.product_id AND n BETWEEN 2 AND 50""",
)
def er_candidate_pairs(t: Tables) -> DataFrame:
    """Pairs inside groups of 2 to 50; the bound is part of the rule."""
    keys = ["brand", "size"]
    groups = t.products.groupBy(*keys).agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 50").drop("n")
    one, two = (t.products.select(*keys, F.col("product_id").alias(c)) for c in "ab")
    return one.join(groups, keys, "left_semi").join(two, keys).where("a < b").select("a", "b")


@query(
    "q_rrf",
    """WITH a AS (SELECT product_id, row_number() OVER (ORDER BY catalog_price DESC, product_id) AS r FROM products ORDER BY r LIMIT 100),
    b AS (SELECT product_id, row_number() OVER (ORDER BY size DESC, product_id) AS r FROM products ORDER BY r LIMIT 100)
    SELECT coalesce(a.product_id, b.product_id) AS product_id, round(coalesce(1 / (60 + a.r), 0) + 0.8 * coalesce(1 / (60 + b.r), 0), 8) AS score FROM a FULL JOIN b USING (product_id)""",
)
def q_rrf(t: Tables) -> DataFrame:
    """Reciprocal rank fusion of two result lists of a hundred."""

    def ranked(order: str, name: str) -> DataFrame:
        top = t.products.orderBy(F.desc(order), "product_id").limit(100)
        return top.select("product_id", F.row_number().over(Window.orderBy(F.desc(order), "product_id")).alias(name))

    both = ranked("catalog_price", "r").join(ranked("size", "s"), "product_id", "full")
    part = lambda c: F.coalesce(1 / (F.lit(60.0) + F.col(c)), F.lit(0.0))
    return both.select("product_id", F.round(part("r") + 0.8 * part("s"), 8).alias("score"))


@query(
    "q_explain",
    """WITH o AS (SELECT product_id, bool_or(in_stock) AS stock, min(price) AS lo FROM offers GROUP BY 1), f AS (SELECT p.product_id, o.product_id IS NOT NULL AS a, coalesce(stock, false) AS b, path LIKE '%/gear' AS c, coalesce(lo < 100000, false) AS d FROM products p LEFT JOIN o USING (product_id))
    SELECT count(*) AS candidates, count(*) FILTER (a) AS offered, count(*) FILTER (a AND b) AS stocked, count(*) FILTER (a AND b AND c) AS matching, count(*) FILTER (a AND b AND c AND d) AS shown,
    count(*) FILTER (a AND b AND d AND NOT c) AS only_c FROM f""",
)
def q_explain(t: Tables) -> DataFrame:
    """How many rows each predicate leaves, and how many one of them alone rejects: one pass, one column a predicate."""
    own = t.offers.groupBy("product_id").agg(F.bool_or("in_stock").alias("stock"), F.min("price").alias("lo"))
    f = t.products.join(own, "product_id", "left").selectExpr(
        "lo IS NOT NULL AS a", "coalesce(stock, false) AS b", "path LIKE '%/gear' AS c", "coalesce(lo < 100000, false) AS d"
    )
    n = lambda e: F.count_if(F.expr(e))
    return f.agg(
        F.count("*").alias("candidates"), n("a").alias("offered"), n("a AND b").alias("stocked"), n("a AND b AND c").alias("matching"),
        n("a AND b AND c AND d").alias("shown"), n("a AND b AND d AND NOT c").alias("only_c"),
    )


@query(
    "cat_gate",
    """SELECT product_id, CASE WHEN title IS NULL OR len(title) < 3 THEN 'held_title' WHEN n IS NULL THEN 'draft' WHEN lo <= 0 THEN 'held_price' WHEN n < 20 THEN 'held_few' ELSE 'ready' END AS state
    FROM products LEFT JOIN (SELECT product_id, count(*) AS n, min(price) AS lo FROM offers GROUP BY 1) USING (product_id)""",
)
def cat_gate(t: Tables) -> DataFrame:
    """The first reason that holds a product back, or ready."""
    own = t.offers.groupBy("product_id").agg(F.count("*").alias("n"), F.min("price").alias("lo"))
    state = F.expr("CASE WHEN title IS NULL OR length(title) < 3 THEN 'held_title' WHEN n IS NULL THEN 'draft' WHEN lo <= 0 THEN 'held_price' WHEN n < 20 THEN 'held_few' ELSE 'ready' END")
    return t.products.join(own, "product_id", "left").select("product_id", state.alias("state"))


@query(
    "topk_diverse",
    """SELECT root, product_id, row_number() OVER (PARTITION BY root ORDER BY catalog_price DESC, product_id)::INT AS place FROM (
      SELECT *, split_part(path, '/', 1) AS root FROM products QUALIFY row_number() OVER (PARTITION BY split_part(path, '/', 1), brand ORDER BY catalog_price DESC, product_id) <= 2)
    QUALIFY place <= 10""",
)
def topk_diverse(t: Tables) -> DataFrame:
    """Ten products a root category by price, at most two a brand: the greedy choice is a rank in the brand, then in the root."""
    rows = t.products.withColumn("root", F.split_part("path", F.lit("/"), F.lit(1)))
    order = [F.desc("catalog_price"), "product_id"]
    pool = rows.withColumn("n", F.row_number().over(Window.partitionBy("root", "brand").orderBy(*order))).where("n <= 2")
    return pool.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where("place <= 10").select("root", "product_id", "place")
