"""A diverse choice: the best candidates of each group that conflict with no better one, under caps."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query
from quarry.plans.scratch import scratch_path

# The choice's size, caps, and from which similarity and size titles are near-duplicates or one family.
TARGET, BRAND_CAP, MERCHANT_SHARE, CATEGORY_SHARE, NEAR, FAMILY = 24, 3, 0.5, 0.5, 0.75, 3
#: Candidates of a group that a task looks at in a round.
BLOCK = 2048


def caps(target: int) -> tuple[int, int]:
    return max(4, math.ceil(target * MERCHANT_SHARE)), max(4, math.ceil(target * CATEGORY_SHARE))


def conflicts(a: set, b: set, fa: list, fb: list) -> bool:
    both = len(a | b)
    return (both > 0 and bool(a) and bool(b) and len(a & b) / both >= NEAR) or (len(fa) >= FAMILY and fa == fb)


COLUMNS = "root string, product_id long, score double, offer_count long, brand string, merchant_id long, category string, sig array<string>, family array<string>"


def chosen(candidates: DataFrame, target: int = TARGET) -> DataFrame:
    """The chosen rows of candidates (COLUMNS), with place.

    In the order of score, offers and number a candidate is taken unless its brand, merchant or subcategory is full, or a
    taken one has nearly its title or its family. In rounds: candidates that the taken ones rule out are dropped where they
    lie, a task takes what it can of a group's next best BLOCK, and the next round begins after these. The first candidate of
    a block always fits, so at most `target` rounds are needed; only counts reach the driver.
    """
    spark = candidates.sparkSession
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    merchant_cap, category_cap = caps(target)
    order = ["minus", "few", "product_id"]
    pool = candidates.select(*names).withColumns({"minus": -F.col("score"), "few": -F.col("offer_count")})

    def pick(key: tuple, fresh: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("place")
        taken = [(set(r.sig), list(r.family)) for r in held.itertuples()]
        brands, merchants, categories = (Counter(held[c].dropna()) for c in ("brand", "merchant_id", "category"))
        out = []
        for r in fresh.sort_values(order).itertuples():
            if len(taken) >= target:
                break
            sig, family = set(r.sig), list(r.family)
            if (r.brand and brands[r.brand] >= BRAND_CAP) or merchants[r.merchant_id] >= merchant_cap or (r.category and categories[r.category] >= category_cap):
                continue
            if any(conflicts(sig, s, family, f) for s, f in taken):
                continue
            taken.append((sig, family))
            out.append((*(getattr(r, n) for n in names), len(taken)))
            merchants[r.merchant_id] += 1
            if r.brand:
                brands[r.brand] += 1
            if r.category:
                categories[r.category] += 1
        return pd.DataFrame(out, columns=[*names, "place"])

    def full(held: DataFrame, column: str, cap: int) -> DataFrame:
        return held.where(F.col(column).isNotNull()).groupBy("root", column).count().where(F.col("count") >= cap).select("root", column)

    held = spark.createDataFrame([], f"{COLUMNS}, place int")
    while True:
        state = held.groupBy("root").agg(
            F.count("*").alias("n"), F.collect_list(F.struct("sig", "family")).alias("taken"), F.max(F.struct((-F.col("score")).alias("minus"), (-F.col("offer_count")).alias("few"), "product_id")).alias("last")
        )
        rest = pool.join(state, "root", "left").where("n IS NULL OR n < " + str(target))
        rest = rest.where(F.col("last").isNull() | (F.struct(*order) > F.col("last")))
        both = lambda s: F.size(F.array_union("sig", s["sig"]))
        near = lambda s: (F.size("sig") > 0) & (F.size(s["sig"]) > 0) & (F.size(F.array_intersect("sig", s["sig"])) >= NEAR * both(s))
        kin = lambda s: (F.size("family") >= FAMILY) & (F.col("family") == s["family"])
        rest = rest.where(F.col("taken").isNull() | ~F.exists("taken", lambda s: near(s) | kin(s))).drop("n", "taken", "last")
        for column, cap in (("brand", BRAND_CAP), ("merchant_id", merchant_cap), ("category", category_cap)):
            rest = rest.join(full(held, column, cap), ["root", column], "left_anti")
        next_best = rest.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where(F.col("r") <= BLOCK).drop("r")
        new = next_best.groupBy("root").cogroup(held.groupBy("root")).applyInPandas(pick, f"{COLUMNS}, place int")
        path = scratch_path(spark, "diverse")
        held.unionByName(new).write.parquet(path)
        more = spark.read.parquet(path)
        if more.count() == held.count():
            return held
        held = more


def candidate_products(t: Tables) -> DataFrame:
    """Products as candidates of their root category: scored by how much cheaper than the catalog their best offer is."""
    best = t.offers.groupBy("product_id").agg(F.min(F.struct("price", "merchant_id")).alias("b"), F.count("*").alias("offer_count"))
    rows = t.products.join(best, "product_id")
    score = F.floor(F.greatest(F.lit(0), F.least(F.lit(4000), F.col("b.price") * 100 / F.col("catalog_price"))) / 100).cast("double")
    title = F.concat_ws(" ", "title", F.concat(F.lit("v"), F.col("size") % 4), F.concat(F.lit("m"), F.col("size") % 3))
    words = F.array_sort(F.array_distinct(F.split(title, " ")))
    return rows.select(
        F.split_part("path", F.lit("/"), F.lit(1)).alias("root"), "product_id", score.alias("score"), "offer_count", "brand", F.col("b.merchant_id").alias("merchant_id"),
        F.col("path").alias("category"), words.alias("sig"), F.filter(words, lambda w: ~w.rlike("^m[0-9]$")).alias("family"),
    )


def _sorted_words(title: str) -> str:
    return f"list_sort(list_distinct(string_split({title}, ' ')))"


_M, _C = caps(TARGET)


@query(
    "topk_diverse_greedy",
    f"""WITH RECURSIVE c0 AS (
  SELECT split_part(path, '/', 1) AS root, p.product_id, floor(greatest(0, least(4000, b.price * 100 / catalog_price)) / 100)::DOUBLE AS score, offer_count, brand, merchant_id, path AS category,
    {_sorted_words("title || ' v' || (size % 4) || ' m' || (size % 3)")} AS sig
  FROM products p JOIN (SELECT product_id, arg_min(merchant_id, price * 100000 + merchant_id) AS merchant_id, min(price) AS price, count(*) AS offer_count FROM offers GROUP BY product_id) b ON b.product_id = p.product_id),
c AS (SELECT *, list_filter(sig, lambda w: NOT regexp_full_match(w, 'm[0-9]')) AS family, row_number() OVER (PARTITION BY root ORDER BY score DESC, offer_count DESC, product_id) AS r FROM c0),
s AS (
  SELECT DISTINCT root, 0::BIGINT AS r, []::BIGINT[] AS ids, []::VARCHAR[] AS brands, []::BIGINT[] AS merchants, []::VARCHAR[] AS categories, []::VARCHAR[][] AS sigs, []::VARCHAR[][] AS families FROM c
  UNION ALL
  SELECT root, next, CASE WHEN fits THEN list_append(ids, product_id) ELSE ids END, CASE WHEN fits THEN list_append(brands, brand) ELSE brands END,
    CASE WHEN fits THEN list_append(merchants, merchant_id) ELSE merchants END, CASE WHEN fits THEN list_append(categories, category) ELSE categories END,
    CASE WHEN fits THEN list_append(sigs, sig) ELSE sigs END, CASE WHEN fits THEN list_append(families, family) ELSE families END
  FROM (SELECT s.*, c.r AS next, c.product_id, c.brand, c.merchant_id, c.category, c.sig, c.family, len(ids) < {TARGET} AND len(list_filter(brands, lambda x: x = c.brand)) < {BRAND_CAP}
      AND len(list_filter(merchants, lambda x: x = c.merchant_id)) < {_M} AND len(list_filter(categories, lambda x: x = c.category)) < {_C}
      AND len(list_filter(sigs, lambda x: len(list_intersect(x, c.sig)) >= {NEAR} * len(list_distinct(x || c.sig)))) = 0
      AND (len(c.family) < {FAMILY} OR len(list_filter(families, lambda x: x = c.family)) = 0) AS fits FROM s JOIN c ON c.root = s.root AND c.r = s.r + 1))
SELECT root, unnest(ids) AS product_id, unnest(range(1, len(ids) + 1))::INT AS place FROM (SELECT * FROM s QUALIFY r = max(r) OVER (PARTITION BY root))""",
)
def topk_diverse_greedy(t: Tables) -> DataFrame:
    """The diverse choice of every root category."""
    return chosen(candidate_products(t)).select("root", "product_id", "place")
