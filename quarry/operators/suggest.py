"""Categories by embedding: similarity to a category's centroids, set against what is usual for that category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import dot
from quarry.operators.classify import related
from quarry.plans.registry import Tables, query

# Candidates looked at and shown, and from which score and margin a suggestion holds by itself.
POOL, SHOWN, LEAST_Z, LEAST_MARGIN, NO_RIVAL = 12, 3, 2.0, 0.6, -9.0


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


def tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Vectors with the regions that their source names, and categories with a region and two centroids.

    Labels are leaves under three groups; groups are categories, too. The centroids stand for a category's whole name and for
    its own name: they come from vectors of even and of odd numbers.
    """
    rows = t.embeddings.where(F.col("embedding").isNotNull() & F.col("label").isNotNull()).select("vec_id", unit(F.col("embedding")).alias("v"), "label")
    group = lambda n: F.concat(F.lit("g"), n.cast("string"))
    paths = F.array(group(F.col("label") % 3), F.concat(group(F.col("label") % 3), F.lit("/l"), F.col("label").cast("string")))
    cells = rows.select(F.explode(paths).alias("path"), (F.col("vec_id") % 2).alias("side"), F.posexplode("v").alias("i", "x"))
    means = cells.groupBy("path", "side", "i").agg(F.avg("x").alias("x"))
    sides = means.groupBy("path", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    names = sides.groupBy("path").agg(F.max(F.when(F.col("side") == 0, F.struct("c"))).alias("even"), F.max(F.when(F.col("side") == 1, F.struct("c"))).alias("odd"))
    known = names.where("even IS NOT NULL AND odd IS NOT NULL").select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("region"), unit(F.col("even.c")).alias("ep"), unit(F.col("odd.c")).alias("el"))
    named = rows.select("vec_id", "v", F.explode(F.array(group(F.col("vec_id") % 3), group((F.col("vec_id") + 1) % 3))).alias("region"))
    return named, known


def suggestions(vectors: DataFrame, categories: DataFrame) -> DataFrame:
    """verdict, the shown paths, z of the best and its margin, of vectors (vec_id, v, region; several regions each).

    Similarity is the mean of two cosines, as a z-score of the category's similarities to all vectors that ask in its region.
    The margin is to the best category of another branch: ancestors and descendants are no rivals.
    """
    sims = vectors.join(categories, "region").select("vec_id", "path", ((dot(F.col("v"), F.col("ep")) + dot(F.col("v"), F.col("el"))) / 2).alias("sim"))
    usual = sims.groupBy("path").agg(F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"))
    z = F.round((F.col("sim") - F.col("mean")) / (F.col("std") + 1e-6), 6)
    ranked = sims.join(usual, "path").select("vec_id", "path", z.alias("z"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("z"), "path"))).where(F.col("r") <= POOL)
    pools = ranked.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("r", "path", "z"))).alias("pool"))
    keep = lambda acc, c: F.when((F.size(acc) < SHOWN) & ~F.exists(acc, lambda p: related(p, c["path"])), F.array_append(acc, c["path"])).otherwise(acc)
    rivals = F.filter(F.slice("pool", 2, POOL), lambda c: ~related(c["path"], F.col("pool")[0]["path"]))
    pools = pools.withColumns({"shown": F.aggregate("pool", F.array().cast("array<string>"), keep), "rival": F.get(F.transform(rivals, lambda c: c["z"]), F.lit(0))})
    top = F.col("pool")[0]["z"]
    margin = F.round(top - F.coalesce("rival", F.lit(NO_RIVAL)), 6)
    verdict = F.when((top >= LEAST_Z) & (margin >= LEAST_MARGIN), "semantic").otherwise("review")
    return pools.select("vec_id", verdict.alias("verdict"), F.array_join("shown", ",").alias("paths"), top.alias("z"), margin.alias("margin"))


@query(
    "clf_embedding",
    f"""WITH v AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)),
cells AS (SELECT path, vec_id % 2 AS side, i, v[i] AS x FROM (SELECT *, unnest(['g' || label % 3, 'g' || label % 3 || '/l' || label]) AS path FROM v), (SELECT unnest(range(1, (SELECT max(len(v)) FROM v) + 1)) AS i) WHERE v[i] IS NOT NULL),
sides AS (SELECT path, side, list(x ORDER BY i) AS c FROM (SELECT path, side, i, avg(x) AS x FROM cells GROUP BY ALL) GROUP BY path, side),
units AS (SELECT path, side, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS u FROM sides),
cats AS (SELECT a.path, split_part(a.path, '/', 1) AS region, a.u AS ep, b.u AS el FROM units a JOIN units b ON a.path = b.path AND a.side = 0 AND b.side = 1),
sims AS (
  SELECT vec_id, path, (list_inner_product(v, ep) + list_inner_product(v, el)) / 2 AS sim
  FROM (SELECT vec_id, v, unnest(['g' || vec_id % 3, 'g' || (vec_id + 1) % 3]) AS region FROM v) JOIN cats USING (region)),
z AS (
  SELECT vec_id, path, round((sim - mean) / (std + 1e-6::DOUBLE), 6) AS z FROM sims JOIN (SELECT path, avg(sim) AS mean, stddev_pop(sim) AS std FROM sims GROUP BY path) USING (path)),
p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, path) AS r FROM z QUALIFY r <= {POOL}),
t AS (SELECT * FROM p WHERE r = 1),
rival AS (SELECT p.vec_id, arg_min(p.z, p.r) AS z FROM p JOIN t USING (vec_id) WHERE p.r > 1 AND NOT (p.path = t.path OR starts_with(p.path, t.path || '/') OR starts_with(t.path, p.path || '/')) GROUP BY p.vec_id),
shown AS (SELECT vec_id, list_reduce(list([path] ORDER BY r), lambda acc, c: CASE WHEN len(acc) < {SHOWN}
  AND len(list_filter(acc, lambda x: x = c[1] OR starts_with(x, c[1] || '/') OR starts_with(c[1], x || '/'))) = 0 THEN list_append(acc, c[1]) ELSE acc END) AS paths FROM p GROUP BY vec_id)
SELECT vec_id, CASE WHEN t.z >= {LEAST_Z} AND round(t.z - coalesce(rival.z, {NO_RIVAL}), 6) >= {LEAST_MARGIN} THEN 'semantic' ELSE 'review' END AS verdict,
  array_to_string(paths, ',') AS paths, t.z, round(t.z - coalesce(rival.z, {NO_RIVAL}), 6) AS margin FROM t LEFT JOIN rival USING (vec_id) JOIN shown USING (vec_id)""",
)
def clf_embedding(t: Tables) -> DataFrame:
    """A suggested category for every vector in the regions of its source."""
    return suggestions(*tree(t))
