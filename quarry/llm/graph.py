"""Connected components of a link table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, saved_at


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) links; the root is some node of the component.

    Each round points every node at the least of itself and its neighbours (in odd rounds, least by hash, so that
    long monotone chains shrink as well), and replaces link ends by what they point at. Links that fall together
    vanish; the pointers of all rounds, followed in order, give the root. Every round's tables are written to the
    shared folder.
    """
    spark = links.sparkSession
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    live, path = saved_at(links.where("a <> b").select(*ends).distinct(), "links-0")
    pointers: list[DataFrame] = []
    turn = 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if turn % 2:
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
            least = F.least(F.min(rank("b")), rank("a"))["id"]
        else:
            least = F.least(F.min("b"), F.col("a"))
        pointer, _ = saved_at(both.groupBy("a").agg(least.alias("to")).withColumnRenamed("a", "node"), f"to-{turn}")
        pointers.append(pointer)
        one, two = pointer.toDF("a", "x"), pointer.toDF("b", "y")
        moved = live.join(one, "a").join(two, "b").where("x <> y")
        turn += 1
        live, new = saved_at(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"links-{turn}")
        discard(spark, path)
        path = new
    if not pointers:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = pointers.pop().toDF("node", "root")
    while pointers:
        later = roots.toDF("to", "root")
        roots = pointers.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots
