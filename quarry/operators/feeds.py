"""Snapshots of a feed: differences, price points, membership, sweeps and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query

CUT = "DATE '1998-01-01'"
_SNAPSHOTS = f"""a AS (SELECT product_id, merchant_id, arg_max(price, (day, point_id)) AS price, arg_max(in_stock, (day, point_id)) AS stock FROM prices WHERE day < {CUT} GROUP BY ALL),
    b AS (SELECT product_id, merchant_id, arg_max(price, (day, point_id)) AS price, arg_max(in_stock, (day, point_id)) AS stock FROM prices WHERE day >= {CUT} GROUP BY ALL)"""
KEY = ["product_id", "merchant_id"]


def snapshot(points: DataFrame) -> DataFrame:
    """The state of every offer after the given observations."""
    order = F.struct("day", "point_id")
    return points.groupBy(*KEY).agg(F.max_by("price", order).alias("price"), F.max_by("in_stock", order).alias("stock"))


def both(t: Tables) -> DataFrame:
    """Previous and incoming snapshots, joined in full; `old` and `new` are structs or null."""
    pack = lambda rows, name: rows.select(*KEY, F.struct("price", "stock").alias(name))
    return pack(snapshot(t.prices.where(f"day < {CUT}")), "old").join(pack(snapshot(t.prices.where(f"day >= {CUT}")), "new"), KEY, "full")


@query(
    "cdc_diff",
    f"""WITH {_SNAPSHOTS} SELECT product_id, merchant_id, CASE WHEN a.price IS NULL THEN 'inserted' WHEN b.price IS NULL THEN 'missing' WHEN NOT a.stock AND b.stock THEN 'reactivated'
    WHEN a.price <> b.price OR a.stock <> b.stock THEN 'changed' ELSE 'unchanged' END AS state FROM a FULL JOIN b USING (product_id, merchant_id)""",
)
def cdc_diff(t: Tables) -> DataFrame:
    state = (
        F.when(F.col("old").isNull(), "inserted")
        .when(F.col("new").isNull(), "missing")
        .when(~F.col("old.stock") & F.col("new.stock"), "reactivated")
        .when(F.col("old") != F.col("new"), "changed")
        .otherwise("unchanged")
    )
    return both(t).select(*KEY, state.alias("state"))


@query(
    "cdc_price_points",
    f"""WITH {_SNAPSHOTS} SELECT product_id, merchant_id, b.price FROM b LEFT JOIN a USING (product_id, merchant_id) WHERE (a.price, a.stock) IS DISTINCT FROM (b.price, b.stock)""",
)
def cdc_price_points(t: Tables) -> DataFrame:
    """A point only for new or changed offers."""
    return both(t).where("new IS NOT NULL AND NOT (old <=> new)").select(*KEY, F.col("new.price").alias("price"))


@query(
    "cdc_membership",
    f"""SELECT product_id, merchant_id, max(day) AS last_seen, max(day) < {CUT} AS dropped FROM prices GROUP BY ALL""",
    dates="last_seen",
)
def cdc_membership(t: Tables) -> DataFrame:
    return t.prices.groupBy(*KEY).agg(F.max("day").alias("last_seen")).withColumn("dropped", F.expr(f"last_seen < {CUT}"))


@query(
    "cdc_sweep",
    f"""WITH s AS (SELECT product_id, merchant_id, max(day) AS seen FROM prices GROUP BY ALL), g AS (SELECT count(*) FILTER (seen < {CUT} - 975) AS gone, count(*) AS total FROM s)
    SELECT product_id, merchant_id FROM s, g WHERE (product_id, merchant_id % 10) NOT IN (SELECT product_id, merchant_id % 10 FROM prices WHERE day >= {CUT}) AND seen < {CUT} - 975 AND gone * 10 <= total""",
)
def cdc_sweep(t: Tables) -> DataFrame:
    """Offers unseen past the grace period that no newer feed (one of ten) lists, unless that would take over a tenth of all."""
    seen = t.prices.groupBy(*KEY).agg(F.max("day").alias("seen"))
    old = f"seen < {CUT} - INTERVAL 975 DAY"
    guard = seen.agg((F.count_if(F.expr(old)) * 10 <= F.count("*")).alias("safe"))
    feed = (F.col("merchant_id") % 10).alias("feed")
    member = t.prices.where(f"day >= {CUT}").select("product_id", feed).distinct()
    return seen.where(old).withColumn("feed", feed).join(member, ["product_id", "feed"], "left_anti").join(guard).where("safe").select(*KEY)


@query(
    "cdc_gate",
    """SELECT merchant_id, CASE WHEN n = 0 THEN 'empty' WHEN bad * 50 > n THEN 'rejects' WHEN n * 100 < 85 * (SELECT median(n) FROM (SELECT count(*) AS n FROM prices GROUP BY merchant_id)) THEN 'small' ELSE 'pass' END AS verdict
    FROM (SELECT merchant_id, count(*) AS n, count(*) FILTER (price > 1500000) AS bad FROM prices GROUP BY 1)""",
)
def cdc_gate(t: Tables) -> DataFrame:
    """A merchant's delivery passes, or fails by rejects or by size against the median delivery."""
    sizes = t.prices.groupBy("merchant_id").agg(F.count("*").alias("n"), F.count_if(F.col("price") > 1500000).alias("bad"))
    middle = sizes.agg(F.median("n").alias("middle"))
    verdict = F.expr("CASE WHEN n = 0 THEN 'empty' WHEN bad * 50 > n THEN 'rejects' WHEN n * 100 < 85 * middle THEN 'small' ELSE 'pass' END")
    return sizes.join(F.broadcast(middle)).select("merchant_id", verdict.alias("verdict"))


@query(
    "cdc_change_filter",
    f"""WITH {_SNAPSHOTS} SELECT count(*) FILTER (a.price IS NULL OR sha256(a.price || '|' || a.stock) <> sha256(b.price || '|' || b.stock)) AS changed, count(*) AS total FROM b LEFT JOIN a USING (product_id, merchant_id)""",
)
def cdc_change_filter(t: Tables) -> DataFrame:
    """Rows that a fingerprint comparison lets through."""
    mark = lambda c: F.sha2(F.concat_ws("|", F.col(c + ".price").cast("string"), F.col(c + ".stock").cast("string")), 256)
    changed = F.col("old").isNull() | (mark("old") != mark("new"))
    return both(t).where("new IS NOT NULL").agg(F.count_if(changed).alias("changed"), F.count("*").alias("total"))


@query(
    "cdc_variant_events",
    """SELECT point_id, product_id, merchant_id, in_stock FROM (SELECT *, lag(in_stock) OVER (PARTITION BY product_id, merchant_id ORDER BY day, point_id) AS before FROM prices) WHERE before IS DISTINCT FROM in_stock""",
)
def cdc_variant_events(t: Tables) -> DataFrame:
    """A stock event only where the state differs from the one before."""
    before = F.lag("in_stock").over(Window.partitionBy(*KEY).orderBy("day", "point_id"))
    return t.prices.withColumn("before", before).where("NOT (before <=> in_stock)").select("point_id", *KEY, "in_stock")


@query(
    "cdc_retention",
    """SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - CASE event_type WHEN 'view' THEN INTERVAL 7 DAY WHEN 'click' THEN INTERVAL 14 DAY ELSE INTERVAL 21 DAY END""",
)
def cdc_retention(t: Tables) -> DataFrame:
    """Events younger than their kind's retention."""
    now = t.events.agg(F.max("ts").alias("now"))
    days = F.expr("CASE event_type WHEN 'view' THEN INTERVAL 7 DAY WHEN 'click' THEN INTERVAL 14 DAY ELSE INTERVAL 21 DAY END")
    return t.events.join(F.broadcast(now)).where(F.col("ts") >= F.col("now") - days).select("event_id")


@query(
    "snk_outbox",
    f"""WITH {_SNAPSHOTS} SELECT DISTINCT product_id FROM b LEFT JOIN a USING (product_id, merchant_id) WHERE a.price IS DISTINCT FROM b.price""",
)
def snk_outbox(t: Tables) -> DataFrame:
    """Products whose indexed content changed."""
    return both(t).where("new IS NOT NULL AND NOT (old.price <=> new.price)").select("product_id").distinct()
