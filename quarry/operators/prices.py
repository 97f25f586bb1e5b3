"""Price history: statistics, inflated discounts, history views, comparison and conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query


def _own():
    """The observations of one offer in order."""
    return Window.partitionBy("product_id", "merchant_id").orderBy("day", "point_id")


@query(
    "ts_price_stats",
    """WITH r AS (SELECT *, max(day) OVER (PARTITION BY product_id) AS newest, lag(price) OVER (PARTITION BY product_id, merchant_id ORDER BY day, point_id) AS before FROM prices),
    d AS (SELECT product_id, max(c) AS drops FROM (SELECT product_id, merchant_id, count(*) FILTER (price < before) AS c FROM r GROUP BY ALL) GROUP BY 1),
    s AS (SELECT product_id, min(price) FILTER (day > newest - 30) AS min_30, min(price) AS lo, max(price) AS hi, floor(median(price))::BIGINT AS middle,
      arg_max(price, (day, point_id)) AS current, count(*) AS n, count(DISTINCT price) AS kinds, max(day) - min(day) AS span FROM r GROUP BY 1)
    SELECT product_id, min_30, lo, hi, middle, drops, CASE WHEN n >= 5 AND kinds >= 2 AND span >= 7 THEN round_even(100.0 * below / n, 0)::INT ELSE -1 END AS percentile
    FROM s JOIN d USING (product_id) JOIN (SELECT p.product_id, count(*) FILTER (p.price < s.current) AS below FROM prices p JOIN s USING (product_id) GROUP BY 1) USING (product_id)""",
)
def ts_price_stats(t: Tables) -> DataFrame:
    """Low of the 30 days up to the newest observation, range, median, drops of the busiest offer, percentile of the current price (-1: unknown)."""
    per_offer = t.prices.withColumn("fell", (F.col("price") < F.lag("price").over(_own())).cast("int"))
    drops = per_offer.groupBy("product_id", "merchant_id").agg(F.coalesce(F.sum("fell"), F.lit(0)).alias("c")).groupBy("product_id").agg(F.max("c").alias("drops"))
    whole = t.prices.groupBy("product_id").agg(
        F.min("price").alias("lo"),
        F.max("price").alias("hi"),
        F.floor(F.median("price")).alias("middle"),
        F.max_by("price", F.struct("day", "point_id")).alias("current"),
        F.count("*").alias("n"),
        F.countDistinct("price").alias("kinds"),
        F.max("day").alias("newest"),
        F.datediff(F.max("day"), F.min("day")).alias("span"),
    )
    again = t.prices.join(whole, "product_id").groupBy("product_id").agg(
        F.min(F.when(F.col("day") > F.date_sub("newest", 30), F.col("price"))).alias("min_30"),
        F.count_if(F.col("price") < F.col("current")).alias("below"),
    )
    enough = F.expr("n >= 5 AND kinds >= 2 AND span >= 7")
    share = F.when(enough, F.bround(F.lit(100.0) * F.col("below") / F.col("n"), 0).cast("int")).otherwise(-1)
    return whole.join(again, "product_id").join(drops, "product_id").select("product_id", "min_30", "lo", "hi", "middle", "drops", share.alias("percentile"))


@query(
    "ts_inflated",
    """WITH r AS (SELECT * FROM (SELECT * REPLACE (merchant_id % 3 AS merchant_id) FROM prices) WHERE price > 0 AND list_price > 0 QUALIFY count(*) OVER (PARTITION BY product_id, merchant_id) >= 3),
    j AS (SELECT *, lag(list_price) OVER w AS list0, lag(price) OVER w AS price0 FROM r WINDOW w AS (PARTITION BY product_id, merchant_id ORDER BY day, point_id))
    SELECT DISTINCT j.product_id FROM j JOIN r l ON l.product_id = j.product_id AND l.merchant_id = j.merchant_id AND l.day BETWEEN j.day AND j.day + 21
      AND (l.day, l.point_id) >= (j.day, j.point_id)
    WHERE j.list_price * 100 >= j.list0 * 115 AND l.price < j.price AND (l.list_price - l.price) * j.list0 * 10 - (j.list0 - j.price0) * l.list_price * 10 >= l.list_price * j.list0""",
)
def ts_inflated(t: Tables) -> DataFrame:
    """Products with an offer (of one of three seller groups, so that series are dense enough) whose list price jumped 15 percent and whose price then fell within 21 days while the
    shown discount grew by a tenth or more."""
    size = F.count("*").over(Window.partitionBy("product_id", "merchant_id"))
    rows = t.prices.withColumn("merchant_id", F.col("merchant_id") % 3).where("price > 0 AND list_price > 0").withColumn("size", size).where("size >= 3")
    jumps = rows.withColumns({"list0": F.lag("list_price").over(_own()), "price0": F.lag("price").over(_own())}).where("list_price * 100 >= list0 * 115")
    jumps = jumps.select("product_id", "merchant_id", F.col("day").alias("d"), F.col("point_id").alias("p"), F.col("price").alias("price1"), "list0", "price0")
    later = rows.join(jumps, ["product_id", "merchant_id"]).where("day BETWEEN d AND date_add(d, 21) AND (day > d OR point_id >= p) AND price < price1")
    gain = "(list_price - price) * list0 * 10 - (list0 - price0) * list_price * 10 >= list_price * list0"
    return later.where(gain).select("product_id").distinct()


@query(
    "ts_history_view",
    """SELECT product_id, min(price) AS lo, max(price) AS hi, arg_min(day, (price, day)) AS lo_day, CASE WHEN count(*) >= 3 THEN floor(avg(price) + 0.5)::BIGINT ELSE -1 END AS mean,
    arg_max(price, (day, point_id)) - arg_min(price, (day, point_id)) AS change FROM prices WHERE day > DATE '1998-12-01' - 365 GROUP BY 1""",
    dates="lo_day",
)
def ts_history_view(t: Tables) -> DataFrame:
    recent = t.prices.where("day > DATE '1998-12-01' - INTERVAL 365 DAY")
    order = F.struct("day", "point_id")
    return recent.groupBy("product_id").agg(
        F.min("price").alias("lo"),
        F.max("price").alias("hi"),
        F.min_by("day", F.struct("price", "day")).alias("lo_day"),
        F.when(F.count("*") >= 3, F.floor(F.avg("price") + 0.5)).otherwise(-1).alias("mean"),
        (F.max_by("price", order) - F.min_by("price", order)).alias("change"),
    )


@query(
    "ts_variant_merge",
    """WITH d AS (SELECT product_id, merchant_id % 2 AS merchant_id, date_trunc('month', day)::DATE AS day, min(price) AS price FROM prices GROUP BY ALL),
    n AS (SELECT product_id, count(DISTINCT merchant_id) AS offers FROM d GROUP BY 1)
    SELECT d.product_id, day, min(price) AS price FROM d JOIN n USING (product_id) GROUP BY d.product_id, day, offers HAVING count(*) = offers""",
    dates="day",
)
def ts_variant_merge(t: Tables) -> DataFrame:
    """Months in which every group of offers of a product has a price, with the lowest of them."""
    month, group = F.trunc("day", "month").alias("day"), (F.col("merchant_id") % 2).alias("merchant_id")
    daily = t.prices.groupBy("product_id", group, month).agg(F.min("price").alias("price"))
    offers = daily.groupBy("product_id").agg(F.countDistinct("merchant_id").alias("offers"))
    merged = daily.groupBy("product_id", "day").agg(F.min("price").alias("price"), F.count("*").alias("n"))
    return merged.join(offers, "product_id").where("n = offers").select("product_id", "day", "price")


@query(
    "ts_lowest_claim",
    """SELECT product_id, arg_max(price, (day, point_id)) <= min(price) AND max(day) - min(day) >= 89 AS lowest FROM prices GROUP BY 1""",
)
def ts_lowest_claim(t: Tables) -> DataFrame:
    current = F.max_by("price", F.struct("day", "point_id"))
    wide = F.datediff(F.max("day"), F.min("day")) >= 89
    return t.prices.groupBy("product_id").agg(((current <= F.min("price")) & wide).alias("lowest"))


@query(
    "ts_price_change",
    """SELECT product_id, merchant_id, floor((200.0 * (price - list_price) + list_price) / (2.0 * list_price))::BIGINT AS percent FROM offers WHERE list_price > 0""",
)
def ts_price_change(t: Tables) -> DataFrame:
    percent = F.floor((F.lit(200.0) * (F.col("price") - F.col("list_price")) + F.col("list_price")) / (F.lit(2.0) * F.col("list_price")))
    return t.offers.where("list_price > 0").select("product_id", "merchant_id", percent.alias("percent"))


@query(
    "ts_compare_offers",
    """SELECT product_id, merchant_id, price + CASE WHEN price >= 500000 THEN 0 ELSE 4990 END AS total,
    row_number() OVER (PARTITION BY product_id ORDER BY price + CASE WHEN price >= 500000 THEN 0 ELSE 4990 END, trust DESC, merchant_id) AS place
    FROM offers JOIN merchants USING (merchant_id)""",
)
def ts_compare_offers(t: Tables) -> DataFrame:
    """Totals with shipping, free from a threshold on; ties go to trust, then id."""
    total = F.col("price") + F.when(F.col("price") >= 500000, 0).otherwise(4990)
    rows = t.offers.join(t.merchants, "merchant_id").withColumn("total", total)
    order = Window.partitionBy("product_id").orderBy("total", F.desc("trust"), "merchant_id")
    return rows.select("product_id", "merchant_id", "total", F.row_number().over(order).alias("place"))


@query(
    "ts_fx_convert",
    """SELECT product_id, merchant_id, ((price::HUGEINT * (3245000000 + merchant_id * 1000) + 50000000) // 100000000)::BIGINT AS converted FROM offers""",
)
def ts_fx_convert(t: Tables) -> DataFrame:
    """Minor units times a rate scaled by 1e8, half up, in integers."""
    rate = F.lit(3245000000) + F.col("merchant_id") * 1000
    exact = (F.col("price").cast("decimal(20,0)") * rate.cast("decimal(17,0)") + 50000000) / F.lit(100000000).cast("decimal(9,0)")
    return t.offers.select("product_id", "merchant_id", F.floor(exact).cast("long").alias("converted"))


@query(
    "ts_feed_freshness",
    """SELECT merchant_id, CASE WHEN o.newest IS NULL THEN 'never' WHEN o.newest > DATE '1998-12-01' THEN 'invalid' WHEN o.newest >= DATE '1998-12-01' - 14 THEN 'current'
    WHEN o.newest >= DATE '1998-12-01' - 60 THEN 'behind' ELSE 'stale' END AS state FROM merchants LEFT JOIN (SELECT merchant_id, max(day) AS newest FROM prices GROUP BY 1) o USING (merchant_id)""",
)
def ts_feed_freshness(t: Tables) -> DataFrame:
    newest = t.prices.groupBy("merchant_id").agg(F.max("day").alias("newest"))
    state = F.expr(
        "CASE WHEN newest IS NULL THEN 'never' WHEN newest > DATE '1998-12-01' THEN 'invalid' WHEN newest >= DATE '1998-11-17' THEN 'current' "
        "WHEN newest >= DATE '1998-10-02' THEN 'behind' ELSE 'stale' END"
    )
    return t.merchants.join(newest, "merchant_id", "left").select("merchant_id", state.alias("state"))


@query(
    "topk_deals",
    """WITH m AS (SELECT product_id, floor(median(price))::BIGINT AS middle FROM prices WHERE day > DATE '1998-12-01' - 365 GROUP BY 1)
    SELECT product_id, merchant_id, price, middle, (middle - price) * 100 // middle AS saved FROM offers JOIN m USING (product_id)
    WHERE price < middle AND in_stock ORDER BY saved DESC, product_id, merchant_id LIMIT 40""",
)
def topk_deals(t: Tables) -> DataFrame:
    recent = t.prices.where("day > DATE '1998-12-01' - INTERVAL 365 DAY")
    middle = recent.groupBy("product_id").agg(F.floor(F.median("price")).alias("middle"))
    rows = t.offers.where("in_stock").join(middle, "product_id").where("price < middle").withColumn("saved", F.expr("(middle - price) * 100 div middle"))
    return rows.orderBy(F.desc("saved"), "product_id", "merchant_id").limit(40).select("product_id", "merchant_id", "price", "middle", "saved")


@query(
    "num_unit_price",
    """SELECT product_id, floor(catalog_price * 100.0 / size + 0.5)::BIGINT AS unit_price FROM products WHERE size > 0""",
)
def num_unit_price(t: Tables) -> DataFrame:
    return t.products.where("size > 0").select("product_id", F.floor(F.col("catalog_price") * F.lit(100.0) / F.col("size") + 0.5).alias("unit_price"))


@query(
    "flt_price_jump",
    """SELECT point_id FROM (SELECT *, lag(price) OVER (PARTITION BY product_id, merchant_id ORDER BY day, point_id) AS before FROM prices) WHERE price > before * 5 OR price * 5 < before""",
)
def flt_price_jump(t: Tables) -> DataFrame:
    return t.prices.withColumn("before", F.lag("price").over(_own())).where("price > before * 5 OR price * 5 < before").select("point_id")


@query(
    "flt_category_subtree",
    "SELECT product_id, path FROM products WHERE path = 'economy' OR path LIKE 'economy/%'",
)
def flt_category_subtree(t: Tables) -> DataFrame:
    return t.products.where((F.col("path") == "economy") | F.col("path").startswith("economy/")).select("product_id", "path")


@query(
    "flt_catalog",
    """SELECT product_id FROM products p WHERE path LIKE 'standard/%' AND (brand IS NULL OR brand NOT IN ('Brand#1', 'Brand#2'))
    AND EXISTS (SELECT 1 FROM offers o WHERE o.product_id = p.product_id AND o.in_stock AND o.price BETWEEN 50000 AND 200000)""",
)
def flt_catalog(t: Tables) -> DataFrame:
    """A subtree, without two brands but with unbranded products, shown at a price in range."""
    shown = t.offers.where("in_stock AND price BETWEEN 50000 AND 200000")
    wanted = t.products.where(F.col("path").startswith("standard/") & ~F.coalesce(F.col("brand").isin("Brand#1", "Brand#2"), F.lit(False)))
    return wanted.join(shown, "product_id", "left_semi").select("product_id")


@query(
    "flt_product_verifiable",
    """SELECT p.product_id, coalesce(bool_or(o.day >= DATE '1998-06-01'), true) AS verifiable FROM products p LEFT JOIN offers o USING (product_id) GROUP BY 1""",
)
def flt_product_verifiable(t: Tables) -> DataFrame:
    fresh = t.offers.groupBy("product_id").agg(F.bool_or(F.expr("day >= DATE '1998-06-01'")).alias("v"))
    return t.products.join(fresh, "product_id", "left").select("product_id", F.coalesce("v", F.lit(True)).alias("verifiable"))
