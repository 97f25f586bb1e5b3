"""Window functions: best row of a key, ranks, gaps and jumps, deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query


@query(
    "win_best_offer",
    """SELECT product_id, merchant_id, price FROM (SELECT *, CASE WHEN local THEN price WHEN merchant_id % 9 <> 0 THEN floor(price * (90 + merchant_id % 20) / 100.0 + 0.5)::BIGINT END AS converted
      FROM offers JOIN merchants USING (merchant_id) WHERE active)
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY local DESC, converted NULLS LAST, merchant_id) = 1""",
)
def win_best_offer(t: Tables) -> DataFrame:
    """One offer a product: local before foreign, then the cheapest in local money (unknown rates last), then smallest id.

    A minimum over a struct combines map-side.
    """
    live = t.offers.join(t.merchants.where("active"), "merchant_id")
    rate = F.when(F.col("merchant_id") % 9 != 0, 90 + F.col("merchant_id") % 20)
    converted = F.when(F.col("local"), F.col("price")).otherwise(F.floor(F.col("price") * rate / 100.0 + 0.5))
    live = live.withColumn("converted", converted)
    best = F.min(F.struct((~F.col("local")).alias("abroad"), F.col("converted").isNull().alias("unknown"), "converted", "merchant_id", "price")).alias("o")
    return live.groupBy("product_id").agg(best).select("product_id", "o.merchant_id", "o.price")


@query(
    "win_distinct_image",
    """SELECT product_id, title, size FROM products QUALIFY row_number() OVER (PARTITION BY title ORDER BY size DESC, product_id) = 1""",
)
def win_distinct_image(t: Tables) -> DataFrame:
    best = F.min(F.struct((-F.col("size")).alias("rank"), "product_id", "size")).alias("o")
    return t.products.groupBy("title").agg(best).select("o.product_id", "title", "o.size")


@query(
    "win_top_thumbs",
    """SELECT brand, product_id, row_number() OVER (PARTITION BY brand ORDER BY catalog_price DESC, product_id) AS place FROM products QUALIFY place <= 4""",
)
def win_top_thumbs(t: Tables) -> DataFrame:
    order = Window.partitionBy("brand").orderBy(F.desc("catalog_price"), "product_id")
    return t.products.withColumn("place", F.row_number().over(order)).where("place <= 4").select("brand", "product_id", "place")


@query("win_total_count", "SELECT product_id, count(*) OVER () AS total FROM products WHERE size > 40 ORDER BY product_id LIMIT 20")
def win_total_count(t: Tables) -> DataFrame:
    """A page with the total: a separate count, so no row is moved for it."""
    found = t.products.where("size > 40")
    page = found.select("product_id").orderBy("product_id").limit(20)
    return page.join(F.broadcast(found.agg(F.count("*").alias("total"))))


@query(
    "win_last_two_runs",
    """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2""",
)
def win_last_two_runs(t: Tables) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("n", F.row_number().over(order)).where("n <= 2").select("user_id", "event_id")


@query(
    "win_sibling_stats",
    """SELECT product_id, row_number() OVER (PARTITION BY brand, size ORDER BY product_id) AS place,
    count(*) OVER (PARTITION BY brand, size) AS siblings, min(catalog_price) OVER (PARTITION BY brand, size) AS lo FROM products""",
)
def win_sibling_stats(t: Tables) -> DataFrame:
    group = Window.partitionBy("brand", "size")
    return t.products.select(
        "product_id",
        F.row_number().over(group.orderBy("product_id")).alias("place"),
        F.count("*").over(group).alias("siblings"),
        F.min("catalog_price").over(group).alias("lo"),
    )


@query(
    "win_state_samples",
    """SELECT o_orderstatus AS state, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 5""",
)
def win_state_samples(t: Tables) -> DataFrame:
    order = Window.partitionBy("state").orderBy("id")
    rows = t.orders.selectExpr("o_orderstatus AS state", "o_orderkey AS id")
    return rows.withColumn("n", F.row_number().over(order)).where("n <= 5").drop("n")


@query(
    "win_ever_granted",
    """SELECT user_id, event_id, ever FROM (SELECT *, bool_or(value > 99) OVER (PARTITION BY user_id) AS ever,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def win_ever_granted(t: Tables) -> DataFrame:
    """The newest row of a user with a flag over all of the user's rows: both are one aggregation."""
    last = F.max(F.struct("ts", "event_id")).alias("o")
    return t.events.groupBy("user_id").agg(last, F.bool_or(F.col("value") > 99).alias("ever")).select("user_id", "o.event_id", "ever")


@query(
    "win_daily_volume",
    """SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) <= 3""",
    dates="day",
)
def win_daily_volume(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).where("n <= 3")


@query(
    "win_stratified_sample",
    """SELECT brand, product_id FROM (SELECT brand, product_id, md5('seed' || product_id) AS h,
    row_number() OVER (PARTITION BY brand ORDER BY md5('seed' || product_id)) AS n FROM products) WHERE n <= 20 ORDER BY h LIMIT 100""",
)
def win_stratified_sample(t: Tables) -> DataFrame:
    """At most 20 rows a stratum, 100 in all, by a seeded hash: the sample is the feature and repeats exactly."""
    rows = t.products.select("brand", "product_id", F.md5(F.concat(F.lit("seed"), F.col("product_id").cast("string"))).alias("h"))
    own = Window.partitionBy("brand").orderBy("h")
    return rows.withColumn("n", F.row_number().over(own)).where("n <= 20").orderBy("h").limit(100).select("brand", "product_id")


@query(
    "smp_stratified_seeded",
    """SELECT path, product_id FROM products QUALIFY row_number() OVER (PARTITION BY path ORDER BY md5('7' || product_id), product_id) <= 3""",
)
def smp_stratified_seeded(t: Tables) -> DataFrame:
    order = Window.partitionBy("path").orderBy(F.md5(F.concat(F.lit("7"), F.col("product_id").cast("string"))), "product_id")
    return t.products.withColumn("n", F.row_number().over(order)).where("n <= 3").select("path", "product_id")


@query("smp_hash_split")
def smp_hash_split(t: Tables) -> DataFrame:
    """Development rows: a checksum of the id under 70 of 100."""
    part = F.crc32(F.col("product_id").cast("string").cast("binary")) % 100
    return t.products.select("product_id", F.when(part < 70, "dev").otherwise("eval").alias("split"))


@query(
    "win_dedupe_events",
    """SELECT user_id, event_type, ts, min(event_id) AS event_id FROM events GROUP BY ALL""",
    dates="ts",
)
def win_dedupe_events(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type", "ts").agg(F.min("event_id").alias("event_id"))


@query(
    "win_price_drops",
    """SELECT product_id, merchant_id, count(*) FILTER (price < before) AS drops, max(day) FILTER (price < before) AS last_drop FROM
    (SELECT *, lag(price) OVER (PARTITION BY product_id, merchant_id ORDER BY day, point_id) AS before FROM prices) GROUP BY ALL""",
    dates="last_drop",
)
def win_price_drops(t: Tables) -> DataFrame:
    own = Window.partitionBy("product_id", "merchant_id").orderBy("day", "point_id")
    fell = F.col("price") < F.lag("price").over(own)
    return t.prices.withColumn("fell", F.coalesce(fell, F.lit(False))).groupBy("product_id", "merchant_id").agg(
        F.count_if("fell").alias("drops"), F.max(F.when(F.col("fell"), F.col("day"))).alias("last_drop")
    )


@query(
    "win_list_jump",
    """SELECT product_id, merchant_id, day, list_price FROM
    (SELECT *, lag(list_price) OVER (PARTITION BY product_id, merchant_id ORDER BY day, point_id) AS before FROM prices) WHERE list_price * 100 >= before * 115""",
    dates="day",
)
def win_list_jump(t: Tables) -> DataFrame:
    """Rows whose list price rose by 15 percent or more over the row before."""
    own = Window.partitionBy("product_id", "merchant_id").orderBy("day", "point_id")
    jumped = t.prices.withColumn("before", F.lag("list_price").over(own)).where("list_price * 100 >= before * 115")
    return jumped.select("product_id", "merchant_id", "day", "list_price")


@query(
    "win_gaps",
    """WITH d AS (SELECT product_id, day, day - lag(day) OVER (PARTITION BY product_id ORDER BY day) AS gap FROM (SELECT DISTINCT product_id, day FROM prices)),
    m AS (SELECT product_id, list_sort(list(gap))[count(gap) // 2 + 1] AS middle FROM d WHERE gap IS NOT NULL GROUP BY 1)
    SELECT product_id, day, gap FROM d JOIN m USING (product_id) WHERE gap > greatest(3, 2 * middle)""",
    dates="day",
)
def win_gaps(t: Tables) -> DataFrame:
    """Gaps longer than three days and twice the upper median of a product's gaps."""
    days = t.prices.select("product_id", "day").distinct()
    order = Window.partitionBy("product_id").orderBy("day")
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(order))).where("gap IS NOT NULL")
    middle = gaps.groupBy("product_id").agg(F.sort_array(F.collect_list("gap")).alias("g")).select(
        "product_id", F.expr("g[size(g) div 2]").alias("middle")
    )
    return gaps.join(middle, "product_id").where("gap > greatest(3, 2 * middle)").select("product_id", "day", "gap")


@query(
    "topk_order",
    """SELECT product_id, lo FROM products JOIN (SELECT product_id, min(price) AS lo, bool_or(in_stock) AS stock FROM offers GROUP BY 1) USING (product_id)
    ORDER BY stock DESC, lo, product_id LIMIT 50""",
)
def topk_order(t: Tables) -> DataFrame:
    lows = t.offers.groupBy("product_id").agg(F.min("price").alias("lo"), F.bool_or("in_stock").alias("stock"))
    return t.products.join(lows, "product_id").orderBy(F.desc("stock"), F.asc_nulls_last("lo"), "product_id").limit(50).select("product_id", "lo")


@query("topk_offset", "SELECT product_id FROM products ORDER BY catalog_price DESC, product_id LIMIT 20 OFFSET 40")
def topk_offset(t: Tables) -> DataFrame:
    return t.products.orderBy(F.desc("catalog_price"), "product_id").offset(40).limit(20).select("product_id")


@query(
    "topk_keyset",
    """SELECT event_id, ts FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20 00:00:00', 0) ORDER BY ts DESC, event_id DESC LIMIT 26""",
    dates="ts",
)
def topk_keyset(t: Tables) -> DataFrame:
    """The page after a key, with one row more to see whether another follows."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    before = (F.col("ts") < at) | ((F.col("ts") == at) & (F.col("event_id") < 0))
    return t.events.where(before).orderBy(F.desc("ts"), F.desc("event_id")).limit(26).select("event_id", "ts")


@query(
    "topk_rotation",
    """SELECT product_id, n FROM (SELECT product_id, row_number() OVER (ORDER BY catalog_price DESC, product_id) - 1 AS n FROM
    (SELECT * FROM products ORDER BY catalog_price DESC, product_id LIMIT 200)) WHERE (n - 140 + 200) % 200 < 20""",
)
def topk_rotation(t: Tables) -> DataFrame:
    """Today's 20 slots of a pool of 200 that turns with the day and wraps around."""
    pool = t.products.orderBy(F.desc("catalog_price"), "product_id").limit(200)
    ranked = pool.select("product_id", (F.row_number().over(Window.orderBy(F.desc("catalog_price"), "product_id")) - 1).alias("n"))
    return ranked.where("(n - 140 + 200) % 200 < 20")


@query(
    "topk_homepage",
    """WITH pool AS (SELECT product_id, path, md5(product_id || '1998-12-01') AS h FROM products ORDER BY catalog_price, product_id LIMIT 1000)
    SELECT product_id, path, row_number() OVER (PARTITION BY path ORDER BY h) AS round FROM pool ORDER BY round, h LIMIT 40""",
)
def topk_homepage(t: Tables) -> DataFrame:
    """The cheapest thousand, shuffled by day, dealt one category at a time."""
    shuffled = F.md5(F.concat(F.col("product_id").cast("string"), F.lit("1998-12-01")))
    pool = t.products.orderBy("catalog_price", "product_id").limit(1000).select("product_id", "path", shuffled.alias("h"))
    dealt = pool.withColumn("round", F.row_number().over(Window.partitionBy("path").orderBy("h")))
    return dealt.orderBy("round", "h").limit(40).select("product_id", "path", "round")


@query(
    "st_recent_views",
    """SELECT user_id, item, seen FROM (SELECT user_id, (event_id % 40) AS item, max(ts) AS seen FROM events WHERE event_type = 'view' GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, item) <= 5""",
    dates="seen",
)
def st_recent_views(t: Tables) -> DataFrame:
    views = t.events.where("event_type = 'view'").groupBy("user_id", (F.col("event_id") % 40).alias("item")).agg(F.max("ts").alias("seen"))
    order = Window.partitionBy("user_id").orderBy(F.desc("seen"), "item")
    return views.withColumn("n", F.row_number().over(order)).where("n <= 5").drop("n")
