"""Joins: semi, anti, nested, as-of, calendar, lateral and self forms, as equi-joins and aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query


@query("join_inner_equi", "SELECT product_id, merchant_id, merchant, trust, price FROM offers JOIN merchants USING (merchant_id)")
def join_inner_equi(t: Tables) -> DataFrame:
    return t.offers.join(t.merchants, "merchant_id").select("product_id", "merchant_id", "merchant", "trust", "price")


@query(
    "join_left_dim",
    """SELECT p.product_id, brand, lo FROM products p LEFT JOIN (SELECT product_id, min(price) AS lo FROM offers WHERE in_stock GROUP BY 1) USING (product_id)""",
)
def join_left_dim(t: Tables) -> DataFrame:
    lows = t.offers.where("in_stock").groupBy("product_id").agg(F.min("price").alias("lo"))
    return t.products.join(lows, "product_id", "left").select("product_id", "brand", "lo")


@query(
    "join_nested_left",
    """SELECT p.product_id, count(o.merchant_id) AS live FROM products p LEFT JOIN
    (offers o JOIN merchants m ON m.merchant_id = o.merchant_id AND m.active) USING (product_id) GROUP BY 1""",
)
def join_nested_left(t: Tables) -> DataFrame:
    """The inner pair is joined first, so a product whose merchants are all inactive keeps an empty row."""
    pair = t.offers.join(t.merchants.where("active"), "merchant_id")
    return t.products.join(pair, "product_id", "left").groupBy("product_id").agg(F.count("merchant_id").alias("live"))


@query("join_semi", "SELECT product_id, title FROM products WHERE EXISTS (SELECT 1 FROM offers o WHERE o.product_id = products.product_id AND o.in_stock)")
def join_semi(t: Tables) -> DataFrame:
    return t.products.join(t.offers.where("in_stock"), "product_id", "left_semi").select("product_id", "title")


@query(
    "join_theta_semi",
    """SELECT product_id, catalog_price FROM products p WHERE EXISTS
    (SELECT 1 FROM offers o WHERE o.product_id = p.product_id AND o.in_stock AND o.price <= p.catalog_price * 95 // 100)""",
)
def join_theta_semi(t: Tables) -> DataFrame:
    """Alerts that fire: some offer reaches the target. The cheapest offer decides, so one row a product is joined."""
    low = t.offers.where("in_stock").groupBy("product_id").agg(F.min("price").alias("lo"))
    return t.products.join(low, "product_id").where("lo <= catalog_price * 95 div 100").select("product_id", "catalog_price")


@query("join_anti", "SELECT product_id FROM products ANTI JOIN (SELECT product_id FROM offers WHERE in_stock AND day >= (SELECT max(day) - 120 FROM prices)) USING (product_id)")
def join_anti(t: Tables) -> DataFrame:
    """Products without a fresh offer in stock."""
    newest = t.prices.agg(F.date_sub(F.max("day"), 120).alias("since"))
    fresh = t.offers.where("in_stock").join(newest).where("day >= since")
    return t.products.join(fresh, "product_id", "left_anti").select("product_id")


@query(
    "join_lateral_top1",
    """SELECT m.merchant_id, o.product_id, o.day FROM merchants m LEFT JOIN LATERAL
    (SELECT product_id, day FROM offers x WHERE x.merchant_id = m.merchant_id ORDER BY day DESC, point_id DESC LIMIT 1) o ON true""",
    dates="day",
)
def join_lateral_top1(t: Tables) -> DataFrame:
    last = t.offers.groupBy("merchant_id").agg(F.max(F.struct("day", "point_id", "product_id")).alias("o"))
    return t.merchants.join(last, "merchant_id", "left").select("merchant_id", "o.product_id", "o.day")


@query(
    "join_lateral_topk",
    """SELECT m.merchant_id, o.product_id, o.price FROM merchants m, LATERAL
    (SELECT product_id, price FROM offers x WHERE x.merchant_id = m.merchant_id ORDER BY price, product_id LIMIT 3) o""",
)
def join_lateral_topk(t: Tables) -> DataFrame:
    """The three cheapest offers of a merchant; Spark's window group limit keeps three rows a key before the shuffle."""
    order = Window.partitionBy("merchant_id").orderBy("price", "product_id")
    ranked = t.offers.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    return ranked.join(t.merchants.select("merchant_id"), "merchant_id").select("merchant_id", "product_id", "price")


@query(
    "join_lateral_agg",
    """SELECT o.product_id, o.merchant_id, s.seen, s.lo FROM offers o, LATERAL
    (SELECT count(*) AS seen, min(price) AS lo FROM prices p WHERE p.product_id = o.product_id AND p.merchant_id = o.merchant_id) s""",
)
def join_lateral_agg(t: Tables) -> DataFrame:
    own = t.prices.groupBy("product_id", "merchant_id").agg(F.count("*").alias("seen"), F.min("price").alias("lo"))
    return t.offers.select("product_id", "merchant_id").join(own, ["product_id", "merchant_id"])


@query(
    "join_lateral_unnest",
    """SELECT conv_id, turn, word FROM conversations LEFT JOIN LATERAL
    (SELECT unnest(list_filter(string_split(text, ' '), lambda w: len(w) > 12)) AS word) ON true""",
)
def join_lateral_unnest(t: Tables) -> DataFrame:
    """Long words of a message; a message without any keeps a row."""
    long_words = F.filter(F.split("text", " "), lambda w: F.length(w) > 12)
    return t.conversations.select("conv_id", "turn", F.explode_outer(long_words).alias("word"))


@query(
    "join_asof",
    """SELECT e.event_id, e.ts, coalesce(p.event_id, -1) AS prior_id FROM events e ASOF LEFT JOIN
    (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) p
    ON e.user_id = p.user_id AND p.ts <= e.ts WHERE e.event_type = 'purchase'""",
    dates="ts",
)
def join_asof(t: Tables) -> DataFrame:
    """The last view at or before each purchase: one sort of both sides by user and time, no range join."""
    both = t.events.where("event_type IN ('view', 'purchase')")
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    order = Window.partitionBy("user_id").orderBy("ts", F.expr("event_type = 'purchase'"), "event_id")
    told = both.withColumn("prior_id", F.last(view, ignorenulls=True).over(order))
    return told.where("event_type = 'purchase'").select("event_id", "ts", F.coalesce("prior_id", F.lit(-1)).alias("prior_id"))


@query(
    "join_asof_carry",
    """WITH d AS (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-01-31', INTERVAL 1 DAY))::DATE AS day),
    k AS (SELECT DISTINCT product_id FROM prices), n AS (SELECT product_id, day, arg_max(price, point_id) AS price FROM prices GROUP BY ALL)
    SELECT g.product_id, g.day, n.price FROM (SELECT product_id, d.day FROM k, d) g ASOF LEFT JOIN n ON n.product_id = g.product_id AND n.day <= g.day""",
    dates="day",
)
def join_asof_carry(t: Tables) -> DataFrame:
    """The last known price of every product on each day of a month, carried forward."""
    points = t.prices.where("day <= DATE '1998-01-31'")
    days = F.sequence(F.expr("DATE '1998-01-01'"), F.expr("DATE '1998-01-31'"))
    grid = t.prices.select("product_id").distinct().select("product_id", F.explode(days).alias("day"))
    rows = points.select("product_id", "day", "point_id", "price").unionByName(grid, allowMissingColumns=True)
    order = Window.partitionBy("product_id").orderBy("day", F.col("point_id").asc_nulls_last())
    return rows.withColumn("last", F.last("price", ignorenulls=True).over(order)).where("point_id IS NULL").select("product_id", "day", F.col("last").alias("price"))


@query(
    "join_fx_asof",
    """WITH r AS (SELECT merchant_id % 5 AS currency, day, max(price % 900 + 100) AS rate FROM prices WHERE day_of_month(day) % 3 = 0 GROUP BY 1, 2)
    SELECT p.point_id, coalesce(CASE WHEN p.day - r.day <= 4 THEN r.rate END, -1) AS rate FROM prices p ASOF LEFT JOIN r ON r.currency = p.merchant_id % 5 AND r.day <= p.day""".replace("day_of_month(day)", "extract(day FROM day)"),
)
def join_fx_asof(t: Tables) -> DataFrame:
    """The newest rate of a point's currency on or before its day, at most four days old.

    Five days at most can hold the answer, so every rate goes to the days it may serve and the newest wins there: an
    equi-join on currency and day.
    """
    rows = t.prices.withColumn("currency", F.col("merchant_id") % 5)
    rates = rows.where(F.dayofmonth("day") % 3 == 0).groupBy("currency", "day").agg(F.max(F.col("price") % 900 + 100).alias("rate"))
    serves = rates.select("currency", F.explode(F.sequence("day", F.date_add("day", 4))).alias("on"), "day", "rate")
    newest = serves.groupBy("currency", "on").agg(F.max_by("rate", "day").alias("rate")).withColumnRenamed("on", "day")
    return rows.join(newest, ["currency", "day"], "left").select("point_id", F.coalesce("rate", F.lit(-1)).alias("rate"))


@query(
    "join_range_calendar",
    """SELECT d.day, count(e.event_id) AS n FROM (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day) d
    LEFT JOIN events e ON e.ts::DATE = d.day AND e.event_type = 'purchase' GROUP BY 1""",
    dates="day",
)
def join_range_calendar(t: Tables) -> DataFrame:
    """Purchases of every day, days without any included."""
    bounds = t.events.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("day"))
    sold = t.events.where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(sold, "day", "left").fillna(0, ["n"])


@query(
    "join_prefix",
    """SELECT split_part(path, '/', 1) AS root, count(*) AS n, count(DISTINCT brand) AS brands FROM products GROUP BY 1""",
)
def join_prefix(t: Tables) -> DataFrame:
    root = F.split_part("path", F.lit("/"), F.lit(1))
    return t.products.groupBy(root.alias("root")).agg(F.count("*").alias("n"), F.countDistinct("brand").alias("brands"))


@query(
    "join_ordinality",
    """SELECT i AS place, p.product_id, title FROM (SELECT unnest([42, 7, 99, 3]) AS product_id, generate_subscripts([42, 7, 99, 3], 1) AS i) JOIN products p USING (product_id)""",
)
def join_ordinality(t: Tables) -> DataFrame:
    """Rows in the order that the caller gave their ids."""
    ids = t.spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in (42, 7, 99, 3)])).alias("i", "product_id"))
    return t.products.join(F.broadcast(ids), "product_id").select((F.col("i") + 1).alias("place"), "product_id", "title")


@query(
    "join_self_dup",
    """SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE lower(e.text) = lower(d.text) AND e.doc_id < d.doc_id)""",
)
def join_self_dup(t: Tables) -> DataFrame:
    """Rows with an equal folded text under a smaller id: the least id a text hash, then an equi-join, no self-theta."""
    keyed = t.documents.select("doc_id", F.sha2(F.lower("text"), 256).alias("key"))
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("least"))
    return keyed.join(least, "key").where("doc_id > least").select("doc_id")


@query(
    "join_merge",
    """WITH a AS (SELECT product_id, min(price) AS price FROM prices WHERE day < DATE '1997-06-01' GROUP BY 1),
    b AS (SELECT product_id, min(price) AS price FROM prices WHERE day >= DATE '1997-06-01' GROUP BY 1)
    SELECT coalesce(a.product_id, b.product_id) AS product_id, CASE WHEN a.product_id IS NULL THEN 'inserted' WHEN b.product_id IS NULL THEN 'missing'
    WHEN a.price IS DISTINCT FROM b.price THEN 'changed' ELSE 'unchanged' END AS state FROM a FULL JOIN b USING (product_id)""",
)
def join_merge(t: Tables) -> DataFrame:
    """Two snapshots side by side: inserted, missing, changed, unchanged."""
    low = lambda rows, c: rows.groupBy("product_id").agg(F.min("price").alias(c))
    both = low(t.prices.where("day < DATE '1997-06-01'"), "a").join(low(t.prices.where("day >= DATE '1997-06-01'"), "b"), "product_id", "full")
    state = F.when(F.col("a").isNull(), "inserted").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return both.select("product_id", state.alias("state"))


@query(
    "set_union_all",
    """SELECT DISTINCT product_id FROM (SELECT product_id FROM products WHERE brand = 'Brand#1' UNION ALL SELECT product_id FROM offers WHERE price < 50000)""",
)
def set_union_all(t: Tables) -> DataFrame:
    return t.products.where("brand = 'Brand#1'").select("product_id").union(t.offers.where("price < 50000").select("product_id")).distinct()


@query("set_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query(
    "gen_series",
    """SELECT s.day::DATE::VARCHAR AS day, coalesce(n, 0) AS orders FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM (
      SELECT min(o_orderdate)::DATE::TIMESTAMP AS lo, max(o_orderdate)::DATE::TIMESTAMP AS hi FROM orders)) s
    LEFT JOIN (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) o ON o.day = s.day::DATE""",
)
def gen_series(t: Tables) -> DataFrame:
    """Every day from the first order to the last, with its orders, days without any included."""
    days = t.orders.select(F.to_date("o_orderdate").alias("day"))
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo IS NOT NULL")
    series = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    counts = days.groupBy("day").agg(F.count("*").alias("n"))
    return series.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("orders"))


@query(
    "gen_recursive",
    """WITH RECURSIVE tree AS (SELECT 1::BIGINT AS id, 0 AS depth UNION ALL
    SELECT c.child, depth + 1 FROM tree JOIN (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1) c ON c.parent = tree.id WHERE depth < 6)
    SELECT id, depth FROM tree""",
)
def gen_recursive(t: Tables) -> DataFrame:
    """The closure of a parent column, level by level."""
    view = f"children_{uuid.uuid4().hex}"
    t.part.selectExpr("p_partkey AS child", "p_partkey div 2 AS parent").where("child > 1").createOrReplaceTempView(view)
    return t.spark.sql(f"""WITH RECURSIVE tree(id, depth) AS (SELECT 1L, 0 UNION ALL
        SELECT c.child, depth + 1 FROM tree JOIN {view} c ON c.parent = tree.id WHERE depth < 6) SELECT id, depth FROM tree""")
