"""Aggregations over the catalog: filtered, distinct, two-level, percentile and array forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query


@query(
    "agg_product_prices",
    """SELECT p.product_id, min(o.price) FILTER (m.local) AS min_price, max(o.price) FILTER (m.local) AS max_price,
    count(DISTINCT o.merchant_id) FILTER (m.local) AS local_merchants,
    count(DISTINCT o.merchant_id) FILTER (m.local AND o.in_stock) AS local_in_stock,
    count(DISTINCT o.merchant_id) FILTER (NOT m.local) AS foreign_merchants
    FROM products p LEFT JOIN (offers o JOIN merchants m ON m.merchant_id = o.merchant_id AND m.active) USING (product_id)
    GROUP BY p.product_id""",
)
def agg_product_prices(t: Tables) -> DataFrame:
    """Price range and merchant counts of each product; products without an active merchant keep a row."""
    live = t.offers.join(t.merchants.where("active"), "merchant_id")
    own = live.groupBy("product_id").agg(
        F.min(F.when(F.col("local"), F.col("price"))).alias("min_price"),
        F.max(F.when(F.col("local"), F.col("price"))).alias("max_price"),
        F.count_if("local").alias("local_merchants"),
        F.count_if(F.col("local") & F.col("in_stock")).alias("local_in_stock"),
        F.count_if(~F.col("local")).alias("foreign_merchants"),
    )  # an offer is unique by product and merchant, so counting rows counts merchants
    counts = ["local_merchants", "local_in_stock", "foreign_merchants"]
    return t.products.select("product_id").join(own, "product_id", "left").fillna(0, counts)


@query(
    "agg_changed_only",
    """SELECT n.product_id, n.lo, n.hi, n.c FROM
    (SELECT product_id, min(price) AS lo, max(price) AS hi, count(*) AS c FROM prices GROUP BY 1) n LEFT JOIN
    (SELECT product_id, min(price) AS lo, max(price) AS hi, count(*) AS c FROM prices WHERE day < DATE '1998-06-01' GROUP BY 1) b
    USING (product_id) WHERE (n.lo, n.hi, n.c) IS DISTINCT FROM (b.lo, b.hi, b.c)""",
)
def agg_changed_only(t: Tables) -> DataFrame:
    """Price summaries that differ from the ones before a day, compared null-safe as a whole."""

    def summary(points: DataFrame) -> DataFrame:
        return points.groupBy("product_id").agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.count("*").alias("c"))

    before = summary(t.prices.where("day < DATE '1998-06-01'")).toDF("product_id", "b_lo", "b_hi", "b_c")
    both = summary(t.prices).join(before, "product_id", "left")
    same = F.struct("lo", "hi", "c").eqNullSafe(F.struct(F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), F.col("b_c").alias("c")))
    return both.where(~same).select("product_id", "lo", "hi", "c")


@query(
    "agg_filtered_counts",
    """SELECT count(*) AS offers, count(*) FILTER (in_stock) AS in_stock, count(*) FILTER (day >= DATE '1998-09-01') AS fresh,
    count(*) FILTER (price < list_price) AS discounted, count(*) FILTER (price <= 0) AS bad_price FROM offers""",
)
def agg_filtered_counts(t: Tables) -> DataFrame:
    return t.offers.agg(
        F.count("*").alias("offers"),
        F.count_if("in_stock").alias("in_stock"),
        F.count_if(F.expr("day >= DATE '1998-09-01'")).alias("fresh"),
        F.count_if(F.expr("price < list_price")).alias("discounted"),
        F.count_if(F.expr("price <= 0")).alias("bad_price"),
    )


@query(
    "agg_daily_min",
    """SELECT product_id, day, min(price) AS price FROM prices SEMI JOIN (SELECT merchant_id FROM merchants WHERE local) USING (merchant_id)
    WHERE day > DATE '1998-12-01' - 365 GROUP BY ALL""",
    dates="day",
)
def agg_daily_min(t: Tables) -> DataFrame:
    """Cheapest local price of each product and day over the last year."""
    local = t.merchants.where("local").select("merchant_id")
    recent = t.prices.where("day > DATE '1998-12-01' - INTERVAL 365 DAY")
    return recent.join(local, "merchant_id", "left_semi").groupBy("product_id", "day").agg(F.min("price").alias("price"))


@query(
    "agg_daily_min_fx",
    """SELECT country, product_id, day, min(price) AS price FROM prices JOIN merchants USING (merchant_id)
    WHERE NOT local AND price > 0 AND country = 'NATION_7' GROUP BY ALL""",
    dates="day",
)
def agg_daily_min_fx(t: Tables) -> DataFrame:
    abroad = t.merchants.where("NOT local AND country = 'NATION_7'").select("merchant_id", "country")
    return t.prices.where("price > 0").join(abroad, "merchant_id").groupBy("country", "product_id", "day").agg(F.min("price").alias("price"))


@query(
    "agg_day_operation_cost",
    """SELECT (ts + INTERVAL 3 HOUR)::DATE AS day, event_type AS operation, count(*) AS calls, count(*) FILTER (event_id % 4 = 0) AS cache_hits, count(*) FILTER (value IS NULL) AS unpriced,
    sum(floor(value * 100)::BIGINT)::BIGINT AS cost, sum(coalesce(TRY_CAST(props->>'$.k' AS BIGINT), 0))::BIGINT AS units FROM events GROUP BY ALL""",
    dates="day",
)
def agg_day_operation_cost(t: Tables) -> DataFrame:
    local = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Istanbul"))
    return t.events.groupBy(local.alias("day"), F.col("event_type").alias("operation")).agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("event_id") % 4 == 0).alias("cache_hits"),
        F.sum(F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))).alias("units"),
        F.count_if(F.col("value").isNull()).alias("unpriced"),
        F.sum(F.floor(F.col("value") * 100)).alias("cost"),
    )


@query(
    "agg_percentile_disc",
    """SELECT event_type, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, count(*) AS n FROM events GROUP BY event_type""",
)
def agg_percentile_disc(t: Tables) -> DataFrame:
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    return t.events.groupBy("event_type").agg(p95.alias("p95"), F.count("*").alias("n"))


@query(
    "agg_percentile_cont",
    """SELECT lang, quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90
    FROM documents GROUP BY lang""",
)
def agg_percentile_cont(t: Tables) -> DataFrame:
    cut = lambda p: F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY n_chars)").alias(f"p{int(p * 100)}")
    return t.documents.groupBy("lang").agg(cut(0.1), cut(0.5), cut(0.9))


@query(
    "agg_latest_array",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type,
    arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS last_purchase FROM events GROUP BY user_id""",
)
def agg_latest_array(t: Tables) -> DataFrame:
    """The value of the newest row, once over all rows and once over a filtered part."""
    order = F.struct("ts", "event_id")
    bought = F.when(F.col("event_type") == "purchase", order)
    return t.events.groupBy("user_id").agg(F.max_by("event_type", order).alias("last_type"), F.max_by("value", bought).alias("last_purchase"))


@query(
    "agg_distinct_array",
    """SELECT product_id, array_to_string(list_sort(list_distinct(list(merchant_id)))[1:3], ',') AS merchants FROM offers GROUP BY product_id""",
)
def agg_distinct_array(t: Tables) -> DataFrame:
    first = F.slice(F.array_sort(F.collect_set("merchant_id")), 1, 3)
    return t.offers.groupBy("product_id").agg(F.array_join(first, ",").alias("merchants"))


@query(
    "agg_json_object",
    """SELECT n_regionkey AS region, '{' || string_agg('"' || n_name || '":' || c, ',' ORDER BY n_name) || '}' AS counts FROM
    (SELECT n_regionkey, n_name, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1""",
)
def agg_json_object(t: Tables) -> DataFrame:
    counts = t.supplier.join(F.broadcast(t.nation), F.expr("s_nationkey = n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.count("*").alias("c"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "c"))))
    return counts.groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(pairs).alias("counts"))


@query(
    "agg_two_level_capped",
    """SELECT event_type, count(*) AS users, sum(least(c, 10))::BIGINT AS events FROM
    (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY ALL) GROUP BY event_type""",
)
def agg_two_level_capped(t: Tables) -> DataFrame:
    """Each user adds at most ten events to a cell."""
    own = t.events.groupBy("event_type", "user_id").agg(F.least(F.count("*"), F.lit(10)).alias("c"))
    return own.groupBy("event_type").agg(F.count("*").alias("users"), F.sum("c").alias("events"))


@query(
    "agg_having_dups",
    """SELECT title, count(*) AS n, array_to_string(list_sort(list(product_id))[1:5], ',') AS first_ids FROM products
    GROUP BY title HAVING count(*) > 1""",
)
def agg_having_dups(t: Tables) -> DataFrame:
    ids = F.array_join(F.slice(F.array_sort(F.collect_list("product_id")), 1, 5), ",")
    return t.products.groupBy("title").agg(F.count("*").alias("n"), ids.alias("first_ids")).where("n > 1")


@query("agg_bool", "SELECT product_id, bool_or(in_stock) AS any_stock, bool_and(in_stock) AS all_stock FROM offers GROUP BY product_id")
def agg_bool(t: Tables) -> DataFrame:
    return t.offers.groupBy("product_id").agg(F.bool_or("in_stock").alias("any_stock"), F.bool_and("in_stock").alias("all_stock"))


@query(
    "agg_score_bands",
    """SELECT CASE WHEN trust >= 90 THEN 'high' WHEN trust >= 63 THEN 'middle' ELSE 'low' END AS band, count(*) FILTER (active) AS accepted,
    count(*) FILTER (NOT active) AS rejected FROM merchants GROUP BY 1""",
)
def agg_score_bands(t: Tables) -> DataFrame:
    band = F.when(F.col("trust") >= 90, "high").when(F.col("trust") >= 63, "middle").otherwise("low")
    return t.merchants.groupBy(band.alias("band")).agg(F.count_if("active").alias("accepted"), F.count_if(~F.col("active")).alias("rejected"))


@query("agg_capped_count", "SELECT least(count(*), 101) AS n, count(*) > 100 AS capped FROM offers WHERE in_stock")
def agg_capped_count(t: Tables) -> DataFrame:
    """Counts no further than one past the cap: the scan stops early."""
    return t.offers.where("in_stock").limit(101).agg(F.count("*").alias("n"), (F.count("*") > 100).alias("capped"))


@query(
    "agg_catalog_counts",
    """SELECT count(*) AS products, count(*) FILTER (brand IS NULL) AS no_brand, count(*) FILTER (size < 5) AS small,
    count(*) FILTER (o.product_id IS NULL) AS no_offer FROM products p LEFT JOIN (SELECT DISTINCT product_id FROM offers) o USING (product_id)""",
)
def agg_catalog_counts(t: Tables) -> DataFrame:
    offered = t.offers.select("product_id").distinct().withColumn("offered", F.lit(True))
    return t.products.join(offered, "product_id", "left").agg(
        F.count("*").alias("products"),
        F.count_if(F.col("brand").isNull()).alias("no_brand"),
        F.count_if(F.col("size") < 5).alias("small"),
        F.count_if(F.col("offered").isNull()).alias("no_offer"),
    )


@query(
    "agg_failures_since",
    """WITH ok AS (SELECT user_id, max(ts) AS last_ok FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT user_id, count(*) FILTER (last_ok IS NULL OR ts > last_ok) AS since FROM events LEFT JOIN ok USING (user_id)
    WHERE event_type <> 'purchase' GROUP BY 1""",
)
def agg_failures_since(t: Tables) -> DataFrame:
    """Events after each user's last purchase."""
    last = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last_ok"))
    later = F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok"))
    return t.events.where("event_type <> 'purchase'").join(last, "user_id", "left").groupBy("user_id").agg(F.count_if(later).alias("since"))


@query(
    "agg_consent_latest",
    """SELECT event_type, count(*) FILTER (v > 50) AS granted, count(*) FILTER (v <= 50) AS denied FROM
    (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL) GROUP BY 1""",
)
def agg_consent_latest(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return last.groupBy("event_type").agg(F.count_if(F.col("v") > 50).alias("granted"), F.count_if(F.col("v") <= 50).alias("denied"))


@query(
    "agg_quota_usage",
    """SELECT user_id, coalesce(sum(floor(value)::BIGINT) FILTER (ts >= date_trunc('week', (SELECT max(ts) FROM events))), 0)::BIGINT AS week,
    coalesce(sum(floor(value)::BIGINT) FILTER (ts >= date_trunc('month', (SELECT max(ts) FROM events))), 0)::BIGINT AS month FROM events GROUP BY user_id""",
)
def agg_quota_usage(t: Tables) -> DataFrame:
    """Use of the current week and month; now is the newest event."""
    now = t.events.agg(F.max("ts").alias("now"))
    cost = F.floor("value")
    inside = lambda unit: F.sum(F.when(F.col("ts") >= F.date_trunc(unit, "now").cast("timestamp_ntz"), cost).otherwise(0))
    return t.events.join(F.broadcast(now)).groupBy("user_id").agg(inside("week").alias("week"), inside("month").alias("month"))


@query(
    "agg_fx_by_program",
    """SELECT brand, CASE WHEN count(DISTINCT size) = 1 THEN min(size) END AS only_size, count(DISTINCT size) AS sizes FROM products GROUP BY brand""",
)
def agg_fx_by_program(t: Tables) -> DataFrame:
    """A value only where it is unambiguous."""
    sizes = F.countDistinct("size")
    return t.products.groupBy("brand").agg(F.when(sizes == 1, F.min("size")).alias("only_size"), sizes.alias("sizes"))


@query(
    "agg_form_choice",
    """SELECT r_name AS choice, count(c_custkey) AS picks, floor(count(c_custkey) * 1000 / (SELECT count(*) FROM customer) + 0.5) / 10 AS percent
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""",
)
def agg_form_choice(t: Tables) -> DataFrame:
    """Choices with their picks; a choice nobody made keeps a row."""
    picks = t.customer.join(F.broadcast(t.nation), F.expr("c_nationkey = n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("picks"))
    total = picks.agg(F.sum("picks").alias("total"))
    joined = t.region.join(picks, F.expr("r_regionkey = n_regionkey"), "left").join(F.broadcast(total))
    n = F.coalesce("picks", F.lit(0))
    return joined.select(F.col("r_name").alias("choice"), n.alias("picks"), (F.floor(n * 1000 / F.col("total") + 0.5) / 10).alias("percent"))


@query(
    "agg_centroid",
    """SELECT label, i AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM
    (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL)""",
)
def agg_centroid(t: Tables) -> DataFrame:
    """Mean vector of each label, scaled to length one."""
    means = t.embeddings.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norms = means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm")).where("norm > 0")
    return means.join(norms, "label").select("label", "dim", F.round(F.col("m") / F.col("norm"), 6).alias("value"))


@query(
    "agg_attribute_profile",
    """SELECT key, count(*) AS n, count(DISTINCT user_id) AS users, median(value::DOUBLE) AS middle FROM
    (SELECT user_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events WHERE props IS NOT NULL)
    GROUP BY key ORDER BY n DESC, key LIMIT 25""",
)
def agg_attribute_profile(t: Tables) -> DataFrame:
    pairs = t.events.select("user_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    found = pairs.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.median(F.col("value").cast("double")).alias("middle"))
    return found.orderBy(F.desc("n"), "key").limit(25)
