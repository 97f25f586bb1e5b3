"""Usage analytics: privacy-aware datasets, funnels, dense series, quality checks, replayed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query

_CELLS = """c AS (SELECT event_type, date_trunc('week', ts)::DATE AS week, user_id, least(count(*), 10) AS n FROM
    (SELECT *, count(*) OVER (PARTITION BY user_id, ts::DATE) AS volume FROM (SELECT DISTINCT ON (user_id, event_type, ts) * FROM events ORDER BY user_id, event_type, ts, event_id))
    WHERE volume <= 300 GROUP BY ALL), d AS (SELECT event_type, week, count(*) AS users, sum(n)::BIGINT AS events FROM c GROUP BY ALL)"""


def cells(t: Tables) -> DataFrame:
    """Weekly cells: events deduplicated, suspicious user-days dropped, each user's contribution capped at ten."""
    once = t.events.groupBy("user_id", "event_type", "ts").agg(F.min("event_id").alias("event_id"))
    day = Window.partitionBy("user_id", F.to_date("ts"))
    usual = once.withColumn("volume", F.count("*").over(day)).where("volume <= 300")
    week = F.to_date(F.date_trunc("week", "ts"))
    own = usual.groupBy("event_type", week.alias("week"), "user_id").agg(F.least(F.count("*"), F.lit(10)).alias("n"))
    return own.groupBy("event_type", "week").agg(F.count("*").alias("users"), F.sum("n").alias("events"))


@query("di_dataset", f"WITH {_CELLS} SELECT * FROM d", dates="week")
def di_dataset(t: Tables) -> DataFrame:
    return cells(t)


@query(
    "di_suppress",
    f"WITH {_CELLS} SELECT event_type, week, CASE WHEN users >= 100 THEN '100+' WHEN users >= 50 THEN '50-99' ELSE '10-49' END AS band, events FROM d WHERE users >= 10",
    dates="week",
)
def di_suppress(t: Tables) -> DataFrame:
    """Cells under ten users are dropped; user counts become bands."""
    band = F.when(F.col("users") >= 100, "100+").when(F.col("users") >= 50, "50-99").otherwise("10-49")
    return cells(t).where("users >= 10").select("event_type", "week", band.alias("band"), "events")


@query("di_anonymity", f"WITH {_CELLS} SELECT min(users) >= 10 AS cells_large, (SELECT count(DISTINCT user_id) FROM events) >= 100 AS population_large, count(*) <= 10000 AS rows_few FROM d WHERE users >= 10")
def di_anonymity(t: Tables) -> DataFrame:
    people = t.events.agg((F.countDistinct("user_id") >= 100).alias("population_large"))
    kept = cells(t).where("users >= 10").agg((F.min("users") >= 10).alias("cells_large"), (F.count("*") <= 10000).alias("rows_few"))
    return kept.join(F.broadcast(people))


@query(
    "di_price_band",
    """SELECT CASE WHEN price < 25000 THEN 0 WHEN price < 50000 THEN 1 WHEN price < 100000 THEN 2 WHEN price < 250000 THEN 3 WHEN price < 500000 THEN 4 WHEN price < 1000000 THEN 5 ELSE 6 END AS band,
    count(*) AS n FROM offers GROUP BY 1""",
)
def di_price_band(t: Tables) -> DataFrame:
    """Seven bands, lower bounds inclusive."""
    band = F.lit(0)
    for k, low in enumerate((25000, 50000, 100000, 250000, 500000, 1000000), 1):
        band = F.when(F.col("price") >= low, k).otherwise(band)
    return t.offers.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query(
    "di_counters",
    """SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases,
    count(*) FILTER (value < 1) AS tiny, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts FROM events""",
)
def di_counters(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.agg(
        F.count("*").alias("events"),
        F.countDistinct("user_id").alias("users"),
        F.count_if(kind == "view").alias("views"),
        F.count_if(kind == "purchase").alias("purchases"),
        F.count_if(F.col("value") < 1).alias("tiny"),
        F.min("ts").cast("string").alias("first_ts"),
        F.max("ts").cast("string").alias("last_ts"),
    )


_UP = """SELECT event_type, {n} AS level, part // 1000 AS part, sha256(string_agg(digest, ',' ORDER BY part)) AS digest FROM h{m} GROUP BY event_type, part // 1000"""


@query(
    "di_hash",
    f"""WITH h0 AS (SELECT event_type, 0 AS level, event_id // 1000 AS part, sha256(string_agg(event_id || ':' || user_id, ',' ORDER BY event_id)) AS digest FROM events GROUP BY ALL),
    h1 AS ({_UP.format(n=1, m=0)}), h2 AS ({_UP.format(n=2, m=1)}), h3 AS ({_UP.format(n=3, m=2)})
    SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3""",
)
def di_hash(t: Tables) -> DataFrame:
    """Digests of each event type's rows in canonical order, as a tree: of a thousand ids, of a thousand such digests, and so on.

    A node is bounded by its ids, so no row holds a whole event type; at a level of one part its digest covers all rows of the
    type. Three levels above the first cover ids up to 10^12.
    """
    return digest_tree(t.events, "event_type", "event_id", F.concat_ws(":", F.col("event_id").cast("string"), F.col("user_id").cast("string")))


def digest_tree(rows: DataFrame, group: str, number: str, text: Column, levels: int = 3, width: int = 1000) -> DataFrame:
    """group, level, part and digest of rows with a non-negative number each."""
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda r: r["s"]), ","), 256).alias("digest")
    up = lambda c: F.expr(f"{c} div {width}").alias("part")
    level = rows.groupBy(group, up(number)).agg(joined(F.struct(number, text.alias("s"))))
    out = level.withColumn("level", F.lit(0))
    for n in range(1, levels + 1):
        level = level.groupBy(group, up("part")).agg(joined(F.struct("part", F.col("digest").alias("s"))))
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out


@query(
    "di_pii_scan",
    r"""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS mail, regexp_matches(text, '[0-9]{9,}') AS digits FROM documents""",
)
def di_pii_scan(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("mail"), F.col("text").rlike("[0-9]{9,}").alias("digits")
    )


@query(
    "di_quality",
    """WITH m AS (SELECT count(*) AS n, count(*) FILTER (price > 0) AS good, count(*) - count(DISTINCT point_id) AS dup FROM prices)
    SELECT 'valid_price' AS metric, round(good / n, 6) AS value, CASE WHEN good >= n * 0.99 THEN 'PASS' WHEN good >= n * 0.95 THEN 'WARN' ELSE 'FAIL' END AS grade FROM m
    UNION ALL SELECT 'duplicate_key', round(dup / n, 6), CASE WHEN dup * 100 <= n THEN 'PASS' WHEN dup * 20 <= n THEN 'WARN' ELSE 'FAIL' END FROM m""",
)
def di_quality(t: Tables) -> DataFrame:
    m = t.prices.agg(F.count("*").alias("n"), F.count_if(F.col("price") > 0).alias("good"), F.countDistinct("point_id").alias("keys"))
    return m.selectExpr(
        "stack(2, 'valid_price', round(good / n, 6), CASE WHEN good >= n * 0.99 THEN 'PASS' WHEN good >= n * 0.95 THEN 'WARN' ELSE 'FAIL' END, "
        "'duplicate_key', round((n - keys) / n, 6), CASE WHEN (n - keys) * 100 <= n THEN 'PASS' WHEN (n - keys) * 20 <= n THEN 'WARN' ELSE 'FAIL' END) AS (metric, value, grade)"
    )


@query(
    "di_wilson",
    """SELECT event_type, round((p + 1.9208 / n - 1.96 * sqrt((p * (1 - p) + 0.9604 / n) / n)) / (1 + 3.8416 / n), 6) AS low FROM
    (SELECT event_type, count(*)::DOUBLE AS n, count(*) FILTER (value > 50) / count(*) AS p FROM events GROUP BY 1)""",
)
def di_wilson(t: Tables) -> DataFrame:
    """Lower bound of the 95 percent Wilson interval."""
    rows = t.events.groupBy("event_type").agg(F.count("*").cast("double").alias("n"), (F.count_if(F.col("value") > 50) / F.count("*")).alias("p"))
    return rows.selectExpr("event_type", "round((p + 1.9208D / n - 1.96D * sqrt((p * (1 - p) + 0.9604D / n) / n)) / (1 + 3.8416D / n), 6) AS low")


@query(
    "an_journey",
    """SELECT ts::DATE AS day, CASE WHEN count(DISTINCT user_id) >= 5 THEN count(DISTINCT user_id) ELSE -1 END AS users FROM events WHERE event_type = 'signup' GROUP BY 1""",
    dates="day",
)
def an_journey(t: Tables) -> DataFrame:
    """Sign-ups a day; numbers under five are withheld (-1)."""
    users = F.countDistinct("user_id")
    return t.events.where("event_type = 'signup'").groupBy(F.to_date("ts").alias("day")).agg(F.when(users >= 5, users).otherwise(-1).alias("users"))


@query(
    "an_funnel",
    """SELECT count(*) AS users, count(*) FILTER (v) AS viewed, count(*) FILTER (v AND c) AS clicked, count(*) FILTER (v AND c AND p) AS bought FROM
    (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase' AND value > 90) AS p FROM events GROUP BY 1)""",
)
def an_funnel(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    own = t.events.groupBy("user_id").agg(
        F.bool_or(kind == "view").alias("v"), F.bool_or(kind == "click").alias("c"), F.bool_or((kind == "purchase") & (F.col("value") > 90)).alias("p")
    )
    return own.agg(
        F.count("*").alias("users"), F.count_if("v").alias("viewed"), F.count_if(F.expr("v AND c")).alias("clicked"), F.count_if(F.expr("v AND c AND p")).alias("bought")
    )


@query(
    "an_tracking",
    """WITH h AS (SELECT hour(ts) AS hour, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT i AS hour, coalesce(n, 0) AS n, i = (SELECT min(hour) FROM h WHERE n = (SELECT max(n) FROM h)) AS peak FROM range(24) r(i) LEFT JOIN h ON hour = i""",
)
def an_tracking(t: Tables) -> DataFrame:
    """Clicks of every hour of the day and the first peak."""
    counts = t.events.where("event_type = 'click'").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    peak = counts.agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("top"))
    dense = t.spark.range(24).withColumnRenamed("id", "hour").join(F.broadcast(counts), "hour", "left").fillna(0, ["n"])
    return dense.join(F.broadcast(peak)).select("hour", "n", (F.col("hour") == F.col("top")).alias("peak"))


@query(
    "an_traffic",
    """WITH d AS (SELECT event_type, user_id % 7 AS place, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, CASE WHEN users < 22 THEN 'other' ELSE place::VARCHAR END AS place, sum(n)::BIGINT AS n FROM d GROUP BY ALL""",
)
def an_traffic(t: Tables) -> DataFrame:
    """Breakdown rows under the user threshold are merged into one row."""
    rows = t.events.groupBy("event_type", (F.col("user_id") % 7).alias("p")).agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))
    place = F.when(F.col("users") < 22, "other").otherwise(F.col("p").cast("string"))
    return rows.groupBy("event_type", place.alias("place")).agg(F.sum("n").alias("n"))


@query(
    "an_attention",
    """SELECT merchant_id, CASE WHEN NOT active THEN 'inactive' WHEN n IS NULL THEN 'never_ran' WHEN stock * 2 < n THEN 'stuck' WHEN newest < DATE '1998-06-01' THEN 'stale' ELSE 'fine' END AS state
    FROM merchants LEFT JOIN (SELECT merchant_id, count(*) AS n, count(*) FILTER (in_stock) AS stock, max(day) AS newest FROM offers GROUP BY 1) USING (merchant_id)""",
)
def an_attention(t: Tables) -> DataFrame:
    own = t.offers.groupBy("merchant_id").agg(F.count("*").alias("n"), F.count_if("in_stock").alias("stock"), F.max("day").alias("newest"))
    state = F.expr(
        "CASE WHEN NOT active THEN 'inactive' WHEN n IS NULL THEN 'never_ran' WHEN stock * 2 < n THEN 'stuck' WHEN newest < DATE '1998-06-01' THEN 'stale' ELSE 'fine' END"
    )
    return t.merchants.join(own, "merchant_id", "left").select("merchant_id", state.alias("state"))


@query(
    "an_freshness",
    """SELECT count(*) FILTER (day >= DATE '1998-11-24') AS week, count(*) FILTER (day < DATE '1998-06-01') AS stale, count(*) FILTER (NOT in_stock) AS out_of_stock, count(DISTINCT merchant_id) AS merchants FROM offers""",
)
def an_freshness(t: Tables) -> DataFrame:
    return t.offers.agg(
        F.count_if(F.expr("day >= DATE '1998-11-24'")).alias("week"),
        F.count_if(F.expr("day < DATE '1998-06-01'")).alias("stale"),
        F.count_if(F.expr("NOT in_stock")).alias("out_of_stock"),
        F.countDistinct("merchant_id").alias("merchants"),
    )


@query("an_sitemap", "SELECT (product_id - 1) // 500 + 1 AS shard, count(*) AS n, min(product_id) AS lo, max(product_id) AS hi FROM products GROUP BY 1")
def an_sitemap(t: Tables) -> DataFrame:
    shard = F.expr("(product_id - 1) div 500 + 1")
    return t.products.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.min("product_id").alias("lo"), F.max("product_id").alias("hi"))


@query(
    "an_price_audit",
    "SELECT count(*) FILTER (price IS NULL) AS missing, count(*) FILTER (price <= 0) AS negative, count(*) FILTER (price > 1000000) AS huge, count(*) FILTER (list_price * 100 > price * 105) AS marked_up FROM prices",
)
def an_price_audit(t: Tables) -> DataFrame:
    count = lambda e: F.count_if(F.expr(e))
    return t.prices.agg(
        count("price IS NULL").alias("missing"), count("price <= 0").alias("negative"), count("price > 1000000").alias("huge"), count("list_price * 100 > price * 105").alias("marked_up")
    )


@query(
    "an_cost_spike",
    """WITH d AS (SELECT ts::DATE AS day, sum(floor(value * 100)::BIGINT)::BIGINT AS cost, count(*) AS calls FROM events GROUP BY 1)
    SELECT day, cost > 1.05 * m AND calls >= 100 AS spike FROM (SELECT *, avg(cost) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m FROM d) WHERE m IS NOT NULL""",
    dates="day",
)
def an_cost_spike(t: Tables) -> DataFrame:
    """A day's cost against the mean of the seven days before; the days of one ledger are few."""
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.floor(F.col("value") * 100)).alias("cost"), F.count("*").alias("calls"))
    mean = F.avg("cost").over(Window.orderBy("day").rowsBetween(-7, -1))
    return daily.withColumn("m", mean).where("m IS NOT NULL").select("day", F.expr("cost > 1.05D * m AND calls >= 100").alias("spike"))


@query(
    "an_search_quality",
    """SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE len(word) > 3
    GROUP BY word HAVING count(*) > 1 ORDER BY n DESC, word LIMIT 50""",
)
def an_search_quality(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word")).where(F.length("word") > 3)
    top = words.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("n > 1")
    return top.orderBy(F.desc("n"), "word").limit(50)


@query(
    "an_engagement_bucket",
    "SELECT CASE WHEN value < 5 THEN 'a' WHEN value < 15 THEN 'b' WHEN value < 30 THEN 'c' WHEN value < 60 THEN 'd' ELSE 'e' END AS bucket, count(*) AS n FROM events GROUP BY 1",
)
def an_engagement_bucket(t: Tables) -> DataFrame:
    bucket = F.expr("CASE WHEN value < 5 THEN 'a' WHEN value < 15 THEN 'b' WHEN value < 30 THEN 'c' WHEN value < 60 THEN 'd' ELSE 'e' END")
    return t.events.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "an_coverage",
    "SELECT label, count(*) AS n, count(embedding) AS filled, round(count(embedding) / count(*), 6) AS ratio FROM embeddings GROUP BY 1",
)
def an_coverage(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.count("embedding").alias("filled"), F.round(F.count("embedding") / F.count("*"), 6).alias("ratio"))


@query(
    "an_feedback",
    """SELECT role, count(*) AS n, count(DISTINCT conv_id) AS talks, sum(len(text))::BIGINT AS chars FROM conversations GROUP BY role""",
)
def an_feedback(t: Tables) -> DataFrame:
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("talks"), F.sum(F.length("text")).alias("chars"))


@query(
    "st_query_day",
    """SELECT ts::DATE AS day, event_type, count(*) AS n, arg_max(user_id, (ts, event_id)) AS last_user, max(ts) AS last_ts FROM events GROUP BY ALL""",
    dates="day last_ts",
)
def st_query_day(t: Tables) -> DataFrame:
    """Daily counters with the last values seen; the streaming form is quarry.streaming.events.daily_counters."""
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count("*").alias("n"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last_user"), F.max("ts").alias("last_ts")
    )


@query("st_click_hour", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1", dates="hour")
def st_click_hour(t: Tables) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return t.events.where("event_type = 'click'").groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))


@query(
    "st_user_summary",
    """SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, coalesce(arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase'), -1) AS last_purchase FROM events GROUP BY 1""",
    dates="first_ts last_ts",
)
def st_user_summary(t: Tables) -> DataFrame:
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.coalesce(F.max_by("event_id", bought), F.lit(-1)).alias("last_purchase")
    )


@query("st_event_dedupe")
def st_event_dedupe(t: Tables) -> DataFrame:
    """Events that are stored: the first of a (user, event id); of views of one product by one user none within 30
    minutes of a stored one, of clicks on one query none within 10 minutes; other kinds always.

    An event after a pause as long as the rule's is stored whatever came before, so runs without such a pause are
    judged apart from each other; only inside a run the rule goes event by event.
    """
    import pandas as pd

    minutes = F.when(F.col("event_type") == "view", 30).when(F.col("event_type") == "click", 10).otherwise(0)
    rows = t.events.dropDuplicates(["user_id", "event_id"]).select(
        "user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.get_json_object("props", "$.k").alias("item"), (minutes * 60_000_000).cast("long").alias("pause"),
    )
    own = ["user_id", "event_type", "item"]
    order = Window.partitionBy(*own).orderBy("at", "event_id")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(order) >= F.col("pause"), F.lit(True))
    rows = rows.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order))
    sizes = rows.withColumn("size", F.count("*").over(Window.partitionBy(*own, "run")))

    def keep(run: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for i, at, pause in run.sort_values(["at", "event_id"])[["event_id", "at", "pause"]].itertuples(index=False):
            if last is None or at - last >= pause:
                kept.append(i)
                last = at
        return pd.DataFrame({"event_id": kept}, dtype="int64")

    alone = sizes.where("size = 1").select("event_id")
    return alone.unionByName(sizes.where("size > 1").groupBy(*own, "run").applyInPandas(keep, "event_id long"))


@query(
    "st_entitlement_ledger",
    """SELECT event_id, user_id, sum(floor(value)::BIGINT * CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS balance FROM events""",
)
def st_entitlement_ledger(t: Tables) -> DataFrame:
    change = F.floor("value") * F.when(F.col("event_type") == "purchase", -1).otherwise(1)
    return t.events.select("event_id", "user_id", F.sum(change).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("balance"))


@query("num_split_charge", "SELECT event_id, least(floor(value)::BIGINT, 40) AS quota, greatest(floor(value)::BIGINT - 40, 0) AS bonus FROM events WHERE floor(value) <= 90")
def num_split_charge(t: Tables) -> DataFrame:
    """A charge taken from the quota first, then from the bonus; charges beyond both are refused."""
    cost = F.floor("value")
    return t.events.where(cost <= 90).select("event_id", F.least(cost, F.lit(40)).alias("quota"), F.greatest(cost - 40, F.lit(0)).alias("bonus"))
