"""Amounts, identifiers, paths, URLs and calendar functions as column expressions, with a query for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query


@query("str_clean_title", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), ' +', ' ', 'g'), ' ')) AS title FROM documents")
def str_clean_title(t: Tables) -> DataFrame:
    blank = F.regexp_replace(F.regexp_replace("text", r"[\x00-\x1F\x7F]", " "), " +", " ")
    return t.documents.select("doc_id", F.md5(F.trim(blank)).alias("title"))


@query("money_parse", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal * 100 + 0.5)::BIGINT ELSE -1 END AS cents FROM customer")
def money_parse(t: Tables) -> DataFrame:
    """Positive decimal amounts to minor units, half up; -1 for the rest."""
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") * 100 + 0.5)).otherwise(-1).alias("cents"))


@query("json_explode", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def json_explode(t: Tables) -> DataFrame:
    return t.events.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("arr_slice_path", "SELECT DISTINCT path, array_to_string(string_split(path, '/')[1:2], '/') AS head FROM products")
def arr_slice_path(t: Tables) -> DataFrame:
    return t.products.select("path", F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("head")).distinct()


@query(
    "date_quota_period",
    """SELECT event_id, date_trunc('hour', l) AS hour, date_trunc('day', l) AS day, date_trunc('week', l) AS week, date_trunc('month', l) AS month FROM (SELECT event_id, ts + INTERVAL 3 HOUR AS l FROM events)""",
    dates="hour day week month",
)
def date_quota_period(t: Tables) -> DataFrame:
    """Starts of the local hour, day, ISO week and month."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Istanbul")
    return t.events.select("event_id", *[F.date_trunc(u, local).cast("timestamp_ntz").alias(u) for u in ("hour", "day", "week", "month")])


@query("date_previous_period", "SELECT a, b, (a - (b - a)::INT - 1)::DATE AS prior_a, (a - 1)::DATE AS prior_b FROM (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM events)", dates="a b prior_a prior_b")
def date_previous_period(t: Tables) -> DataFrame:
    """The range of equal length before a range."""
    span = t.events.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return span.select("a", "b", F.expr("date_sub(a, datediff(b, a) + 1)").alias("prior_a"), F.date_sub("a", 1).alias("prior_b"))
