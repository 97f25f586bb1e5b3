"""Streaming forms of the event operators, over any streaming DataFrame with the columns of `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (user, event id) once; state is kept only as long as the watermark allows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(["user_id", "event_id"])


def hourly_clicks(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Clicks of every hour, finished once the watermark passes its end."""
    clicks = events.where("event_type = 'click'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return clicks.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "n")


def daily_counters(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counters by day and kind with the last user and time seen."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "1 day"), "event_type").agg(
        F.count("*").alias("n"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last_user"), F.max("ts").alias("last_ts")
    ).select(F.to_date("window.start").alias("day"), "event_type", "n", "last_user", "last_ts")
