"""Event-time aggregates over a stream of events (an extension; the state machine is in ``jobs``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and event type; rows later than ``late`` are dropped by the stream."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = stamped.withWatermark("ts", late) if events.isStreaming else stamped
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user: runs of events with no longer pause than ``gap``."""
    rows = events.where("user_id IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
