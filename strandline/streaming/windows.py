"""Event-time windows and sessions over an event stream; the same plan runs over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """`ts` as a timestamp of the session's zone, with a watermark on a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and tumbling or sliding window; rows later than the watermark are dropped on a stream."""
    events = _timed(events, late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after `gap` without an event."""
    events = _timed(events, late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def session_numbers(events: DataFrame, seconds: int) -> DataFrame:
    """Batch sessions by gap: (user_id, session, start, n), in window functions."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > seconds * 1_000_000).cast("int"), F.lit(1))
    each = events.select("user_id", "event_id", "ts", new.alias("new"))
    each = each.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count("*").alias("n"))
