"""Structured Streaming forms of the time-driven operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, ts: str, lag: str | None) -> DataFrame:
    """A stream with a watermark; watermarks take times with a zone alone, so that others are read in the session's."""
    if not events.isStreaming or not lag:
        return events
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lag)


def hourly_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", lag: str | None = "2 hours") -> DataFrame:
    """Tumbling hourly counts by type, for batch and streams; on a stream rows later than lag are dropped."""
    rows, time = _watermarked(events, ts, lag), events.schema[ts].dataType
    return rows.groupBy(F.window(ts, "1 hour").alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast(time).alias("hour"), kind, "n", "total")


def distinct_events(events: DataFrame, key: str = "event_id", ts: str = "ts", lag: str = "1 day") -> DataFrame:
    """Each key once: exact in batch, within the watermark on a stream."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return _watermarked(events, ts, lag).dropDuplicatesWithinWatermark([key]).withColumn(ts, F.col(ts).cast(events.schema[ts].dataType))


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions by user that end after a gap."""
    rows, time = _watermarked(events, ts, "1 hour"), events.schema[ts].dataType
    return rows.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").cast(time).alias("started"), F.col("w.end").cast(time).alias("ended"), "n")
