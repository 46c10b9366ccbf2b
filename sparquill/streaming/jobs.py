"""The job-event stream: the same hourly windows in batch and in Structured Streaming."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """(hour, event_type, n, total) of a batch or of a stream with a watermark."""
    grouped = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def timed(events: DataFrame) -> DataFrame:
    """events with ts as an instant, which watermarks need; a time without zone is one of the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_stream(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """hourly() of a stream: rows later than lateness are dropped and closed windows leave the state."""
    return hourly(timed(events).withWatermark("ts", lateness))


def stale_jobs_stream(events: DataFrame, after: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a user's events that ended: after that long without another event a job counts as timed out."""
    s = timed(events).withWatermark("ts", lateness).groupBy(F.session_window("ts", after).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start_ts"), F.col("s.end").alias("timed_out_at"), "n")
