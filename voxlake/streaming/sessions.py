"""Streams of events: sessions of activity and sliding counts with late data. An addition to the batch interval operators; the same
aggregates run over a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, gap: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(key, begin, end, n, total): activity of a key with pauses shorter than gap. late: how long a stream waits for stragglers."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late and e.isStreaming:
        e = e.withWatermark("ts", late)
    t = e.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return t.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "total")


def sliding_counts(events: DataFrame, window: str = "1 hour", period: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late and e.isStreaming:
        e = e.withWatermark("ts", late)
    t = e.groupBy("event_type", F.window("ts", window, period).alias("w")).agg(F.count("*").alias("n"))
    return t.select("event_type", F.col("w.start").alias("begin"), "n")
