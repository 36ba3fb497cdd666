"""Loci over time: runs of events of one user that lie within a gap of each other, on a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n, value: on a stream, state is dropped once the watermark has passed a session's end."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    per = x.where("user_id IS NOT NULL AND ts IS NOT NULL").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return per.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
