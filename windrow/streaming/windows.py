"""The event operators on streams: watermarked sliding windows and per-subject running state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, width: str = "10 minutes", step: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Events and mean value of each sliding window and type; a window is final once the watermark passes it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, parted by a gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n")
