"""Queries that run as streams: the event table is read as a stream, kept in state, and written by a file sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from ..streaming import windows
from .registry import query, rounded


def _streamed(spark, sf_dir, plan) -> DataFrame:
    """What a stream over the events has written once it has read all that is there: a window is written when the watermark has passed it."""
    folder = f"{scratch.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern: the table may be a folder or one file
    out = plan(source.select("ts", "user_id", "event_type", "value"))
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("WITH e AS (SELECT epoch(ts) AS t, event_type, value FROM events), w AS (SELECT (floor(t / 300) - i) * 300 AS start, event_type, value FROM e, (SELECT unnest([0, 1]) AS i)), m AS (SELECT max(t) - 1800 AS mark FROM e) SELECT CAST(start AS BIGINT) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM w, m WHERE start + 600 <= floor(mark * 1000) / 1000 GROUP BY 1, 2")
def streamed_windows(spark, sf_dir):
    """Sliding windows of ten minutes each five, counted by a stream with a watermark."""
    s = _streamed(spark, sf_dir, windows.sliding_counts)
    return s.select(F.unix_timestamp("start").alias("start"), "event_type", "n", rounded("mean_value").alias("mean_value"))


@query("WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 1800000000 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g), r AS (SELECT user_id, min(t) AS a, max(t) + 1800000000 AS b, count(*) AS n FROM s GROUP BY user_id, k), m AS (SELECT floor((max(t) - 3600000000) / 1000) * 1000 AS mark FROM e) SELECT user_id, a AS started, n FROM r, m WHERE b <= mark")
def streamed_sessions(spark, sf_dir):
    """Sessions of each user, parted by half an hour, by a stream with a watermark."""
    return _streamed(spark, sf_dir, windows.sessions).select("user_id", F.unix_micros("start").alias("started"), "n")
