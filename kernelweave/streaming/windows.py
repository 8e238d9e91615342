"""An extension: measurement summaries over a stream, with the aggregates of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summaries(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, mean, std_pop of events (ts, event_type, value) in windows of event time.

    Works on batch and streaming frames alike; state is one row a window and type, dropped once the watermark passes.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "std_pop")
