"""Streaming extension: daily event totals with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_totals(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and sums per day and type; events later than the watermark are
    dropped.  Works on streams and on tables."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("day"), "event_type", "n", "total"
    )


def start(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return totals.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
