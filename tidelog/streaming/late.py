"""Event-time counts as a stream: Structured Streaming's watermark closes periods, late records correct open ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def period_counts(records: DataFrame, period: str = "1 hour", lateness: str = "6 hours") -> DataFrame:
    """(topic, period_start_ms, n) of a stream, in update mode corrected with each late record within ``lateness``.

    Here the watermark is Spark's, over all topics; operators.late judges each topic by its own.
    """
    timed = records.where(F.col("timestamp_ms").isNotNull()).withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", lateness)
    counts = timed.groupBy("topic", F.window("ts", period)).agg(F.count("*").alias("n"))
    return counts.select("topic", F.unix_millis(F.col("window.start")).alias("period_start_ms"), "n")
