"""Heartbeats of brokers as a source: a bounded table, or a stream that goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _loads(sequence: Column) -> list[Column]:
    """Load fields as a broker without partitions sends them; the processor's load is made up from the sequence number."""
    cpu = F.pmod(F.xxhash64("broker_id", sequence), F.lit(10_000)) / 100
    return [F.lit(0).alias("partition_count"), F.lit(0).alias("connection_count"), F.lit(0).cast("long").alias("available_memory"), cpu.alias("cpu_usage")]


def heartbeats(brokers: DataFrame, start_ms: int, interval_ms: int, count: int) -> DataFrame:
    """(broker_id, sequence_number, timestamp_ms, load fields): so many heartbeats of each broker from a moment on."""
    each = brokers.select("broker_id").where(F.col("broker_id").isNotNull()).distinct()
    each = each.withColumn("sequence_number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    number = F.col("sequence_number")
    return each.select("broker_id", number, (F.lit(start_ms) + number * interval_ms).alias("timestamp_ms"), *_loads(number))


def heartbeat_stream(spark: SparkSession, brokers: int, rows_per_second: int = 1) -> DataFrame:
    """The same as a stream of brokers BROKER-1, BROKER-2... in turn, stamped with the time they are made."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", str(rows_per_second)).load()
    number = F.floor(F.col("value") / brokers)
    named = rows.withColumn("broker_id", F.concat(F.lit("BROKER-"), F.col("value") % brokers + 1))
    return named.select("broker_id", number.alias("sequence_number"), F.unix_millis("timestamp").alias("timestamp_ms"), *_loads(number))
