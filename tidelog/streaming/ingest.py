"""Continuous ingestion: a stream of records appended to the log, with offsets that go on from what is stored."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.log import OVERSIZE, assign_offsets, checked
from tidelog.runtime import cut, remove
from tidelog.sources.log_store import append, high_water_marks, read_log

KEYS = ["topic", "target_partition"]


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches in a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def marks_before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """(topic, target_partition, next_offset) as the batches before ``number`` left it; null if there is none.

    They are stored with each batch, so that a batch reads a row per partition however long the log is. A log that was
    stored otherwise is counted once.
    """
    stored = [n for n in _numbers(spark, f"{path}-marks") if n < number]
    if stored:
        return spark.read.schema("topic string, target_partition int, next_offset long").parquet(f"{path}-marks/batch={stored[-1]}")
    if any(n < number for n in _numbers(spark, path)):
        return high_water_marks(read_log(spark, path).where(F.col("batch") < number))
    return None


def appender(path: str, order: str, topics: DataFrame | None = None, largest: int = OVERSIZE) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: numbers the batch's records from the high-water marks of the batches before and stores them.

    With ``topics`` (topic, num_partitions) records that can't be stored get no offset: they go, with the reason, into the
    folder ``path``-rejects.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if topics is not None:
            batch = cut(checked(batch, topics, largest))
            batch.where("reject is not null").write.mode("overwrite").parquet(f"{path}-rejects/batch={number}")
            batch = batch.where("reject is null").drop("reject")
        before = marks_before(spark, path, number)
        counts = batch.where(F.col(order).isNotNull()).groupBy(*KEYS).agg(F.count("*").alias("_n"))
        append(assign_offsets(batch, KEYS, order, before), path, number)
        after = counts.select(*KEYS, F.col("_n").alias("next_offset"))
        if before is not None:
            after = before.unionByName(after).groupBy(*KEYS).agg(F.sum("next_offset").alias("next_offset"))
        after.coalesce(1).write.mode("overwrite").parquet(f"{path}-marks/batch={number}")
        for old in [n for n in _numbers(spark, f"{path}-marks") if n < number - 1]:
            remove(spark, f"{path}-marks/batch={old}")

    return run


def ingest(
    stream: DataFrame, path: str, checkpoint: str, order: str = "arrival_seq", linger_ms: int | None = None, topics: DataFrame | None = None, largest: int = OVERSIZE
) -> StreamingQuery:
    """Starts the append. Without ``linger_ms`` it takes what is there and ends; else it flushes that often."""
    writer = stream.writeStream.foreachBatch(appender(path, order, topics, largest)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if linger_ms is None else writer.trigger(processingTime=f"{linger_ms} milliseconds")).start()


def ingest_all(stream: DataFrame, folder: str, order: str = "arrival_seq", topics: DataFrame | None = None, largest: int = OVERSIZE) -> str:
    """Appends all that the stream has now; returns the log's path in ``folder``."""
    log = os.path.join(folder, "log")
    ingest(stream, log, os.path.join(folder, "progress"), order, None, topics, largest).awaitTermination()
    return log
