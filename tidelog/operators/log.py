"""The append log: sizes, rejects, offsets, segments, positional reads, lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import segment_name
from tidelog.operators.folding import greedy_fill
from tidelog.operators.order import numbered
from tidelog.runtime import small

#: Bytes of a record's frame (offset, byte position, length) and of its timestamp (fixed values).
FRAME, TIMESTAMP = 12, 8
OVERSIZE = 524_288
SEGMENT = 1_048_576
FLUSH = 524_288


def record_size(topic: Column, key: Column, value: Column, headers: Column) -> Column:
    length = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    of_headers = F.aggregate(
        F.coalesce(headers, F.array().cast("array<struct<header_key:string,header_value:binary>>")),
        F.lit(0).cast("long"),
        lambda a, h: a + length(h["header_key"]) + length(h["header_value"]),
    )
    return F.lit(FRAME + TIMESTAMP).cast("long") + length(topic) + length(key) + length(value) + of_headers


def accept(records: DataFrame, size: str, partition: str, num_partitions: str, largest: int = OVERSIZE) -> DataFrame:
    """Adds ``reject``: why a record can't be stored, null if it can. Rejects get no offsets.

    A record is empty if it has neither key, value nor headers: its size is that of its frame and topic.
    """
    p = F.col(partition)
    bare = F.lit(FRAME + TIMESTAMP) + F.octet_length("topic")
    return records.withColumn(
        "reject",
        F.when(F.col("topic").isNull() | (F.trim("topic") == ""), "no topic")
        .when(F.col(num_partitions).isNull(), "unknown topic")
        .when(p.isNull() | (p < 0) | (p >= F.col(num_partitions)), "invalid partition")
        .when(F.col(size) <= bare, "empty")
        .when(F.col(size) > largest, "oversize"),
    )


def checked(records: DataFrame, topics: DataFrame, largest: int = OVERSIZE) -> DataFrame:
    """Records (topic, target_partition, record_key, record_value[, headers]) with ``reject``, judged by the catalogue and by size."""
    headers = F.col("headers") if "headers" in records.columns else F.lit(None).cast("array<struct<header_key:string,header_value:binary>>")
    size = record_size(F.col("topic"), F.col("record_key"), F.col("record_value"), headers)
    catalogue = small(topics.select(F.col("topic").alias("_topic"), F.col("num_partitions").alias("_partitions")))
    rows = records.join(catalogue, F.col("topic") == F.col("_topic"), "left").withColumn("_size", size)
    return accept(rows, "_size", "target_partition", "_partitions", largest).drop("_topic", "_partitions", "_size")


def round_robin_batches(batches: DataFrame, topics: DataFrame, order: str) -> DataFrame:
    """Adds ``partition``: whole batches take turns over their topic's partitions, by one counter over all topics.

    Batches of topics that are unknown or have no partitions are left out: they are errors to their producer.
    """
    some = small(topics.where("num_partitions > 0").select("topic", "num_partitions"))
    turns = numbered(batches.join(some, "topic"), [], order, "_turn")
    return turns.withColumn("partition", F.pmod("_turn", "num_partitions").cast("int")).drop("_turn", "num_partitions")


def assign_offsets(records: DataFrame, keys: Sequence[str], order: str, marks: DataFrame | None = None, name: str = "offset") -> DataFrame:
    """Adds dense offsets per partition in append order, from 0 or from the high-water marks (keys..., next_offset)."""
    out = numbered(records, keys, order, name)
    if marks is None:
        return out
    at = marks.select(*keys, F.col("next_offset").alias("_next"))
    return out.join(at, list(keys), "left").withColumn(name, F.col(name) + F.coalesce("_next", F.lit(0))).drop("_next")


def log_bounds(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n_records, start_offset, end_offset); the end is exclusive, the next offset to be given."""
    return log.groupBy(*keys).agg(
        F.count("*").alias("n_records"), F.min("offset").cast("long").alias("start_offset"), (F.max("offset") + 1).cast("long").alias("end_offset")
    )


def appended_bounds(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same of records that are to be appended to empty partitions: as offsets are dense from 0, counts tell."""
    return records.groupBy(*keys).agg(F.count("*").alias("n_records")).select(*keys, "n_records", F.lit(0).cast("long").alias("start_offset"), F.col("n_records").alias("end_offset"))


def segments(log: DataFrame, keys: Sequence[str], order: str, size: str, cap: int = SEGMENT) -> DataFrame:
    """Adds segment (0, 1...), segment_base_offset and byte_pos (bytes of the segment before the record).

    Records larger than ``cap`` are in no segment; ``accept`` with the same limit rejects them before they are numbered,
    ``folding.unfilled`` lists them.
    """
    filled = greedy_fill(log, keys, order, size, cap, "segment", "byte_pos")
    return filled.withColumn("segment_base_offset", F.min("offset").over(Window.partitionBy(*keys, "segment")))  # bounded by cap


def segment_table(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per segment of a log with segments, with the name of its file."""
    topic, partition = keys
    return log.groupBy(*keys, "segment", "segment_base_offset").agg(F.count("*").alias("n_records"), F.sum("size_bytes").alias("n_bytes")).withColumn(
        "file_name", segment_name(F.col(topic), F.col(partition), F.col("segment_base_offset"))
    )


def fetch(log: DataFrame, requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Point reads: each request (keys..., offset) with its record, if there is one, a status and the next offset.

    An offset past the end is READ_COMPLETION, no error; the next offset is one further in both cases.
    """
    found = log.select(*keys, "offset", "timestamp_ms", "record_key", "record_value", F.lit(True).alias("_hit"))
    return (
        requests.join(found, [*keys, "offset"], "left")
        .withColumn("status", F.when(F.col("_hit"), "SUCCESS").otherwise("READ_COMPLETION"))
        .withColumn("next_offset", F.col("offset") + 1)
        .drop("_hit")
    )


def fetch_default(log: DataFrame, offset: int, topic: str = "topic", partition: str = "target_partition") -> DataFrame:
    """The record at an offset of partition 0 of the topic that is first by name; no row if there is none."""
    first = log.agg(F.min(topic).alias("_t"))  # one row
    return log.where((F.col(partition) == 0) & (F.col("offset") == offset)).join(F.broadcast(first), F.col(topic) == F.col("_t")).drop("_t")


def poll(log: DataFrame, positions: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` records per partition from its position on (positions: keys..., position), as offsets are dense."""
    at = F.col("position")
    return log.join(positions, list(keys)).where((F.col("offset") >= at) & (F.col("offset") < at + most)).drop("position")


def latest_commits(commits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., committed): the offset of the last commit per partition; of equal times the greatest offset."""
    return commits.groupBy(*keys).agg(F.max(F.struct("commit_ts", "offset"))["offset"].alias("committed"))


def lag(bounds: DataFrame, committed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., end_offset, committed, lag): records not yet consumed; without a commit all of them."""
    return bounds.join(committed, list(keys), "left").select(
        *keys, "end_offset", "committed", (F.col("end_offset") - F.coalesce(F.col("committed") + 1, F.col("start_offset"))).alias("lag")
    )


def in_flight(records: DataFrame, keys: Sequence[str], batch: str, acknowledged: Column) -> DataFrame:
    """(keys..., n_in_flight): batches with records that have no acknowledgement yet."""
    return records.where(~acknowledged).groupBy(*keys).agg(F.count_distinct(batch).alias("n_in_flight"))


def last_ack(records: DataFrame, batch: str) -> DataFrame:
    """(batch, last_offset): the offset a batch's acknowledgement carries; -1 if none of its records has one."""
    return records.groupBy(batch).agg(F.coalesce(F.max("offset"), F.lit(-1)).cast("long").alias("last_offset"))
