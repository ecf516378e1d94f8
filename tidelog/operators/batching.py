"""Batches of a producer: filling, readiness, expiry, retries, draining to brokers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.config import ProducerSettings
from tidelog.operators.folding import greedy_fill, unfilled


def fill_batches(records: DataFrame, keys: Sequence[str], order: str, size: str, settings: ProducerSettings) -> DataFrame:
    """Adds fill_no and used_before: the batch each record goes into, and how much was in it. Larger records are in ``rejects``."""
    return greedy_fill(records, keys, order, size, settings.batch_size, "fill_no", "used_before")


def rejects(records: DataFrame, keys: Sequence[str], order: str, size: str, settings: ProducerSettings) -> DataFrame:
    """The records that fill_batches puts into no batch, with ``reject``: to their producer they are errors."""
    return unfilled(records, keys, order, size, settings.batch_size)


def with_state(batches: DataFrame, now_ms: int, settings: ProducerSettings) -> DataFrame:
    """Adds age_ms, is_expired (older than the delivery timeout) and may_retry (attempts are left)."""
    return (
        batches.withColumn("age_ms", F.lit(now_ms) - F.col("created_ms"))
        .withColumn("is_expired", F.col("age_ms") > settings.delivery_timeout_ms)
        .withColumn("may_retry", F.col("retries") < settings.retries)
    )


def ready(batches: DataFrame, keys: Sequence[str], in_flight: DataFrame, now_ms: int, settings: ProducerSettings) -> DataFrame:
    """The oldest live batch of each partition that may be sent: full or past the linger time, and not too many in flight.

    Expired batches are taken away first; batches created after ``now_ms`` don't exist yet.
    """
    live = with_state(batches, now_ms, settings).where((F.col("age_ms") >= 0) & ~F.col("is_expired"))
    oldest = F.row_number().over(Window.partitionBy(*keys).orderBy("created_ms", "batch_no"))
    heads = live.withColumn("_at", oldest).where("_at = 1").drop("_at")
    full = (F.col("size_bytes") >= settings.batch_size) | (F.col("age_ms") >= settings.linger_ms)
    return heads.join(in_flight, list(keys), "left").where(full & (F.coalesce("n_in_flight", F.lit(0)) < settings.max_in_flight)).drop("n_in_flight")


def drain(ready_batches: DataFrame, owners: DataFrame, cursors: DataFrame, keys: Sequence[str], most_bytes: int) -> DataFrame:
    """Per broker the batches of its ready partitions, one each, from its cursor on, until the next would exceed the bytes.

    ``owners`` has keys..., broker_id; ``cursors`` broker_id, cursor (a number that is taken modulo the ready partitions). The
    first batch is always taken. Partitions without an owner stay. Adds drain_no and run_bytes.
    """
    owned = ready_batches.join(owners, list(keys)).where(F.col("broker_id").isNotNull())
    mine = Window.partitionBy("broker_id")
    placed = owned.join(cursors, "broker_id", "left").withColumn("_i", F.row_number().over(mine.orderBy(*keys)) - 1).withColumn("_n", F.count("*").over(mine))
    turned = placed.withColumn("drain_no", F.pmod(F.col("_i") - F.coalesce("cursor", F.lit(0)), F.col("_n")).cast("long"))
    running = mine.orderBy("drain_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        turned.withColumn("run_bytes", F.sum("size_bytes").over(running))
        .where((F.col("run_bytes") <= most_bytes) | (F.col("drain_no") == 0))
        .drop("_i", "_n", "cursor")
    )


def requeue(queue: DataFrame, failures: DataFrame, keys: Sequence[str], settings: ProducerSettings) -> DataFrame:
    """The queues after failed sends: failed batches with attempts left come back at the front, the others are dropped.

    ``queue`` is (keys..., batch_no, created_ms, retries, ...) of all batches; ``failures`` (batch_no, failed_ms), each batch at
    most once. Adds ``place`` (1, 2... within keys; null if dropped) and ``is_dropped``. Each batch goes before all others when it
    fails, so of several the last to fail is first; batches that have not failed keep their order of age.
    """
    rows = queue.join(failures.select("batch_no", "failed_ms"), "batch_no", "left")
    failed = F.col("failed_ms").isNotNull()
    rows = rows.withColumn("is_dropped", failed & (F.col("retries") >= settings.retries)).withColumn("retries", F.when(failed & ~F.col("is_dropped"), F.col("retries") + 1).otherwise(F.col("retries")))
    order = [F.col("is_dropped"), F.col("failed_ms").desc_nulls_last(), F.when(failed, -F.col("batch_no")), "created_ms", "batch_no"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", F.when(~F.col("is_dropped"), place)).drop("failed_ms")
