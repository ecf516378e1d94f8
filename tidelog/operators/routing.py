"""Routing of records to partitions: explicit partition, then key hash, then one round-robin over all topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import key_partition
from tidelog.operators.order import numbered
from tidelog.runtime import small


def known_topics(records: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of topics in the catalogue with their num_partitions, the others)."""
    catalogue = small(topics.select(F.col("topic"), "num_partitions"))
    good = records.join(catalogue, "topic")
    bad = records.join(catalogue.select("topic"), "topic", "left_anti")
    return good, bad


def route(records: DataFrame, topics: DataFrame, explicit: str, key: str, order: str) -> DataFrame:
    """Adds ``num_partitions`` and ``partition`` to the records of known topics.

    A valid explicit partition wins; an invalid one counts as none. Then a key that is neither null nor empty is hashed.
    All the others take turns: one counter over all topics, which only these records advance.
    """
    rows, _ = known_topics(records, topics)
    valid = F.col(explicit).isNotNull() & (F.col(explicit) >= 0) & (F.col(explicit) < F.col("num_partitions"))
    has_key = F.col(key).isNotNull() & (F.col(key) != "")
    direct = F.coalesce(valid | has_key, F.lit(False))
    hashed = rows.where(direct).withColumn(
        "partition", F.when(valid, F.col(explicit)).otherwise(key_partition(F.col(key), F.col("num_partitions"))).cast("int")
    )
    turns = numbered(rows.where(~direct), [], order, "_turn")
    turns = turns.withColumn("partition", F.pmod(F.col("_turn"), F.col("num_partitions")).cast("int")).drop("_turn")
    return hashed.unionByName(turns)
