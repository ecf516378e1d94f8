"""Which brokers are alive, and how loaded they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.config import BrokerSettings
from tidelog.functions.text import broker_number

LOAD = ("partition_count", "connection_count", "available_memory", "cpu_usage")


def accepted(heartbeats: DataFrame) -> DataFrame:
    """Adds is_accepted: the sender's number is not 0 and its host not blank."""
    number = broker_number(F.col("broker_id"))
    return heartbeats.withColumn("is_accepted", F.coalesce((number != 0) & (F.trim("host") != ""), F.lit(False)))


def latest(heartbeats: DataFrame) -> DataFrame:
    """(broker_id, last_ms, load fields): the last heartbeat to arrive of each broker, whatever its sequence number."""
    last = F.max_by(F.struct(F.col("timestamp_ms").alias("last_ms"), *LOAD), "arrival_seq").alias("last")
    return heartbeats.groupBy("broker_id").agg(last).select("broker_id", "last.*")


def alive(heartbeats: DataFrame, now_ms: int, settings: BrokerSettings) -> DataFrame:
    """Adds is_alive to the latest: no more than the interval times the misses allowed has passed since."""
    silence = settings.heartbeat_interval_ms * settings.missed_heartbeats
    return latest(heartbeats).withColumn("is_alive", F.coalesce(F.lit(now_ms) - F.col("last_ms") <= silence, F.lit(False)))


def marked(heartbeats: DataFrame, marks: DataFrame, now_ms: int, settings: BrokerSettings) -> DataFrame:
    """Brokers with is_alive after ``marks`` (broker_id, kind, arrival_seq): ``offline`` takes a broker out until its next heartbeat
    arrives, ``remove`` makes it unknown until then."""
    last = heartbeats.groupBy(F.col("broker_id").alias("_b")).agg(F.max("arrival_seq").alias("_seen"))
    said = marks.groupBy(F.col("broker_id").alias("_m")).agg(
        F.max(F.when(F.col("kind") == "offline", F.col("arrival_seq"))).alias("_off"), F.max(F.when(F.col("kind") == "remove", F.col("arrival_seq"))).alias("_gone")
    )
    rows = alive(heartbeats, now_ms, settings)
    rows = rows.join(last, F.col("broker_id").eqNullSafe(F.col("_b"))).join(said, F.col("broker_id") == F.col("_m"), "left")
    rows = rows.where(~F.coalesce(F.col("_gone") > F.col("_seen"), F.lit(False)))
    return rows.withColumn("is_alive", F.col("is_alive") & ~F.coalesce(F.col("_off") > F.col("_seen"), F.lit(False))).drop("_b", "_m", "_seen", "_off", "_gone")


def least_loaded(brokers: DataFrame) -> DataFrame:
    """(broker_id, partition_count): of those alive with load information the one with the fewest partitions, then by id."""
    known = brokers.where(F.col("is_alive") & F.col("partition_count").isNotNull())
    best = known.agg(F.min(F.struct("partition_count", "broker_id")).alias("b")).where(F.col("b").isNotNull())
    return best.select("b.broker_id", "b.partition_count")
