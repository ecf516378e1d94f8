"""Catalogue of topics and brokers, with the rules for changing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most copies of a topic (fixed value).
MOST_REPLICAS = 3


def validate_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """Adds ``reject`` to requests (topic, num_partitions, replication_factor): the rule that is broken, null if none is."""
    known = topics.select("topic", F.lit(True).alias("_known")).distinct()
    again = F.count("*").over(Window.partitionBy("topic"))
    reject = (
        F.when(F.col("topic").isNull() | (F.trim("topic") == ""), "blank name")
        .when(F.col("_known"), "exists")
        .when(F.col("_again") > 1, "requested twice")
        .when(F.col("num_partitions").isNull() | (F.col("num_partitions") < 1), "no partitions")
        .when(F.col("replication_factor").isNull() | (F.col("replication_factor") < 0) | (F.col("replication_factor") > MOST_REPLICAS), "replication factor")
    )
    return requests.join(known, "topic", "left").withColumn("_again", again).withColumn("reject", reject).drop("_known", "_again")


def create_topics(topics: DataFrame, requests: DataFrame) -> DataFrame:
    """The catalogue with the requested topics, all or none: ValueError if any request breaks a rule."""
    bad = validate_topics(requests, topics).where(F.col("reject").isNotNull()).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['topic']}: {r['reject']}" for r in bad))
    return topics.unionByName(requests.select(*topics.columns))


def delete_topics(topics: DataFrame, names: DataFrame) -> DataFrame:
    return topics.join(names.select("topic"), "topic", "left_anti")


def topics_named(topics: DataFrame, names: DataFrame) -> DataFrame:
    """(topic, exists, num_partitions) of the names asked for, in the catalogue or not."""
    known = topics.select("topic", "num_partitions", F.lit(True).alias("_known"))
    return names.select("topic").distinct().join(known, "topic", "left").select("topic", F.coalesce("_known", F.lit(False)).alias("exists"), "num_partitions")


def register_brokers(brokers: DataFrame, registrations: DataFrame) -> DataFrame:
    """Brokers (broker_id, host, port, num_partitions) after registrations (broker_id, host, port): one that registers has no partitions yet."""
    new = registrations.select("broker_id", "host", "port", F.lit(0).alias("num_partitions"))
    return brokers.join(new.select("broker_id"), "broker_id", "left_anti").select(*new.columns).unionByName(new)


def update_brokers(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each broker (keys) that holds after its updates in ``order``: one with the same number of partitions changes nothing.

    So of the last updates with one number of partitions the first holds. Null is a number of its own.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    n = F.col("num_partitions")
    effective = updates.withColumn("_no", F.row_number().over(by)).withColumn("_was", F.lag("num_partitions").over(by)).where((F.col("_no") == 1) | ~n.eqNullSafe(F.col("_was")))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_no").desc()))
    return effective.withColumn("_last", last).where("_last = 1").drop("_no", "_was", "_last")


def decommission(brokers: DataFrame, gone: DataFrame) -> DataFrame:
    return brokers.join(gone.select("broker_id"), "broker_id", "left_anti")


def latest_snapshot(rows: DataFrame, cluster: str = "controller_id", number: str = "snapshot_no") -> DataFrame:
    """The distinct rows of each cluster's latest snapshot."""
    last = rows.groupBy(cluster).agg(F.max(number).alias("_last")).withColumnRenamed(cluster, "_cluster")
    return rows.join(last, (F.col(cluster) == F.col("_cluster")) & (F.col(number) == F.col("_last"))).drop("_cluster", "_last").distinct()


def owners(snap_partitions: DataFrame) -> DataFrame:
    """(controller_id, topic, target_partition, broker_id): who owns each partition by its cluster's latest snapshot.

    Of rows that contradict each other the greatest broker id counts.
    """
    latest = latest_snapshot(snap_partitions.select("controller_id", "snapshot_no", "topic", "target_partition", "broker_id"))
    return latest.groupBy("controller_id", "topic", "target_partition").agg(F.max("broker_id").alias("broker_id"))


def cluster_metadata(brokers: DataFrame, partitions: DataFrame) -> DataFrame:
    """(controller_id, broker_id, address, num_partitions, n_owned) of each cluster's latest snapshot."""
    owned = owners(partitions).groupBy("controller_id", "broker_id").agg(F.count("*").alias("n_owned"))
    own = latest_snapshot(brokers).groupBy("controller_id", "broker_id").agg(F.max(F.struct(F.concat_ws(":", "host", "port").alias("address"), "num_partitions")).alias("b"))
    return own.join(owned, ["controller_id", "broker_id"], "left").select("controller_id", "broker_id", "b.address", "b.num_partitions", F.coalesce("n_owned", F.lit(0)).alias("n_owned"))


def as_map(details: DataFrame, owner: str, key: str, fields: list[str]) -> DataFrame:
    """(owner, details): a map from key to the struct of fields, one row per owner. One owner's details are few."""
    pairs = F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*fields).alias("value")))
    return details.where(F.col(key).isNotNull()).groupBy(owner).agg(F.map_from_entries(pairs).alias("details"))


def from_map(maps: DataFrame, owner: str, key: str) -> DataFrame:
    """The rows of such maps."""
    return maps.select(owner, F.explode("details").alias(key, "_v")).select(owner, key, "_v.*")


def controller_metadata(snapshots: DataFrame, brokers: DataFrame, topics: DataFrame, partitions: DataFrame) -> DataFrame:
    """(controller_id, snapshot_no, is_active, n_brokers, n_topics, n_partitions) of each cluster's latest listed snapshot.

    Counts are of distinct names in the rows of that snapshot, 0 where it has none; of deliveries that differ, active counts.
    """
    keys = ["controller_id", "snapshot_no"]
    latest = latest_snapshot(snapshots.select(*keys, "is_active")).groupBy(*keys).agg(F.max("is_active").alias("is_active"))
    for name, rows, of in (("n_brokers", brokers, ["broker_id"]), ("n_topics", topics, ["topic"]), ("n_partitions", partitions, ["topic", "target_partition"])):
        counts = rows.join(latest.select(*keys), keys, "left_semi").select(*keys, *of).distinct().groupBy(*keys).agg(F.count("*").alias(name))
        latest = latest.join(counts, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return latest
