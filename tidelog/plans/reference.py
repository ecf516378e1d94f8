"""Queries over the message log: routing, offsets, batches, segments, reads, groups, catalogue, liveness, codecs."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import BrokerSettings, ProducerSettings
from tidelog.functions import headers as H
from tidelog.functions.codecs import compress, configured_codec, decompress
from tidelog.functions.hashing import key_partition, murmur2
from tidelog.functions.text import addresses, broker_number, topic_partition
from tidelog.operators import assign as A
from tidelog.operators import batching as B
from tidelog.operators import catalog as C
from tidelog.operators import groups as G
from tidelog.operators import liveness as V
from tidelog.operators import log as L
from tidelog.operators.folding import unfilled
from tidelog.operators.routing import known_topics, route
from tidelog.operators.snapshots import Entity, snapshot_changes
from tidelog.plans.reference_sql import NOW_MS, SQL  # noqa: F401
from tidelog.runtime import cut, scratch, small, table
from tidelog.sources.log_store import commit_offsets, decode, encode, fetch_offsets, read_from, read_log, stamped, stored_log, stream_table
from tidelog.streaming.heartbeats import heartbeats
from tidelog.streaming.ingest import ingest_all

KEYS = ["topic", "target_partition"]
PRODUCER = ProducerSettings(batch_size=1_024, delivery_timeout_ms=21_600_000, linger_ms=60_000)
BROKER = BrokerSettings(heartbeat_interval_ms=60_000, missed_heartbeats=10)


def _records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "records_in")


def _with_size(rows: DataFrame) -> DataFrame:
    size = L.record_size(F.col("topic"), F.col("record_key"), F.col("record_value"), F.col("headers"))
    return rows.select(*KEYS, "arrival_seq", "batch_no", "ack_status", "append_ms", "timestamp_ms", "record_key", "record_value", size.alias("size_bytes"))


def _sized(s: SparkSession, d: str) -> DataFrame:
    return _with_size(_records(s, d))


def _log(s: SparkSession, d: str, largest: int = L.OVERSIZE) -> DataFrame:
    """The records that can be stored, with their offsets; the others are in ``_rejects`` and get none."""
    rows = L.checked(_records(s, d), table(s, d, "topics"), largest).where("reject is null")
    return L.assign_offsets(_with_size(rows), KEYS, "arrival_seq")


def _rejects(s: SparkSession, d: str, largest: int = L.OVERSIZE) -> DataFrame:
    return L.checked(_records(s, d), table(s, d, "topics"), largest).where("reject is not null")


def _bounds(s: SparkSession, d: str) -> DataFrame:
    rows = L.checked(_records(s, d), table(s, d, "topics")).where("reject is null and arrival_seq is not null")
    return L.appended_bounds(rows, KEYS)


def _stored(s: SparkSession, log: DataFrame) -> DataFrame:
    """The log as it is read back from the shared folder."""
    return stored_log(log, scratch(s, "log"))


def route_by_key_hash(s: SparkSession, d: str) -> DataFrame:
    good, _ = known_topics(_records(s, d), table(s, d, "topics"))
    return good.select("arrival_seq", murmur2(F.col("record_key")).alias("key_hash"), key_partition(F.col("record_key"), F.col("num_partitions")).alias("partition"))


def _wanted() -> F.Column:
    """An explicit partition for some records: valid, negative or too large."""
    return F.when(F.col("batch_no") % 3 == 0, F.col("batch_no") % 13 - 2).cast("int")


def route_precedence(s: SparkSession, d: str) -> DataFrame:
    routed = route(_records(s, d).withColumn("explicit", _wanted()), table(s, d, "topics"), "explicit", "record_key", "arrival_seq")
    return routed.select("arrival_seq", "topic", "partition")


def partition_counts(s: SparkSession, d: str) -> DataFrame:
    """Route, reject, number and count: the whole write path."""
    routed = route(_with_size(_records(s, d)).withColumn("explicit", _wanted()), table(s, d, "topics"), "explicit", "record_key", "arrival_seq")
    kept = L.accept(routed, "size_bytes", "partition", "num_partitions").where("reject is null")
    return L.appended_bounds(kept.where("arrival_seq is not null"), ["topic", "partition"])


#: A limit that some records of all data are beyond.
LARGEST = 150


def rejects_stored(s: SparkSession, d: str) -> DataFrame:
    """What the write path refuses, with a limit of LARGEST bytes; with stored_offsets all records."""
    return _rejects(s, d, LARGEST).select("arrival_seq", *KEYS, "reject")


def stored_offsets(s: SparkSession, d: str) -> DataFrame:
    """The offsets of all other records, read back from the stored log: none is spent on a reject."""
    return _stored(s, _log(s, d, LARGEST)).select("arrival_seq", *KEYS, "offset")


def batch_round_robin(s: SparkSession, d: str) -> DataFrame:
    return L.round_robin_batches(table(s, d, "batches"), table(s, d, "topics"), "batch_no").select("batch_no", "topic", "partition")


def rejected_records(s: SparkSession, d: str) -> DataFrame:
    """Why records can't be stored, by topic, with a limit of 100 bytes for a record."""
    rows = _sized(s, d).join(small(table(s, d, "topics").select("topic", "num_partitions")), "topic", "left")
    marked = L.accept(rows.withColumn("target_partition", F.col("target_partition") - F.when(F.col("size_bytes") % 5 == 0, 1).otherwise(0)), "size_bytes", "target_partition", "num_partitions", 100)
    return marked.groupBy("topic", "reject").agg(F.count("*").alias("n"))


def assign_offsets(s: SparkSession, d: str) -> DataFrame:
    return _log(s, d).select("arrival_seq", *KEYS, "offset")


def log_bounds(s: SparkSession, d: str) -> DataFrame:
    return L.log_bounds(_log(s, d), KEYS)


def publish_ack(s: SparkSession, d: str) -> DataFrame:
    return L.last_ack(_log(s, d).select("batch_no", "offset"), "batch_no")


def fetch_at_offset(s: SparkSession, d: str) -> DataFrame:
    """The record in the middle of each partition, and the one past its end."""
    log = _log(s, d)
    asked = _bounds(s, d).select(*KEYS, F.explode(F.array(F.floor(F.col("end_offset") / 2), F.col("end_offset"))).alias("offset"))
    return L.fetch(log, asked, KEYS)


def fetch_stored(s: SparkSession, d: str) -> DataFrame:
    """The same from the stored log: the requests prune its folders, and only the columns asked for are read."""
    log = _stored(s, _log(s, d))
    asked = L.log_bounds(log.select(*KEYS, "offset"), KEYS).select(*KEYS, F.explode(F.array(F.floor(F.col("end_offset") / 2), F.col("end_offset"))).alias("offset"))
    return L.fetch(log, cut(asked), KEYS)


def poll_stored(s: SparkSession, d: str) -> DataFrame:
    """Ten records from offset 20 on of the first partition of the topic that is first by name, from the stored log."""
    log = _stored(s, _log(s, d))
    first = log.agg(F.min(F.struct(*KEYS)).alias("p")).first()["p"]
    return read_from(log, first["topic"], first["target_partition"], 20, 10).select("arrival_seq", *KEYS, "offset", "record_value")


def fetch_default(s: SparkSession, d: str) -> DataFrame:
    """The record at offset 3 of where reads go that name no place."""
    return L.fetch_default(_log(s, d), 3).select("arrival_seq", *KEYS, "offset")


def _commits(s: SparkSession, d: str) -> DataFrame:
    """Acknowledged records count as committed when they were appended."""
    return _log(s, d).where("ack_status = 'SUCCESS'").select(*KEYS, "offset", F.col("append_ms").alias("commit_ts"))


def poll_range(s: SparkSession, d: str) -> DataFrame:
    """The next 10 records of each partition from its middle on."""
    log = _log(s, d)
    positions = _bounds(s, d).select(*KEYS, F.floor(F.col("end_offset") / 2).alias("position"))
    return L.poll(log, positions, KEYS, 10).select("arrival_seq", *KEYS, "offset")


def consumer_lag(s: SparkSession, d: str) -> DataFrame:
    return L.lag(_bounds(s, d), L.latest_commits(_commits(s, d), KEYS), KEYS)


def committed_offsets(s: SparkSession, d: str) -> DataFrame:
    """Commits of two groups, of even and of odd batches, stored and fetched again."""
    rows = _log(s, d).where("ack_status = 'SUCCESS'").withColumn("group_id", F.concat(F.lit("group-"), F.col("batch_no") % 2))
    path = scratch(s, "commits")
    commit_offsets(rows.withColumn("commit_ts", F.col("append_ms")), path)
    return fetch_offsets(s, path)


def segment_roll(s: SparkSession, d: str) -> DataFrame:
    """Segments of 16 KiB, so that they roll in small data too. Records that are larger are rejected before they are numbered."""
    return L.segment_table(L.segments(_log(s, d, 16_384), KEYS, "arrival_seq", "size_bytes", 16_384), KEYS)


def offset_index(s: SparkSession, d: str) -> DataFrame:
    return L.segments(_log(s, d, 16_384), KEYS, "arrival_seq", "size_bytes", 16_384).select(*KEYS, "offset", "segment_base_offset", "byte_pos")


def flush_groups(s: SparkSession, d: str) -> DataFrame:
    """How many flushes a buffer of 8 KiB makes per partition."""
    filled = L.greedy_fill(_sized(s, d), KEYS, "arrival_seq", "size_bytes", 8_192, "flush_no", "used_before")
    return filled.groupBy(*KEYS).agg((F.max("flush_no") + 1).alias("n_flushes"))


def batch_fill(s: SparkSession, d: str) -> DataFrame:
    """Batches of 1 KiB, with their counts and bytes."""
    filled = B.fill_batches(_sized(s, d), KEYS, "arrival_seq", "size_bytes", PRODUCER)
    return filled.groupBy(*KEYS, "fill_no").agg(F.count("*").alias("n_records"), F.sum("size_bytes").alias("n_bytes"), F.min("arrival_seq").alias("first_seq"))


def fill_rejects(s: SparkSession, d: str) -> DataFrame:
    """The records that fills of batches, flushes and segments leave out, and why."""
    rows = _sized(s, d).select("arrival_seq", *KEYS, "size_bytes")
    out = [
        ("batch", B.rejects(rows, KEYS, "arrival_seq", "size_bytes", PRODUCER)),
        ("flush", unfilled(rows, KEYS, "arrival_seq", "size_bytes", 8_192)),
        ("segment", unfilled(rows, KEYS, "arrival_seq", "size_bytes", 16_384)),
    ]
    return reduce(DataFrame.unionByName, [df.withColumn("fill", F.lit(name)) for name, df in out])


def _in_flight(s: SparkSession, d: str) -> DataFrame:
    return L.in_flight(_records(s, d), KEYS, "batch_no", F.col("ack_status").isNotNull())


def in_flight(s: SparkSession, d: str) -> DataFrame:
    return _in_flight(s, d)


def _ready(s: SparkSession, d: str) -> DataFrame:
    return B.ready(table(s, d, "batches"), KEYS, _in_flight(s, d), NOW_MS, PRODUCER)


def batch_ready(s: SparkSession, d: str) -> DataFrame:
    return _ready(s, d).select(*KEYS, "batch_no")


def batch_expired(s: SparkSession, d: str) -> DataFrame:
    return B.with_state(table(s, d, "batches"), NOW_MS, PRODUCER).where("is_expired").select("batch_no", "age_ms", "may_retry")


def retry_queue(s: SparkSession, d: str) -> DataFrame:
    """The queues after the sends of every fifth batch have failed, the later ones last."""
    batches = table(s, d, "batches").select(*KEYS, "batch_no", "created_ms", "retries")
    failures = batches.where("batch_no % 5 = 0").select("batch_no", (F.col("created_ms") + 1000).alias("failed_ms"))
    return B.requeue(batches, failures, KEYS, PRODUCER).select(*KEYS, "batch_no", "retries", "is_dropped", "place")


def _owners(s: SparkSession, d: str) -> DataFrame:
    return C.owners(table(s, d, "snap_partitions"))


def drain_request(s: SparkSession, d: str) -> DataFrame:
    own = _owners(s, d)
    first = own.agg(F.min("controller_id").alias("controller_id"))  # one row: the cluster that is drained to
    own = own.join(F.broadcast(first), "controller_id").drop("controller_id")
    cursors = own.where(F.col("broker_id").isNotNull()).select("broker_id").distinct().withColumn("cursor", broker_number(F.col("broker_id")))
    return B.drain(_ready(s, d), own, cursors, KEYS, 2_048).select("broker_id", *KEYS, "batch_no", "drain_no", "run_bytes")


def partition_owner(s: SparkSession, d: str) -> DataFrame:
    """Every partition of the catalogue with its owner in each cluster that lists it, null if it has none."""
    whole = A.universe(table(s, d, "topics"))
    own = _owners(s, d).withColumnRenamed("target_partition", "partition")
    return whole.join(own, ["topic", "partition"], "left")


def broker_partitions(s: SparkSession, d: str) -> DataFrame:
    own = _owners(s, d).where(F.col("broker_id").isNotNull())
    listed = F.sort_array(F.collect_list(F.struct("topic", "target_partition")))  # a broker's partitions
    texts = F.transform(listed, lambda x: topic_partition(x["topic"], x["target_partition"]))
    return own.groupBy("controller_id", "broker_id").agg(F.count("*").alias("n_partitions"), F.array_join(texts, " ").alias("partitions"))


def _members(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.col("n_name").alias("member"), "n_regionkey")


def _topics(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "topics").select("topic", "num_partitions")


def assign_range(s: SparkSession, d: str) -> DataFrame:
    return A.assign_range(_members(s, d).select("member"), _topics(s, d))


def assign_round_robin(s: SparkSession, d: str) -> DataFrame:
    return A.assign_round_robin(_members(s, d).select("member"), _topics(s, d))


def _as_previous(assignment: DataFrame) -> DataFrame:
    return assignment.withColumn("topic_pos", F.dense_rank().over(L.Window.partitionBy("member").orderBy("topic")))


def _none(s: SparkSession) -> DataFrame:
    return s.createDataFrame([], "member string, topic string, partition int, topic_pos int")


def assign_sticky_initial(s: SparkSession, d: str) -> DataFrame:
    return A.assign_sticky(_members(s, d).select("member"), _topics(s, d), _none(s))


def assign_sticky_leave(s: SparkSession, d: str) -> DataFrame:
    """After a round-robin round, the members of one region leave."""
    before = cut(A.assign_round_robin(_members(s, d).select("member"), _topics(s, d)))
    stay = G.leave(_members(s, d), _members(s, d).where("n_regionkey = 0"))
    return A.assign_sticky(stay.select("member"), _topics(s, d), _as_previous(before))


def assign_sticky_join(s: SparkSession, d: str) -> DataFrame:
    """After a range round without them, the members of one region join."""
    before = cut(A.assign_range(_members(s, d).where("n_regionkey <> 0").select("member"), _topics(s, d)))
    return A.assign_sticky(_members(s, d).select("member"), _topics(s, d), _as_previous(before))


def _claims(s: SparkSession, d: str) -> DataFrame:
    """A previous assignment in which neighbours claim the same partitions: what range gives members, and what it gives those of the next region."""
    one = cut(A.assign_range(_members(s, d).select("member"), _topics(s, d)))
    two = cut(A.assign_range(_members(s, d).where("n_regionkey <> 2").select("member"), _topics(s, d)))
    return one.unionByName(two).distinct()


def assign_sticky_contested(s: SparkSession, d: str) -> DataFrame:
    return A.assign_sticky(_members(s, d).select("member"), _topics(s, d), _as_previous(_claims(s, d)))


def group_sync(s: SparkSession, d: str) -> DataFrame:
    """What each member is told of a range assignment."""
    return A.per_member(_members(s, d), assign_range(s, d))


def assignor_choice(s: SparkSession, d: str) -> DataFrame:
    """What names of strategies stand for."""
    names = {A.assign_range: "range", A.assign_round_robin: "roundrobin", A.assign_sticky: "sticky"}
    asked = ["range", "RoundRobin", "STICKY", "other", None]
    return s.createDataFrame([(n, names[A.assignor(n)]) for n in asked], "name string, strategy string")


def assignment_encoded(s: SparkSession, d: str) -> DataFrame:
    return A.encoded(assign_range(s, d))


def assignment_decoded(s: SparkSession, d: str) -> DataFrame:
    return assignment_encoded(s, d).select(F.explode(A.decoded(F.col("text"))).alias("a")).select("a.*")


def subscription_counts(s: SparkSession, d: str) -> DataFrame:
    """Partition counts of the topics that messages came for; unknown topics are skipped."""
    return _records(s, d).select("topic").distinct().join(_topics(s, d), "topic")


def protocol_choice(s: SparkSession, d: str) -> DataFrame:
    """Customers of a market segment join as a group; all but a few know the range protocol."""
    protocols = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("roundrobin"), F.lit("range"))).otherwise(F.array(F.lit("range"), F.lit("sticky"), F.lit("roundrobin")))
    lone = F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 3), F.array(F.lit("custom"))).otherwise(protocols)
    joins = table(s, d, "customer").select(F.col("c_mktsegment").alias("group_id"), F.col("c_name").alias("member"), lone.alias("protocols"), F.col("c_custkey").alias("arrival"))
    return G.join_round(joins)


def protocol_rounds(s: SparkSession, d: str) -> DataFrame:
    """The same customers in rounds: a group's round ends with each customer of one nation."""
    protocols = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("roundrobin"), F.lit("range"))).otherwise(F.array(F.lit("range"), F.lit("sticky"), F.lit("roundrobin")))
    lone = F.when(F.col("c_custkey") % 50 == 7, F.array(F.lit("custom"))).when(F.col("c_custkey") % 50 == 8, F.array().cast("array<string>")).otherwise(protocols)
    rows = table(s, d, "customer")
    joins = rows.select(F.col("c_mktsegment").alias("group_id"), F.col("c_name").alias("member"), lone.alias("protocols"), F.col("c_custkey").alias("arrival"))
    closes = rows.where("c_nationkey = 3").select(F.col("c_mktsegment").alias("group_id"), F.col("c_custkey").alias("arrival"))
    return G.join_rounds(joins, closes)


def broker_latest(s: SparkSession, d: str) -> DataFrame:
    return V.latest(table(s, d, "heartbeats")).select("broker_id", "last_ms", "partition_count", "connection_count", "available_memory")


def broker_liveness(s: SparkSession, d: str) -> DataFrame:
    return V.alive(table(s, d, "heartbeats"), NOW_MS, BROKER).select("broker_id", "last_ms", "is_alive")


def alive_count(s: SparkSession, d: str) -> DataFrame:
    return V.alive(table(s, d, "heartbeats"), NOW_MS, BROKER).agg(F.count(F.when(F.col("is_alive"), 1)).alias("n_alive"), F.count("*").alias("n_brokers"))


def alive_loads(s: SparkSession, d: str) -> DataFrame:
    live = V.alive(table(s, d, "heartbeats"), NOW_MS, BROKER).where("is_alive")
    return broker_latest(s, d).join(live, "broker_id", "left_semi")


def broker_marks(s: SparkSession, d: str) -> DataFrame:
    """Liveness after some brokers were taken offline or removed halfway or at the end."""
    beats = table(s, d, "heartbeats")
    number = broker_number(F.col("broker_id"))
    kind = F.when(number % 4 == 1, "offline").when(number % 4 == 2, "remove")
    at = F.when(number % 3 == 0, F.min("arrival_seq") + 1).otherwise(F.max("arrival_seq") + 1)
    marks = beats.groupBy("broker_id").agg(at.alias("arrival_seq")).withColumn("kind", kind).where("kind is not null")
    return V.marked(beats, marks, NOW_MS, BROKER).select("broker_id", "last_ms", "is_alive")


def least_loaded(s: SparkSession, d: str) -> DataFrame:
    return V.least_loaded(V.alive(table(s, d, "heartbeats"), NOW_MS, BROKER))


def heartbeat_acceptance(s: SparkSession, d: str) -> DataFrame:
    """Heartbeats taken and refused, and whether a sender's failures exceed its retries."""
    marked = V.accepted(table(s, d, "heartbeats"))
    failed = F.col("timestamp_ms").isNull()
    net = F.count(F.when(failed, 1)) - F.count(F.when(~failed, 1))
    return marked.groupBy("broker_id").agg(
        F.count(F.when(F.col("is_accepted"), 1)).alias("n_accepted"),
        F.count(F.when(~F.col("is_accepted"), 1)).alias("n_refused"),
        (net > BROKER.max_retries).alias("gives_up"),
    )


def broker_addresses(s: SparkSession, d: str) -> DataFrame:
    """The hosts and ports of each snapshot's brokers, written as one list and parsed again."""
    hosts = table(s, d, "snap_brokers").groupBy("controller_id", "snapshot_no").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "host", "port"))), ", ").alias("text"))
    return hosts.select("controller_id", "snapshot_no", F.explode(addresses(F.col("text"))).alias("a")).select("controller_id", "snapshot_no", "a.host", "a.port")


def headers_last(s: SparkSession, d: str) -> DataFrame:
    each = _records(s, d).select("arrival_seq", "headers", F.explode(H.keys(F.col("headers"))).alias("header_key"))
    value = F.hex(H.last(F.col("headers"), F.col("header_key")))
    return each.select("arrival_seq", "header_key", value.alias("last_value"), F.size(H.values(F.col("headers"), F.col("header_key"))).alias("n_values"))


def headers_flat(s: SparkSession, d: str) -> DataFrame:
    """Headers grouped by key in the order of first appearance, with their places."""
    each = _records(s, d).select("arrival_seq", F.posexplode(H.flat(F.col("headers"))).alias("place", "h"))
    return each.select("arrival_seq", "place", F.col("h.header_key").alias("header_key"), F.hex("h.header_value").alias("header_value"))


def headers_changed(s: SparkSession, d: str) -> DataFrame:
    """One header added, and each record's first key removed: how many headers are left."""
    more = H.add(F.col("headers"), F.lit("seen"), F.encode(F.lit("1"), "UTF-8"))
    first = F.try_element_at(H.keys(F.col("headers")), F.lit(1))
    return _records(s, d).select("arrival_seq", F.size(more).alias("n_added"), F.size(H.remove(more, first)).alias("n_left"))


def create_topics_validation(s: SparkSession, d: str) -> DataFrame:
    """Topics as snapshots name them, prefixed by their cluster, put forward to be created."""
    asked = (
        table(s, d, "snap_topics").groupBy("controller_id", "topic").agg(F.max("num_partitions").alias("num_partitions"), F.count("*").alias("n"))
        .select(
            F.when(F.col("n") % 2 == 0, F.col("topic")).otherwise(F.concat_ws("-", "controller_id", "topic")).alias("topic"),
            (F.col("num_partitions") - 2).alias("num_partitions"),
            (F.length("topic") % 6 - 1).alias("replication_factor"),
        )
    )
    checked = C.validate_topics(asked, table(s, d, "topics"))
    return checked.groupBy("reject").agg(F.count("*").alias("n_topics"), F.sum("num_partitions").cast("long").alias("n_partitions"))


def topics_asked(s: SparkSession, d: str) -> DataFrame:
    """Whether topics are in the catalogue, with their partitions."""
    names = table(s, d, "snap_topics").select(F.when(F.col("snapshot_no") % 7 == 0, F.concat(F.lit("no-"), F.col("topic"))).otherwise(F.col("topic")).alias("topic"))
    return C.topics_named(table(s, d, "topics"), names)


def broker_updates(s: SparkSession, d: str) -> DataFrame:
    """The row of each cluster's broker after all its snapshots came as updates."""
    rows = table(s, d, "snap_brokers").groupBy("controller_id", "broker_id", "snapshot_no").agg(F.max("num_partitions").alias("num_partitions"))
    return C.update_brokers(rows, ["controller_id", "broker_id"], "snapshot_no")


def controller_metadata(s: SparkSession, d: str) -> DataFrame:
    return C.controller_metadata(table(s, d, "snapshots"), table(s, d, "snap_brokers"), table(s, d, "snap_topics"), table(s, d, "snap_partitions"))


def heartbeat_source(s: SparkSession, d: str) -> DataFrame:
    """Ten heartbeats of each broker that snapshots name, a minute apart."""
    return heartbeats(table(s, d, "snap_brokers").select("broker_id"), NOW_MS, 60_000, 10).drop("cpu_usage")


def cluster_metadata(s: SparkSession, d: str) -> DataFrame:
    return C.cluster_metadata(table(s, d, "snap_brokers"), table(s, d, "snap_partitions"))


def metadata_maps(s: SparkSession, d: str) -> DataFrame:
    """The latest brokers of each cluster as a map of structs, and back."""
    rows = C.latest_snapshot(table(s, d, "snap_brokers").select("controller_id", "snapshot_no", "broker_id", "host", "port"))
    return C.from_map(C.as_map(rows, "controller_id", "broker_id", ["host", "port"]), "controller_id", "broker_id")


def settings_defaults(s: SparkSession, d: str) -> DataFrame:
    both = [(type(x).__name__, f.name, str(getattr(x, f.name))) for x in (ProducerSettings(), BrokerSettings()) for f in fields(x)]
    return s.createDataFrame(both, "settings string, name string, value string")


def settings_checked(s: SparkSession, d: str) -> DataFrame:
    """Which values of the checked settings are taken."""
    tried = [(c, n, v) for c, n in ((ProducerSettings, "batch_size"), (BrokerSettings, "heartbeat_interval_ms"), (BrokerSettings, "missed_heartbeats"), (BrokerSettings, "heartbeat_timeout_ms"))
             for v in (0, 1, 10, 11, 99, 100, 30_000, 30_001, 60_000, 60_001, 1_048_576, 1_048_577)]

    def taken(kind, name, value) -> bool:
        try:
            return getattr(kind.of({name: str(value)}), name) == value
        except ValueError:
            return False

    return s.createDataFrame([(n, v, taken(c, n, v)) for c, n, v in tried], "name string, value int, is_taken boolean")


def stamped_records(s: SparkSession, d: str) -> DataFrame:
    """Records without a timestamp get the present one, the others keep theirs."""
    rows = stamped(_records(s, d).withColumn("given", F.col("timestamp_ms")))
    same = F.col("given").eqNullSafe(F.col("timestamp_ms"))
    late = F.col("timestamp_ms") > NOW_MS
    return rows.groupBy("topic").agg(F.count("timestamp_ms").alias("n_stamped"), F.count(F.when(same, 1)).alias("n_given"), F.count(F.when(~same & late, 1)).alias("n_new"))


def metadata_diff(s: SparkSession, d: str) -> DataFrame:
    """Which snapshots differ from their predecessors, so that listeners are told."""
    kinds = [
        Entity("broker", table(s, d, "snap_brokers"), F.col("broker_id"), ["host", "port", "num_partitions"]),
        Entity("topic", table(s, d, "snap_topics"), F.col("topic"), ["num_partitions"]),
    ]
    changes = snapshot_changes(table(s, d, "snapshots"), kinds, "controller_id", "snapshot_no")
    return changes.groupBy("controller_id", "snapshot_no").agg(F.count("*").alias("n_changes"))


def compress_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """The values of each batch packed with the batch's codec and unpacked again."""
    codec = configured_codec(F.col("codec"))
    rows = _records(s, d).select("batch_no", "record_value").join(table(s, d, "batches").select("batch_no", codec.alias("codec")), "batch_no")
    rows = rows.withColumn("raw", F.encode("record_value", "UTF-8"))
    back = rows.withColumn("same", decompress(F.col("codec"), compress(F.col("codec"), F.col("raw"))) == F.col("raw"))
    return back.groupBy("codec").agg(F.count("*").alias("n_records"), F.count(F.when(F.col("same"), 1)).alias("n_same"), F.sum(F.octet_length("raw")).cast("long").alias("n_bytes"))


def compression_ratio(s: SparkSession, d: str) -> DataFrame:
    """Compressed size over raw size of each batch's values, taken together in order."""
    rows = _records(s, d).groupBy("batch_no").agg(F.sort_array(F.collect_list(F.struct("arrival_seq", "record_value"))).alias("rs"))  # a batch is bounded
    text = rows.select("batch_no", F.encode(F.array_join(F.transform("rs", lambda r: r["record_value"]), "\n"), "UTF-8").alias("raw"))
    both = text.join(table(s, d, "batches").select("batch_no", configured_codec(F.col("codec")).alias("codec")), "batch_no")
    return both.select("batch_no", "codec", (F.octet_length(compress(F.col("codec"), F.col("raw"))) / F.octet_length("raw")).alias("ratio"))


def codec_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Records as opaque bytes and back, nulls and headers included; the headers' bytes are then written as hex."""
    columns = ["arrival_seq", "topic", "target_partition", "record_key", "record_value", "timestamp_ms", "headers"]
    back = decode(encode(_records(s, d), columns), _records(s, d).select(*columns).schema)
    each = F.transform("headers", lambda h: F.concat_ws("=", F.coalesce(h["header_key"], F.lit("~")), F.coalesce(F.hex(h["header_value"]), F.lit("~"))))
    return back.withColumn("headers", F.array_join(each, ";"))


def stream_append_counts(s: SparkSession, d: str) -> DataFrame:
    """The records as a stream, appended to a log in micro-batches, then counted."""
    stream = stream_table(s, d, "records_in", _records(s, d).schema).select("arrival_seq", *KEYS, "timestamp_ms", "record_key", "record_value", "headers")
    folder = scratch(s, "append")
    return L.log_bounds(read_log(s, ingest_all(stream, folder, topics=table(s, d, "topics"))), KEYS)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            rejects_stored, stored_offsets, batch_round_robin, fetch_stored, poll_stored, committed_offsets, retry_queue, assign_sticky_contested, group_sync,
            assignor_choice, protocol_rounds, broker_marks, topics_asked, broker_updates, cluster_metadata, controller_metadata, heartbeat_source, fetch_default, metadata_maps, settings_defaults, settings_checked,
            stamped_records, partition_counts, route_by_key_hash, route_precedence, rejected_records, assign_offsets, log_bounds, publish_ack, fetch_at_offset, poll_range,
            consumer_lag, segment_roll, offset_index, flush_groups, batch_fill, fill_rejects, in_flight, batch_ready, batch_expired, drain_request, partition_owner,
            broker_partitions, assign_range, assign_round_robin, assign_sticky_initial, assign_sticky_leave, assign_sticky_join, assignment_encoded,
            assignment_decoded, subscription_counts, protocol_choice, broker_latest, broker_liveness, alive_count, alive_loads, least_loaded,
            heartbeat_acceptance, broker_addresses, headers_last, headers_flat, headers_changed, create_topics_validation, metadata_diff,
            compress_roundtrip, compression_ratio, codec_roundtrip, stream_append_counts,
        )
    }
