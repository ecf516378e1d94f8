import time

from pyspark.sql import functions as F

from tidelog.config import BrokerSettings
from tidelog.operators.log import log_bounds
from tidelog.runtime import remove
from tidelog.sources.log_store import (
    RECORDS_IN, append, commit_offsets, decode, encode, fetch_offsets, high_water_marks, read_from, read_log, read_records, stored_log, stream_records, tail_log,
)
from tidelog.streaming.heartbeats import heartbeat_stream, heartbeats
from tidelog.streaming.ingest import KEYS, appender, ingest_all, marks_before
from tidelog.streaming.late import period_counts
from tidelog.streaming.liveness import liveness_changes


def fresh(tmp_path, name):
    return str(tmp_path / name)


def write(spark, folder, start, n):
    rows = spark.range(start, start + n).select(
        F.lit("t").alias("topic"), (F.col("id") % 2).cast("int").alias("target_partition"), (F.col("id") * 60_000).alias("timestamp_ms"),
        F.lit("k").alias("record_key"), F.col("id").cast("string").alias("record_value"),
        F.lit(None).cast(RECORDS_IN["headers"].dataType).alias("headers"), F.col("id").alias("arrival_seq"),
    )
    rows.coalesce(1).write.mode("append").parquet(folder)


def test_stream_goes_on_from_the_log(spark, tmp_path):
    source, target = fresh(tmp_path, "in"), fresh(tmp_path, "out")
    write(spark, source, 0, 11)
    path = ingest_all(stream_records(spark, source), target)
    write(spark, source, 11, 6)
    ingest_all(stream_records(spark, source), target)
    log = read_log(spark, path)
    assert {tuple(r) for r in log_bounds(log, KEYS).collect()} == {("t", 0, 9, 0, 9), ("t", 1, 8, 0, 8)}
    assert log.where("target_partition = 1 and offset = 7").first()["arrival_seq"] == 15


def test_a_batch_that_comes_again_is_stored_once(spark, tmp_path):
    source, target = fresh(tmp_path, "in"), fresh(tmp_path, "out")
    write(spark, source, 0, 4)
    run = appender(f"{target}/log", "arrival_seq")
    for number in (0, 1, 1):
        run(read_records(spark, source), number)
    log = read_log(spark, f"{target}/log")
    assert {(r["target_partition"], r["next_offset"]) for r in high_water_marks(log).collect()} == {(0, 4), (1, 4)}
    assert log.count() == 8


def test_plain_append_and_wire_rows(spark, tmp_path):
    source, target = fresh(tmp_path, "in"), fresh(tmp_path, "out")
    write(spark, source, 0, 4)
    rows = read_records(spark, source)
    append(rows, target)
    append(rows, target)
    assert read_log(spark, target).count() == 8
    back = decode(encode(rows, ["arrival_seq", "record_value"]), "arrival_seq long, record_value string")
    assert {tuple(r) for r in back.collect()} == {(i, str(i)) for i in range(4)}


def test_late_counts_as_a_stream(spark, tmp_path):
    source = fresh(tmp_path, "in")
    write(spark, source, 0, 130)
    query = period_counts(stream_records(spark, source)).writeStream.outputMode("update").format("memory").queryName("late_counts").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["period_start_ms"]: r["n"] for r in spark.table("late_counts").collect()}
    assert got == {0: 60, 3_600_000: 60, 7_200_000: 10}


def test_liveness_as_a_stream(spark, tmp_path):
    source = fresh(tmp_path, "in")
    rows = [("a", 1_000), ("a", 2_000), ("a", 9_000), ("b", 1_000), ("c", None), ("z", 100_000)]
    df = spark.createDataFrame(rows, "broker_id string, timestamp_ms long")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    changes = liveness_changes(stream, BrokerSettings(heartbeat_interval_ms=1000, missed_heartbeats=3), "0 seconds")
    changes.writeStream.outputMode("append").format("memory").queryName("liveness").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.table("liveness").collect()}
    assert {("a", 1_000, True), ("a", 5_001, False), ("a", 9_000, True), ("b", 1_000, True), ("z", 100_000, True)} <= got
    assert got - {("a", 12_001, False), ("b", 4_001, False)} == {("a", 1_000, True), ("a", 5_001, False), ("a", 9_000, True), ("b", 1_000, True), ("z", 100_000, True)}


def test_topics_that_look_like_numbers(spark, tmp_path):
    rows = spark.createDataFrame([("007", 0, 0), ("012", 1, 0)], "topic string, target_partition int, offset long")
    append(rows, fresh(tmp_path, "log"))
    append(rows, fresh(tmp_path, "log"), 3)
    log = read_log(spark, fresh(tmp_path, "log"))
    assert {(r["topic"], r["batch"]) for r in log.collect()} == {(t, b) for t in ("007", "012") for b in (-1, 3)}


def test_reads_prune_partitions_and_push_offsets(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("t"), F.col("id") % 3).alias("topic"), (F.col("id") % 2).cast("int").alias("target_partition"), F.floor(F.col("id") / 6).alias("offset"), F.col("id"))
    log = stored_log(rows, fresh(tmp_path, "log"))
    some = read_from(log, "t1", 1, 20, 3)
    assert sorted(r["offset"] for r in some.collect()) == [20, 21, 22]
    plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "(topic" in plan.split("PartitionFilters")[1].split("\n")[0] and "GreaterThanOrEqual(offset,20)" in plan.split("PushedFilters")[1].split("\n")[0]
    tail = tail_log(spark, fresh(tmp_path, "log"), log.schema).groupBy("topic").count()
    tail.writeStream.outputMode("complete").format("memory").queryName("tail").trigger(availableNow=True).start().awaitTermination()
    assert {r["topic"]: r["count"] for r in spark.table("tail").collect()} == {"t0": 334, "t1": 333, "t2": 333}


def test_a_batch_reads_marks_instead_of_the_log(spark, tmp_path):
    source, target = fresh(tmp_path, "in"), fresh(tmp_path, "log")
    write(spark, source, 0, 4)
    run = appender(target, "arrival_seq")
    for number in range(3):
        run(read_records(spark, source), number)
        remove(spark, f"{target}/batch={number}")
    assert {tuple(r) for r in marks_before(spark, target, 3).collect()} == {("t", 0, 6), ("t", 1, 6)}
    assert marks_before(spark, target, 0) is None
    append(read_records(spark, source).withColumn("offset", F.col("arrival_seq")), fresh(tmp_path, "plain"))
    assert {tuple(r) for r in marks_before(spark, fresh(tmp_path, "plain"), 0).collect()} == {("t", 0, 3), ("t", 1, 4)}


def test_rejects_get_no_offset(spark, tmp_path):
    source, target = fresh(tmp_path, "in"), fresh(tmp_path, "out")
    write(spark, source, 0, 12)
    topics = spark.createDataFrame([("t", 1)], "topic string, num_partitions int")
    path = ingest_all(stream_records(spark, source), target, topics=topics, largest=23)
    assert sorted((r["arrival_seq"], r["offset"]) for r in read_log(spark, path).collect()) == [(i, i // 2) for i in (0, 2, 4, 6, 8)]
    rejects = {r["arrival_seq"]: r["reject"] for r in spark.read.parquet(f"{path}-rejects").collect()}
    assert rejects == {i: "invalid partition" for i in (1, 3, 5, 7, 9, 11)} | {10: "oversize"}


def test_commits(spark, tmp_path):
    rows = [("g", "t", 0, 5, 10), ("g", "t", 0, 4, 11), ("g", "t", 0, 3, 11), ("h", "t", 0, 1, 1)]
    commit_offsets(spark.createDataFrame(rows[:2], "group_id string, topic string, target_partition int, offset long, commit_ts long"), fresh(tmp_path, "c"))
    commit_offsets(spark.createDataFrame(rows[2:], "group_id string, topic string, target_partition int, offset long, commit_ts long"), fresh(tmp_path, "c"))
    assert {tuple(r) for r in fetch_offsets(spark, fresh(tmp_path, "c")).collect()} == {("g", "t", 0, 4), ("h", "t", 0, 1)}


def test_heartbeats_as_a_source(spark, tmp_path):
    df = heartbeats(spark.createDataFrame([("b1",), ("b2",), ("b1",), (None,)], "broker_id string"), 1000, 10, 3)
    assert {(r["broker_id"], r["sequence_number"], r["timestamp_ms"]) for r in df.collect()} == {(b, n, 1000 + 10 * n) for b in ("b1", "b2") for n in range(3)}
    assert all(0 <= r["cpu_usage"] <= 100 for r in df.collect())
    stream = heartbeat_stream(spark, 2, 100)
    assert stream.isStreaming and stream.columns == df.columns
    query = stream.writeStream.format("memory").queryName("beats").start()
    for _ in range(100):
        if query.lastProgress and spark.table("beats").count():
            break
        time.sleep(0.1)
    query.stop()
    assert {r["broker_id"] for r in spark.table("beats").collect()} <= {"BROKER-1", "BROKER-2"}
