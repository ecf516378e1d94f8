"""Reference operators against given cases and plain restatements."""

import gzip
import random

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.config import BrokerSettings, ProducerSettings
from tidelog.functions import codecs, headers
from tidelog.functions.hashing import key_partition, murmur2
from tidelog.functions.text import addresses, broker_number, segment_name, topic_partition
from tidelog.operators import assign, batching, catalog, groups, liveness, log
from tidelog.operators.folding import block_summary, enter, fill_block, greedy_fill
from tidelog.operators.order import numbered
from tidelog.operators.routing import route

# key: (signed hash, modulo 3, 4, 6 of its low 31 bits)
HASHES = {
    "a": (-1563381124, 1, 0, 4), "ab": (316155434, 2, 2, 2), "abc": (479470107, 0, 3, 3), "abcd": (-1323649548, 2, 0, 2), "key1": (28543940, 2, 0, 2),
    "key-0": (29210041, 1, 1, 1), "key-9": (-1335190451, 0, 1, 3), "test-key": (-1341026247, 2, 1, 5), "é": (186971271, 0, 3, 3), "日本語": (1431860170, 1, 2, 4),
}


def test_hashes(spark):
    df = spark.createDataFrame([(k,) for k in HASHES], "k string")
    got = df.select("k", murmur2(F.col("k")), *[key_partition(F.col("k"), F.lit(n)) for n in (3, 4, 6)]).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == HASHES
    edge = spark.createDataFrame([("",), (None,)], "k string").select(murmur2(F.col("k")), key_partition(F.col("k"), F.lit(7), 2)).collect()
    assert [tuple(r) for r in edge] == [(275646681, 2), (0, 2)]


def test_routing_precedence(spark):
    topics = spark.createDataFrame([("t", 4), ("one", 1)], "topic string, num_partitions int")
    rows = [(0, "t", 3, "abc"), (1, "t", None, "abc"), (2, "t", -5, "abc"), (3, "t", 4, None), (4, "t", None, ""), (5, "one", None, None), (6, "t", None, None), (7, "no", 0, "k"), (8, "t", 0, None)]
    df = spark.createDataFrame(rows, "seq long, topic string, p int, k string")
    got = {r["seq"]: r["partition"] for r in route(df, topics, "p", "k", "seq").collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 0, 4: 1, 5: 0, 6: 3, 8: 0}


def test_numbers_across_blocks(spark):
    df = spark.range(1000).select((F.col("id") * 3 + 7).alias("o"), F.when(F.col("id") % 3 > 0, "h").when(F.col("id") % 2 == 0, "x").alias("k"))
    got = numbered(df.repartition(5), ["k"], "o", "n", block=100).collect()
    for k in ("h", "x", None):
        mine = sorted((r["o"], r["n"]) for r in got if r["k"] == k)
        assert [n for _, n in mine] == list(range(len(mine)))
    assert len(got) == 1000


def fold(sizes, cap):
    out, used, b = [], cap + 1, -1
    for s in sizes:
        if used + s > cap:
            b, used = b + 1, 0
        out.append((b, used))
        used += s
    return out


@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=40), min_size=1, max_size=6), st.integers(30, 120))
@settings(max_examples=200, deadline=None)
def test_blocks_fold_like_one_run(blocks, cap):
    import numpy as np

    fill, base, got = cap + 1, 0, []
    for b in blocks:
        sizes = np.array(b, np.int64)
        opened, before = fill_block(sizes, cap, fill)
        got += list(zip((opened + base - 1).tolist(), before.tolist(), strict=True))
        fill, bins = enter(block_summary(sizes, cap), fill)
        base += bins
    assert got == fold([s for b in blocks for s in b], cap)


def test_greedy_fill_of_a_hot_key(spark):
    r = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", r.randrange(1, 50) if i % 50 else 1000) for i in range(2000)]
    got = greedy_fill(spark.createDataFrame(rows, "o long, k string, s long"), ["k"], "o", "s", 200, "b", "u", block=64).collect()
    for k in {x[1] for x in rows}:
        mine = sorted((x["o"], x["b"], x["u"]) for x in got if x["k"] == k)
        assert [(b, u) for _, b, u in mine] == fold([s for _, kk, s in rows if kk == k and s <= 200], 200)


def test_batch_capacity_and_config():
    assert fold([100, 900], 1000) == [(0, 0), (0, 100)] and fold([100, 901], 1000)[1] == (1, 0)
    for bad in ({"batch_size": 0}, {"batch_size": 1_048_577}):
        with pytest.raises(ValueError):
            ProducerSettings(**bad)
    with pytest.raises(ValueError):
        BrokerSettings(missed_heartbeats=11)
    assert BrokerSettings().missed_heartbeats == 3 and BrokerSettings().heartbeat_timeout_ms == 5_000
    assert ProducerSettings.of({"linger_ms": "5", "codec": "zstd"}) == ProducerSettings(linger_ms=5, codec="zstd")


BATCH = "batch_no long, topic string, target_partition int, size_bytes long, created_ms long, retries int"
KEYS = ["topic", "target_partition"]


def test_ready_expiry_and_in_flight(spark):
    s = ProducerSettings(batch_size=512, linger_ms=50, delivery_timeout_ms=150, max_in_flight=2)
    df = spark.createDataFrame([(1, "t", 0, 10, 800, 0), (2, "t", 0, 10, 960, 0), (3, "t", 1, 10, 951, 0), (4, "t", 1, 512, 940, 0), (5, "t", 2, 512, 999, 3), (6, "t", 3, 10, 950, 0)], BATCH)
    flight = spark.createDataFrame([("t", 2, 1), ("t", 3, 2)], "topic string, target_partition int, n_in_flight long")
    assert {r["batch_no"] for r in batching.ready(df, KEYS, flight, 1000, s).collect()} == {4, 5}
    state = {r["batch_no"]: (r["is_expired"], r["may_retry"]) for r in batching.with_state(df, 1000, s).collect()}
    assert state[1] == (True, True) and state[5] == (False, False)
    assert batching.with_state(df, 950, s).where("batch_no = 1 and is_expired").isEmpty()  # exactly at the time-out


def test_drain_rotates_and_stops(spark):
    df = spark.createDataFrame([(i, "t", i, 100, 0, 0) for i in range(4)] + [(9, "u", 0, 5, 0, 0)], BATCH)
    own = spark.createDataFrame([("t", i, "b") for i in range(4)] + [("u", 0, None)], "topic string, target_partition int, broker_id string")
    cursors = spark.createDataFrame([("b", 6)], "broker_id string, cursor long")
    got = lambda most: [r["batch_no"] for r in sorted(batching.drain(df, own, cursors, KEYS, most).collect(), key=lambda r: r["drain_no"])]
    assert got(300) == [2, 3, 0] and got(50) == [2] and got(10_000) == [2, 3, 0, 1]


def assigned(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["member"], {}).setdefault(r["topic"], []).append(r["partition"])
    return {m: {t: sorted(ps) for t, ps in ts.items()} for m, ts in out.items()}


def frames(spark, members, topics):
    return spark.createDataFrame([(m,) for m in members], "member string"), spark.createDataFrame(list(topics.items()), "topic string, num_partitions int")


@pytest.mark.parametrize(
    ("members", "topics", "want"),
    [
        ("cab", {"t": 6}, {"a": {"t": [0, 1]}, "b": {"t": [2, 3]}, "c": {"t": [4, 5]}}),
        ("cab", {"t": 5}, {"a": {"t": [0, 1]}, "b": {"t": [2, 3]}, "c": {"t": [4]}}),
        ("cba", {"bar": 2, "foo": 5}, {"a": {"foo": [0, 1], "bar": [0]}, "b": {"foo": [2, 3], "bar": [1]}, "c": {"foo": [4]}}),
        ("DCBA", {"t": 2}, {"A": {"t": [0]}, "B": {"t": [1]}}),
        ("ab", {"t": 0, "u": -1}, {}),
        ("", {"t": 3}, {}),
        ("ab", {}, {}),
    ],
)
def test_range(spark, members, topics, want):
    assert assigned(assign.assign_range(*frames(spark, members, topics))) == want


@pytest.mark.parametrize(
    ("members", "topics", "want"),
    [
        (["c", "a", "b"], {"orders": 6}, {"a": {"orders": [0, 3]}, "b": {"orders": [1, 4]}, "c": {"orders": [2, 5]}}),
        (["m2", "m1"], {"beta": 3, "alpha": 2}, {"m1": {"alpha": [0], "beta": [0, 2]}, "m2": {"alpha": [1], "beta": [1]}}),
        (list("ABCD"), {"t": 2}, {"A": {"t": [0]}, "B": {"t": [1]}}),
        ([], {"t": 2}, {}),
        (["a"], {}, {}),
    ],
)
def test_round_robin(spark, members, topics, want):
    assert assigned(assign.assign_round_robin(*frames(spark, members, topics))) == want


def heap_sticky(members, topics, previous):
    """The sticky algorithm step by step."""
    parts = [(t, p) for t in sorted(topics) for p in range(topics[t])]
    if not parts or not members:
        return {}
    share, taken, out = -(-len(parts) // len(members)), set(), {m: [] for m in sorted(members)}
    for m in sorted(members):
        for tp in previous.get(m, []):
            if tp in parts and tp not in taken and len(out[m]) < share:
                out[m].append(tp)
                taken.add(tp)
    for tp in parts:
        if tp not in taken:
            m = min(out, key=lambda x: (len(out[x]), x))
            out[m].append(tp)
    return {m: sorted(tps) for m, tps in out.items() if tps}


def sticky(spark, members, topics, previous):
    rows = [(m, t, p, i) for m, tps in previous.items() for i, (t, p) in enumerate(tps)]
    prev = spark.createDataFrame(rows, "member string, topic string, partition int, topic_pos int")
    got = {}
    for r in assign.assign_sticky(*frames(spark, members, topics), prev).collect():
        got.setdefault(r["member"], []).append((r["topic"], r["partition"]))
    return {m: sorted(tps) for m, tps in got.items()}


def test_sticky(spark):
    r = random.Random(4)
    assert sticky(spark, "abc", {"t": 4}, {"a": [("t", 0), ("t", 1)], "b": [("t", 2), ("t", 3)]}) == {"a": [("t", 0), ("t", 1)], "b": [("t", 2), ("t", 3)]}
    assert sticky(spark, "", {"t": 4}, {}) == {} and sticky(spark, "a", {}, {}) == {}
    for _ in range(6):
        members = r.sample("abcdefg", r.randrange(1, 7))
        topics = {t: r.randrange(0, 9) for t in r.sample("xyz", r.randrange(1, 4))}
        parts = [(t, p) for t in topics for p in range(topics[t] + 1)]
        r.shuffle(parts)
        previous: dict = {}
        for tp in parts[: r.randrange(0, len(parts) + 1)]:
            previous.setdefault(r.choice("abcdefgh"), []).append(tp)
        assert sticky(spark, members, topics, previous) == heap_sticky(members, topics, previous)


def test_assignor_by_name_and_wire_text(spark):
    assert assign.assignor("RoundRobin") is assign.assign_round_robin and assign.assignor(None) is assign.assign_range
    df = spark.createDataFrame([("m", "t", 1), ("m", "t", 0), ("m", "t2", 3), ("n", "t", 10), ("n", "t", 2)], "member string, topic string, partition int")
    text = assign.encoded(df)
    assert text.first()[0] == "m:t=0,1;t2=3||n:t=2,10"
    back = text.select(F.explode(assign.decoded(F.col("text"))).alias("a")).select("a.*").collect()
    assert {tuple(r) for r in back} == {tuple(r) for r in df.collect()}


def test_join_round(spark):
    rows = [("g", "b", ["x", "y"], 1), ("g", "a", ["y", "x"], 2), ("g", "b", ["z", "y", "x"], 3), ("h", "a", ["x"], 4), ("h", "b", ["y"], 5), ("h", "", ["y"], 6), ("i", "a", [], 7)]
    got = {r["group_id"]: tuple(r)[1:] for r in groups.join_round(spark.createDataFrame(rows, "group_id string, member string, protocols array<string>, arrival long")).collect()}
    assert got == {"g": ("b", 2, 1, "y", "SUCCESS"), "h": ("a", 3, -1, None, "INCOMPATIBLE_PROTOCOL"), "i": ("a", 1, -1, None, "INCOMPATIBLE_PROTOCOL")}


def test_catalogue(spark):
    topics = spark.createDataFrame([("old", 3, 1)], "topic string, num_partitions int, replication_factor int")
    bad = spark.createDataFrame([("old", 1, 1), ("", 1, 1), ("x", 0, 1), ("y", 1, 4), ("z", 1, 0), ("d", 1, 1), ("d", 1, 1)], topics.schema)
    got = sorted((r["topic"], r["reject"]) for r in catalog.validate_topics(bad, topics).collect())
    assert got == [("", "blank name"), ("d", "requested twice"), ("d", "requested twice"), ("old", "exists"), ("x", "no partitions"), ("y", "replication factor"), ("z", None)]
    with pytest.raises(ValueError):
        catalog.create_topics(topics, bad)
    more = catalog.create_topics(topics, bad.where("topic = 'z'"))
    assert {r["topic"] for r in more.collect()} == {"old", "z"}
    assert {r["topic"] for r in catalog.delete_topics(more, spark.createDataFrame([("old",)], "topic string")).collect()} == {"z"}
    b = spark.createDataFrame([("1", "h", 1, 3), ("2", "h", 1, 4)], "broker_id string, host string, port int, num_partitions int")
    newer = catalog.register_brokers(b, b.where("broker_id = '1'").withColumn("host", F.lit("g")))
    assert {tuple(r) for r in newer.collect()} == {("1", "g", 1, 0), ("2", "h", 1, 4)}
    ups = spark.createDataFrame([("1", i, n, h) for i, (n, h) in enumerate([(3, "a"), (4, "b"), (4, "c"), (None, "d"), (None, "e")])], "broker_id string, at int, num_partitions int, host string")
    assert [r["host"] for r in catalog.update_brokers(ups, ["broker_id"], "at").collect()] == ["d"]
    assert [r["host"] for r in catalog.update_brokers(ups.where("at < 3"), ["broker_id"], "at").collect()] == ["b"]
    assert catalog.decommission(newer, b.where("broker_id = '1'")).count() == 1


def test_contested_claims_go_to_who_has_room(spark):
    previous = {"A": [("t", 0), ("t", 1)], "C": [("t", 1)]}
    assert sticky(spark, "ABC", {"t": 3}, previous) == heap_sticky("ABC", {"t": 3}, previous) == {"A": [("t", 0)], "B": [("t", 2)], "C": [("t", 1)]}


def test_owners_are_those_of_each_cluster(spark):
    rows = [("a", 9, "t", 0, "b1"), ("a", 8, "t", 0, "b0"), ("a", 8, "t", 1, "b0"), ("z", 2, "t", 0, "b7"), ("z", 2, "t", 0, None), ("z", 2, "t", 1, None)]
    df = spark.createDataFrame(rows, "controller_id string, snapshot_no long, topic string, target_partition int, broker_id string")
    assert {tuple(r) for r in catalog.owners(df).collect()} == {("a", "t", 0, "b1"), ("z", "t", 0, "b7"), ("z", "t", 1, None)}


def test_failed_batches_come_back_at_the_front(spark):
    q = spark.createDataFrame([("t", 0, n, n * 10, r) for n, r in ((1, 0), (2, 3), (3, 2), (4, 0), (5, 1))], "topic string, target_partition int, batch_no long, created_ms long, retries int")
    failed = spark.createDataFrame([(1, 100), (2, 101), (3, 102)], "batch_no long, failed_ms long")
    got = {r["batch_no"]: (r["place"], r["retries"], r["is_dropped"]) for r in batching.requeue(q, failed, ["topic", "target_partition"], ProducerSettings()).collect()}
    assert got == {3: (1, 3, False), 1: (2, 1, False), 4: (3, 0, False), 5: (4, 1, False), 2: (None, 3, True)}


def test_generations_count_rounds(spark):
    joins = spark.createDataFrame([("g", "a", ["x", "y"], 1), ("g", "b", ["y"], 2), ("g", "a", ["x"], 5), ("g", "b", [], 6), ("g", "c", ["y"], 9), ("g", "d", ["x"], 10), ("g", "e", ["z"], 20)], "group_id string, member string, protocols array<string>, arrival long")
    closes = spark.createDataFrame([("g", 3), ("g", 7), ("g", 8), ("g", 15)], "group_id string, arrival long")
    got = [tuple(r)[:5] for r in groups.join_rounds(joins, closes).orderBy("round").collect()]
    assert got == [("g", "a", 2, 1, "y"), ("g", "a", 1, 2, "x"), ("g", "c", 2, -1, None), ("g", "e", 1, 4, "z")]


def test_liveness(spark):
    s = BrokerSettings(heartbeat_interval_ms=1000, missed_heartbeats=3)
    rows = [("BROKER-1", "h", 5000, 1, 1, 4, 1, 1, 1.0), ("BROKER-1", "h", 3000, 0, 2, 5, 1, 1, 1.0), ("BROKER-2", "h", 2999, 1, 3, 1, 1, 1, 1.0), ("BROKER-0", " ", None, 1, 4, 9, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "broker_id string, host string, timestamp_ms long, sequence_number long, arrival_seq long, partition_count int, connection_count int, available_memory long, cpu_usage double")
    live = liveness.alive(df, 6000, s)
    assert {r["broker_id"]: (r["last_ms"], r["is_alive"]) for r in live.collect()} == {"BROKER-1": (3000, True), "BROKER-2": (2999, False), "BROKER-0": (None, False)}
    assert tuple(liveness.least_loaded(live).first()) == ("BROKER-1", 5)
    assert liveness.least_loaded(live.where("false")).collect() == []
    assert [r["is_accepted"] for r in liveness.accepted(df).collect()] == [True, True, True, False]


@pytest.mark.parametrize("codec", codecs.CODECS)
def test_codecs(codec):
    for data in (b"A" * 1000, b'{"a": 1}\n' * 1000, b"x", bytes(range(256))):
        assert codecs.decompress_bytes(codec, codecs.compress_bytes(codec, data)) == data
    assert codecs.compress_bytes(codec, b"") == b"" and codecs.compress_bytes(codec, None) is None
    if codec != "none":
        assert len(codecs.compress_bytes(codec, b"A" * 1000)) < 100
    assert codecs.codec_name(codecs.codec_id(codec.upper())) == codec
    data = b"some records " * 50
    if codec == "gzip":
        assert gzip.decompress(codecs.compress_bytes(codec, data)) == data and codecs.decompress_bytes(codec, gzip.compress(data[:99]) + gzip.compress(data[99:])) == data
    if codec == "zstd":
        assert zstandard.decompress(codecs.compress_bytes(codec, data)) == data and codecs.decompress_bytes(codec, zstandard.compress(data)) == data
        with pytest.raises(ValueError):
            codecs.decompress_bytes(codec, zstandard.ZstdCompressor(write_content_size=False).compress(data))
    if codec == "lz4":
        assert codecs.compress_bytes(codec, data)[:4] == len(data).to_bytes(4, "big")
    for bad in (lambda: codecs.codec_id("invalid"), lambda: codecs.codec_name(99), lambda: codecs.decompress_bytes("zstd", b"\0\0\0\0abc")):
        with pytest.raises(ValueError):
            bad()


def test_headers(spark):
    h = F.array(*[F.struct(F.lit(k).alias("header_key"), F.encode(F.lit(v), "UTF-8").alias("header_value")) for k, v in (("a", "1"), ("b", "2"), ("a", "3"))])
    row = spark.range(1).select(
        headers.flat(h).alias("flat"), headers.last(h, F.lit("a")).alias("last"), headers.last(h, F.lit("z")).alias("none"),
        headers.remove(h, F.lit("a")).alias("left"), headers.add(h, F.lit("c"), F.encode(F.lit("9"), "UTF-8")).alias("more"),
    ).first()
    assert [(x[0], bytes(x[1])) for x in row["flat"]] == [("a", b"1"), ("a", b"3"), ("b", b"2")]
    assert bytes(row["last"]) == b"3" and row["none"] is None and len(row["left"]) == 1 and row["more"][-1][0] == "c"


def test_text_forms(spark):
    row = spark.range(1).select(
        broker_number(F.lit("BROKER-12")), broker_number(F.lit("x")), topic_partition(F.lit("t"), F.lit(3)), segment_name(F.lit("t"), F.lit(1), F.lit(42)), addresses(F.lit("a:1, b:2,c")),
    ).first()
    assert tuple(row)[:4] == (12, None, "t-3", "data/t_partition1_00042.log")
    assert [tuple(a) for a in row[4]] == [("a", 1), ("b", 2), ("c", None)]


def test_reads_and_lag(spark):
    records = spark.range(10).select(F.lit("t").alias("topic"), F.lit(0).alias("target_partition"), F.col("id").alias("seq"), F.col("id").alias("timestamp_ms"), F.lit("k").alias("record_key"), F.lit("v").alias("record_value"))
    marks = spark.createDataFrame([("t", 0, 100)], "topic string, target_partition int, next_offset long")
    stored = log.assign_offsets(records, KEYS, "seq", marks)
    bounds = log.log_bounds(stored, KEYS)
    assert tuple(bounds.first()) == ("t", 0, 10, 100, 110)
    asked = spark.createDataFrame([("t", 0, 104), ("t", 0, 110)], "topic string, target_partition int, offset long")
    assert {(r["offset"], r["status"], r["timestamp_ms"], r["next_offset"]) for r in log.fetch(stored, asked, KEYS).collect()} == {(104, "SUCCESS", 4, 105), (110, "READ_COMPLETION", None, 111)}
    at = spark.createDataFrame([("t", 0, 108)], "topic string, target_partition int, position long")
    assert sorted(r["offset"] for r in log.poll(stored, at, KEYS, 5).collect()) == [108, 109]
    commits = spark.createDataFrame([("t", 0, 103, 9), ("t", 0, 105, 7)], "topic string, target_partition int, offset long, commit_ts long")
    assert log.lag(bounds, log.latest_commits(commits, KEYS), KEYS).first()["lag"] == 6
    assert log.lag(bounds, log.latest_commits(commits.where("false"), KEYS), KEYS).first()["lag"] == 10
