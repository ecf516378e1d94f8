"""The reference queries in plain SQL for DuckDB."""

from __future__ import annotations

#: The moment at which batches and brokers are looked at.
NOW_MS = 1_704_400_000_000

# The size of a record's fields (rows of records_in).
SIZE = """(20 + octet_length(encode(topic)) + coalesce(octet_length(encode(record_key)), 0) + coalesce(octet_length(encode(record_value)), 0)
  + coalesce(list_sum(list_transform(headers, lambda h: coalesce(octet_length(encode(h.header_key)), 0) + coalesce(octet_length(h.header_value), 0))), 0))::BIGINT"""

# Why records can't be stored, and the others with their offsets.
_WHY = """CASE WHEN trim(topic) = '' OR topic IS NULL THEN 'no topic' WHEN num_partitions IS NULL THEN 'unknown topic'
  WHEN target_partition IS NULL OR target_partition < 0 OR target_partition >= num_partitions THEN 'invalid partition'
  WHEN size_bytes <= 20 + octet_length(encode(topic)) THEN 'empty' WHEN size_bytes > {cap} THEN 'oversize' END"""


def _checked(cap: int) -> str:
    return f"""sized AS (SELECT records_in.*, num_partitions, {SIZE} AS size_bytes FROM records_in LEFT JOIN topics USING (topic)),
checked AS (SELECT *, {_WHY.format(cap=cap)} AS reject FROM sized)"""


def _log(cap: int = 524_288) -> str:
    return f"""{_checked(cap)},
log AS (SELECT *, row_number() OVER (PARTITION BY topic, target_partition ORDER BY arrival_seq) - 1 AS "offset" FROM checked WHERE reject IS NULL)"""


LOG = _log()
BOUNDS = """bounds AS (SELECT topic, target_partition, count(*) AS n_records, min("offset") AS start_offset, max("offset") + 1 AS end_offset FROM log GROUP BY ALL)"""

# MurmurHash2 of the bytes of record_key, by 64-bit arithmetic that is cut to 32 bits.
_BYTE = "('0x' || substr(x, 2 * ({i}) + 1, 2))::BIGINT"


def _word(i: str) -> str:
    return " + ".join(f"{_BYTE.format(i=f'{i} + {k}')} * {256**k}" for k in range(4))


MURMUR = f"""
b AS (SELECT arrival_seq, topic, record_key, hex(encode(record_key)) AS x, octet_length(encode(record_key)) AS n FROM records_in WHERE record_key IS NOT NULL),
k1 AS (SELECT *, list_transform(range(0, n // 4), lambda i: (({_word('4 * i')}) * 1540483477) & 4294967295) AS ks FROM b),
k2 AS (SELECT *, list_transform(ks, lambda k: (xor(k, k >> 24) * 1540483477) & 4294967295) AS kk FROM k1),
h1 AS (SELECT *, list_reduce(list_prepend(xor(2538058380::BIGINT, n::BIGINT), kk), lambda h, k: xor((h * 1540483477) & 4294967295, k)) AS h FROM k2),
t AS (SELECT *, CASE WHEN n % 4 >= 3 THEN {_BYTE.format(i='n // 4 * 4 + 2')} * 65536 ELSE 0 END
     + CASE WHEN n % 4 >= 2 THEN {_BYTE.format(i='n // 4 * 4 + 1')} * 256 ELSE 0 END + CASE WHEN n % 4 >= 1 THEN {_BYTE.format(i='n // 4 * 4')} ELSE 0 END AS tail FROM h1),
h2 AS (SELECT *, CASE WHEN n % 4 > 0 THEN (xor(h, tail) * 1540483477) & 4294967295 ELSE h END AS g FROM t),
h3 AS (SELECT *, (xor(g, g >> 13) * 1540483477) & 4294967295 AS e FROM h2),
hashed AS (SELECT arrival_seq, topic, record_key, xor(e, e >> 15) AS u FROM h3)"""

ROUTED = f"""{MURMUR},
want AS (SELECT arrival_seq, topic, record_key, CASE WHEN batch_no % 3 = 0 THEN batch_no % 13 - 2 END AS explicit, num_partitions FROM records_in JOIN topics USING (topic)),
direct AS (SELECT w.*, CASE WHEN explicit >= 0 AND explicit < num_partitions THEN explicit WHEN w.record_key <> '' THEN (u & 2147483647) % num_partitions END AS p
           FROM want w LEFT JOIN hashed h USING (arrival_seq)),
routed AS (SELECT arrival_seq, topic, p::INT AS partition FROM direct WHERE p IS NOT NULL UNION ALL
           SELECT arrival_seq, topic, ((row_number() OVER (ORDER BY arrival_seq) - 1) % num_partitions)::INT FROM direct WHERE p IS NULL)"""


def _fold(cap: int) -> str:
    """Bins of greedy filling: bin and used bytes of each record, one record per partition and step."""
    return f"""{_log(cap)},
small AS (SELECT *, row_number() OVER (PARTITION BY topic, target_partition ORDER BY arrival_seq) AS i FROM log WHERE size_bytes <= {cap}),
fold AS (SELECT topic, target_partition, arrival_seq, "offset", size_bytes, i, 0::BIGINT AS bin, 0::BIGINT AS before FROM small WHERE i = 1
  UNION ALL
  SELECT s.topic, s.target_partition, s.arrival_seq, s."offset", s.size_bytes, s.i,
    CASE WHEN f.before + f.size_bytes + s.size_bytes > {cap} THEN f.bin + 1 ELSE f.bin END,
    CASE WHEN f.before + f.size_bytes + s.size_bytes > {cap} THEN 0 ELSE f.before + f.size_bytes END
  FROM fold f JOIN small s ON s.topic = f.topic AND s.target_partition = f.target_partition AND s.i = f.i + 1)"""


IN_FLIGHT = "flight AS (SELECT topic, target_partition, count(DISTINCT batch_no) AS n_in_flight FROM records_in WHERE ack_status IS NULL GROUP BY ALL)"
READY = f"""{IN_FLIGHT},
live AS (SELECT *, {NOW_MS} - created_ms AS age_ms FROM batches WHERE {NOW_MS} - created_ms BETWEEN 0 AND 21600000),
heads AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY topic, target_partition ORDER BY created_ms, batch_no) = 1),
ready AS (SELECT h.* FROM heads h LEFT JOIN flight f USING (topic, target_partition) WHERE (size_bytes >= 1024 OR age_ms >= 60000) AND coalesce(n_in_flight, 0) < 5)"""
OWNERS = """owners AS (SELECT controller_id, topic, target_partition, max(broker_id) AS broker_id
  FROM snap_partitions JOIN (SELECT controller_id, max(snapshot_no) AS snapshot_no FROM snap_partitions GROUP BY ALL) USING (controller_id, snapshot_no) GROUP BY ALL)"""

MEMBERS = "mem AS (SELECT n_name AS member, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS m FROM nation{where})"
UNIVERSE = "uni AS (SELECT topic, unnest(range(0, num_partitions))::INT AS partition FROM topics)"
RANGE = """pairs AS (SELECT member, topic, num_partitions // m AS base, num_partitions % m AS extra, i FROM mem, topics),
rng AS (SELECT member, topic, unnest(range(i * base + least(i, extra), i * base + least(i, extra) + base + (i < extra)::INT))::INT AS partition FROM pairs)"""
ROBIN = """deal AS (SELECT *, row_number() OVER (ORDER BY topic, partition) - 1 AS place FROM uni),
rob AS (SELECT member, topic, partition FROM deal JOIN mem ON place % m = i)"""
STICKY = """share AS (SELECT ceil((SELECT count(*) FROM uni) / (SELECT count(*) FROM now))::BIGINT AS s),
keep AS (SELECT member, topic, partition FROM prev JOIN now USING (member) JOIN uni USING (topic, partition)
  QUALIFY row_number() OVER (PARTITION BY member ORDER BY topic, partition) <= (SELECT s FROM share)),
loads AS (SELECT member, count(topic) AS load FROM now LEFT JOIN keep USING (member) GROUP BY member),
slots AS (SELECT member, level, row_number() OVER (ORDER BY level, member) AS n FROM (SELECT member, unnest(range(load, (SELECT s FROM share))) AS level FROM loads)),
rest AS (SELECT *, row_number() OVER (ORDER BY topic, partition) AS n FROM uni ANTI JOIN keep USING (topic, partition))
SELECT member, topic, partition FROM keep UNION ALL SELECT member, topic, partition FROM rest JOIN slots USING (n)"""

LATEST = """latest AS (SELECT * FROM heartbeats QUALIFY row_number() OVER (PARTITION BY broker_id ORDER BY arrival_seq DESC) = 1),
live AS (SELECT *, coalesce(1704400000000 - timestamp_ms <= 600000, false) AS is_alive FROM latest)"""

SQL = {
    "partition_counts": f"""WITH {ROUTED}, o AS (SELECT *, row_number() OVER (PARTITION BY topic, partition ORDER BY arrival_seq) - 1 AS o
  FROM routed JOIN (SELECT arrival_seq, {SIZE} AS b, 20 + octet_length(encode(topic)) AS bare FROM records_in) USING (arrival_seq) WHERE b BETWEEN bare + 1 AND 524288)
SELECT topic, partition, count(*) AS n_records, min(o) AS start_offset, max(o) + 1 AS end_offset FROM o GROUP BY ALL""",
    "route_by_key_hash": f"""WITH {MURMUR}
SELECT r.arrival_seq, coalesce(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END, 0)::INT AS key_hash,
  CASE WHEN r.record_key IS NULL OR r.record_key = '' THEN 0 ELSE (u & 2147483647) % num_partitions END::INT AS partition
FROM records_in r JOIN topics USING (topic) LEFT JOIN hashed h USING (arrival_seq)""",
    "route_precedence": f"WITH {ROUTED} SELECT arrival_seq, topic, partition FROM routed",
    "rejected_records": f"""WITH s AS (SELECT topic, num_partitions, {SIZE} AS size, target_partition FROM records_in LEFT JOIN topics USING (topic)),
p AS (SELECT *, target_partition - (size % 5 = 0)::INT AS p FROM s)
SELECT topic, CASE WHEN trim(topic) = '' OR topic IS NULL THEN 'no topic' WHEN num_partitions IS NULL THEN 'unknown topic'
  WHEN p IS NULL OR p < 0 OR p >= num_partitions THEN 'invalid partition' WHEN size <= 20 + octet_length(encode(topic)) THEN 'empty' WHEN size > 100 THEN 'oversize' END AS reject, count(*) AS n FROM p GROUP BY ALL""",
    "assign_offsets": f'WITH {LOG} SELECT arrival_seq, topic, target_partition, "offset" FROM log',
    "log_bounds": f"WITH {LOG}, {BOUNDS} SELECT * FROM bounds",
    "publish_ack": f'WITH {LOG} SELECT batch_no, max("offset") AS last_offset FROM log GROUP BY batch_no',
    "fetch_at_offset": f"""WITH {LOG}, {BOUNDS}, asked AS (SELECT topic, target_partition, unnest([end_offset // 2, end_offset]) AS "offset" FROM bounds)
SELECT a.topic, a.target_partition, a."offset", timestamp_ms, record_key, record_value, CASE WHEN arrival_seq IS NULL THEN 'READ_COMPLETION' ELSE 'SUCCESS' END AS status,
  a."offset" + 1 AS next_offset FROM asked a LEFT JOIN log USING (topic, target_partition, "offset")""",
    "poll_range": f"""WITH {LOG}, {BOUNDS} SELECT arrival_seq, topic, target_partition, "offset" FROM log JOIN bounds USING (topic, target_partition)
WHERE "offset" >= end_offset // 2 AND "offset" < end_offset // 2 + 10""",
    "consumer_lag": f"""WITH {LOG}, {BOUNDS}, c AS (SELECT topic, target_partition, "offset" AS committed FROM log WHERE ack_status = 'SUCCESS'
  QUALIFY row_number() OVER (PARTITION BY topic, target_partition ORDER BY append_ms DESC, "offset" DESC) = 1)
SELECT topic, target_partition, end_offset, committed, end_offset - coalesce(committed + 1, start_offset) AS lag FROM bounds LEFT JOIN c USING (topic, target_partition)""",
    "segment_roll": f"""WITH RECURSIVE {_fold(16384)}
SELECT topic, target_partition, bin AS segment, min("offset") AS segment_base_offset, count(*) AS n_records, sum(size_bytes)::BIGINT AS n_bytes,
  printf('data/%s_partition%d_%05d.log', topic, target_partition, min("offset")) AS file_name FROM fold GROUP BY topic, target_partition, bin""",
    "offset_index": f"""WITH RECURSIVE {_fold(16384)}
SELECT topic, target_partition, "offset", min("offset") OVER (PARTITION BY topic, target_partition, bin) AS segment_base_offset, before AS byte_pos FROM fold""",
    "flush_groups": f"WITH RECURSIVE {_fold(8192)} SELECT topic, target_partition, max(bin) + 1 AS n_flushes FROM fold GROUP BY ALL",
    "batch_fill": f"""WITH RECURSIVE {_fold(1024)}
SELECT topic, target_partition, bin AS fill_no, count(*) AS n_records, sum(size_bytes)::BIGINT AS n_bytes, min(arrival_seq) AS first_seq FROM fold GROUP BY topic, target_partition, bin""",
    "fill_rejects": f"""WITH caps(fill, cap) AS (VALUES ('batch', 1024), ('flush', 8192), ('segment', 16384)),
why AS (SELECT arrival_seq, topic, target_partition, size_bytes, fill, CASE WHEN topic IS NULL OR target_partition IS NULL THEN 'no key' WHEN arrival_seq IS NULL THEN 'no order'
  WHEN size_bytes IS NULL THEN 'no size' WHEN size_bytes > cap THEN 'oversize' END AS reject FROM (SELECT *, {SIZE} AS size_bytes FROM records_in) log, caps) SELECT * FROM why WHERE reject IS NOT NULL""",
    "in_flight": f"WITH {IN_FLIGHT} SELECT * FROM flight",
    "batch_ready": f"WITH {READY} SELECT topic, target_partition, batch_no FROM ready",
    "batch_expired": f"SELECT batch_no, {NOW_MS} - created_ms AS age_ms, retries < 3 AS may_retry FROM batches WHERE {NOW_MS} - created_ms > 21600000",
    "drain_request": f"""WITH {READY}, {OWNERS},
mine AS (SELECT * FROM owners WHERE controller_id = (SELECT min(controller_id) FROM owners)),
own AS (SELECT r.*, broker_id, row_number() OVER (PARTITION BY broker_id ORDER BY topic, target_partition) - 1 AS i, count(*) OVER (PARTITION BY broker_id) AS n,
  regexp_replace(broker_id, '[^0-9]', '', 'g')::BIGINT AS c FROM ready r JOIN mine USING (topic, target_partition) WHERE broker_id IS NOT NULL),
turn AS (SELECT *, ((i - c) % n + n) % n AS drain_no FROM own),
run AS (SELECT *, (sum(size_bytes) OVER (PARTITION BY broker_id ORDER BY drain_no))::BIGINT AS run_bytes FROM turn)
SELECT broker_id, topic, target_partition, batch_no, drain_no, run_bytes FROM run WHERE run_bytes <= 2048 OR drain_no = 0""",
    "partition_owner": f"WITH {OWNERS}, {UNIVERSE} SELECT topic, partition, broker_id FROM uni LEFT JOIN owners ON owners.topic = uni.topic AND target_partition = partition".replace(
        "SELECT topic, partition, broker_id FROM uni", "SELECT uni.topic, partition, controller_id, broker_id FROM uni"
    ),
    "broker_partitions": f"""WITH {OWNERS} SELECT controller_id, broker_id, count(*) AS n_partitions, string_agg(topic || '-' || target_partition, ' ' ORDER BY topic, target_partition) AS partitions
FROM owners WHERE broker_id IS NOT NULL GROUP BY controller_id, broker_id""",
    "assign_range": f"WITH {MEMBERS.format(where='')}, {RANGE} SELECT * FROM rng",
    "assign_round_robin": f"WITH {MEMBERS.format(where='')}, {UNIVERSE}, {ROBIN} SELECT * FROM rob",
    "assign_sticky_initial": f"WITH now AS (SELECT n_name AS member FROM nation), prev AS (SELECT member, '' AS topic, 0 AS partition FROM now WHERE false), {UNIVERSE}, {STICKY}",
    "assign_sticky_leave": f"WITH {MEMBERS.format(where='')}, {UNIVERSE}, {ROBIN}, prev AS (SELECT * FROM rob), now AS (SELECT n_name AS member FROM nation WHERE n_regionkey <> 0), {STICKY}",
    "assign_sticky_join": f"WITH {MEMBERS.format(where=' WHERE n_regionkey <> 0')}, {UNIVERSE}, {RANGE}, prev AS (SELECT * FROM rng), now AS (SELECT n_name AS member FROM nation), {STICKY}",
    "assignment_encoded": f"""WITH {MEMBERS.format(where='')}, {RANGE},
t AS (SELECT member, topic, string_agg(partition::VARCHAR, ',' ORDER BY partition) AS ids FROM rng GROUP BY ALL),
m AS (SELECT member, string_agg(topic || '=' || ids, ';' ORDER BY topic) AS x FROM t GROUP BY ALL)
SELECT string_agg(member || ':' || x, '||' ORDER BY member) AS text FROM m""",
    "assignment_decoded": f"WITH {MEMBERS.format(where='')}, {RANGE} SELECT * FROM rng",
    "subscription_counts": "SELECT topic, num_partitions FROM topics SEMI JOIN records_in USING (topic)",
    "protocol_choice": """
WITH j AS (SELECT c_mktsegment AS g, c_custkey AS a, c_name AS member, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 3 THEN ['custom']
  WHEN c_custkey % 2 = 0 THEN ['roundrobin', 'range'] ELSE ['range', 'sticky', 'roundrobin'] END AS ps FROM customer),
l AS (SELECT g, arg_min(member, a) AS leader, arg_min(ps, a) AS pref, count(*) AS n FROM j GROUP BY g),
e AS (SELECT g, unnest(ps) AS p FROM j),
s AS (SELECT g, p FROM e JOIN l USING (g) GROUP BY g, p, n HAVING count(*) = n),
b AS (SELECT g, arg_min(p, list_position(pref, p)) AS p FROM s JOIN l USING (g) GROUP BY g)
SELECT g AS group_id, leader, n AS n_members, CASE WHEN p IS NULL THEN -1 ELSE 1 END::INT AS generation, p AS protocol,
  CASE WHEN p IS NULL THEN 'INCOMPATIBLE_PROTOCOL' ELSE 'SUCCESS' END AS status FROM l LEFT JOIN b USING (g)""",
    "broker_latest": f"WITH {LATEST} SELECT broker_id, timestamp_ms AS last_ms, partition_count, connection_count, available_memory FROM latest",
    "broker_liveness": f"WITH {LATEST} SELECT broker_id, timestamp_ms AS last_ms, is_alive FROM live",
    "alive_count": f"WITH {LATEST} SELECT count(*) FILTER (is_alive) AS n_alive, count(*) AS n_brokers FROM live",
    "alive_loads": f"WITH {LATEST} SELECT broker_id, timestamp_ms AS last_ms, partition_count, connection_count, available_memory FROM live WHERE is_alive",
    "least_loaded": f"WITH {LATEST} SELECT broker_id, partition_count FROM live WHERE is_alive AND partition_count IS NOT NULL ORDER BY partition_count, broker_id LIMIT 1",
    "heartbeat_acceptance": """
WITH h AS (SELECT *, coalesce(nullif(regexp_replace(broker_id, '[^0-9]', '', 'g'), '')::BIGINT <> 0 AND trim(host) <> '', false) AS ok FROM heartbeats)
SELECT broker_id, count(*) FILTER (ok) AS n_accepted, count(*) FILTER (NOT ok) AS n_refused,
  count(*) FILTER (timestamp_ms IS NULL) - count(timestamp_ms) > 3 AS gives_up FROM h GROUP BY broker_id""",
    "broker_addresses": "SELECT DISTINCT controller_id, snapshot_no, host, port FROM snap_brokers",
    "headers_last": """
WITH h AS (SELECT arrival_seq, unnest(headers) AS h, generate_subscripts(headers, 1) AS i FROM records_in)
SELECT arrival_seq, h.header_key AS header_key, arg_max(hex(h.header_value), i) AS last_value, count(*)::INT AS n_values FROM h GROUP BY ALL""",
    "headers_flat": """
WITH h AS (SELECT arrival_seq, unnest(headers) AS h, generate_subscripts(headers, 1) AS i FROM records_in),
f AS (SELECT *, min(i) OVER (PARTITION BY arrival_seq, h.header_key) AS first FROM h)
SELECT arrival_seq, (row_number() OVER (PARTITION BY arrival_seq ORDER BY first, i) - 1)::INT AS place, h.header_key AS header_key, hex(h.header_value) AS header_value FROM f""",
    "headers_changed": """
SELECT arrival_seq, (coalesce(len(headers), 0) + 1)::INT AS n_added, CASE WHEN coalesce(len(headers), 0) = 0 THEN 1 ELSE
  len(list_filter(headers, lambda h: h.header_key IS DISTINCT FROM headers[1].header_key)) + (headers[1].header_key IS DISTINCT FROM 'seen')::INT END::INT AS n_left FROM records_in""",
    "create_topics_validation": """
WITH a AS (SELECT controller_id, topic, max(num_partitions) AS p, count(*) AS n FROM snap_topics GROUP BY ALL),
r AS (SELECT CASE WHEN n % 2 = 0 THEN topic ELSE controller_id || '-' || topic END AS topic, p - 2 AS num_partitions, length(topic) % 6 - 1 AS rf FROM a),
c AS (SELECT *, topic IN (SELECT topic FROM topics) AS known, count(*) OVER (PARTITION BY topic) AS again FROM r),
v AS (SELECT *, CASE WHEN trim(topic) = '' OR topic IS NULL THEN 'blank name' WHEN known THEN 'exists' WHEN again > 1 THEN 'requested twice'
  WHEN num_partitions IS NULL OR num_partitions < 1 THEN 'no partitions' WHEN rf NOT BETWEEN 0 AND 3 THEN 'replication factor' END AS reject FROM c)
SELECT reject, count(*) AS n_topics, sum(num_partitions)::BIGINT AS n_partitions FROM v GROUP BY reject""",
    "metadata_diff": """
WITH s AS (SELECT DISTINCT controller_id, snapshot_no FROM snapshots),
o AS (SELECT *, lag(snapshot_no) OVER (PARTITION BY controller_id ORDER BY snapshot_no) AS prev FROM s),
x AS (SELECT DISTINCT controller_id, snapshot_no, 'b' AS k, broker_id AS id, {'a': host, 'b': port, 'c': num_partitions}::VARCHAR AS v FROM snap_brokers
      UNION SELECT DISTINCT controller_id, snapshot_no, 't', topic, {'a': num_partitions}::VARCHAR FROM snap_topics),
n AS (SELECT o.controller_id, o.snapshot_no, k, id, v FROM o JOIN x USING (controller_id, snapshot_no) WHERE prev IS NOT NULL),
p AS (SELECT o.controller_id, o.snapshot_no, k, id, v FROM o JOIN x ON o.controller_id = x.controller_id AND o.prev = x.snapshot_no)
SELECT controller_id, snapshot_no, count(*) AS n_changes FROM n FULL JOIN p USING (controller_id, snapshot_no, k, id) WHERE n.v IS DISTINCT FROM p.v GROUP BY ALL""",
    "compress_roundtrip": """
SELECT CASE WHEN lower(trim(codec)) IN ('none', 'gzip', 'snappy', 'lz4', 'zstd') THEN lower(trim(codec)) ELSE 'none' END AS codec, count(*) AS n_records,
  count(record_value) AS n_same, sum(octet_length(encode(record_value)))::BIGINT AS n_bytes FROM records_in JOIN batches USING (batch_no) GROUP BY 1""",
    "codec_roundtrip": """
SELECT arrival_seq, topic, target_partition, record_key, record_value, timestamp_ms,
  CASE WHEN headers IS NOT NULL THEN coalesce(array_to_string(list_transform(headers, lambda h: coalesce(h.header_key, '~') || '=' || coalesce(hex(h.header_value), '~')), ';'), '') END AS headers
FROM records_in""",
    "rejects_stored": f"WITH {_checked(150)} SELECT arrival_seq, topic, target_partition, reject FROM checked WHERE reject IS NOT NULL",
    "stored_offsets": f'WITH {_log(150)} SELECT arrival_seq, topic, target_partition, "offset" FROM log',
    "batch_round_robin": """
SELECT batch_no, topic, ((row_number() OVER (ORDER BY batch_no) - 1) % num_partitions)::INT AS partition FROM batches JOIN topics USING (topic) WHERE num_partitions > 0""",
    "poll_stored": f"""WITH {LOG} SELECT arrival_seq, topic, target_partition, "offset", record_value FROM log
WHERE topic = (SELECT min(topic) FROM log) AND target_partition = (SELECT min(target_partition) FROM log WHERE topic = (SELECT min(topic) FROM log)) AND "offset" BETWEEN 20 AND 29""",
    "committed_offsets": f"""WITH {LOG} SELECT 'group-' || batch_no % 2 AS group_id, topic, target_partition, "offset" AS committed FROM log WHERE ack_status = 'SUCCESS'
QUALIFY row_number() OVER (PARTITION BY batch_no % 2, topic, target_partition ORDER BY append_ms DESC, "offset" DESC) = 1""",
    "retry_queue": """
WITH q AS (SELECT topic, target_partition, batch_no, created_ms, retries, batch_no % 5 = 0 AS failed FROM batches),
s AS (SELECT *, failed AND retries >= 3 AS is_dropped FROM q),
f AS (SELECT *, row_number() OVER (PARTITION BY topic, target_partition ORDER BY created_ms DESC, batch_no DESC) AS place FROM s WHERE failed AND NOT is_dropped),
r AS (SELECT *, row_number() OVER (PARTITION BY topic, target_partition ORDER BY created_ms, batch_no) AS place FROM s WHERE NOT failed),
n AS (SELECT topic, target_partition, count(*) AS n FROM f GROUP BY ALL)
SELECT topic, target_partition, batch_no, retries + 1 AS retries, is_dropped, place FROM f
UNION ALL SELECT topic, target_partition, batch_no, retries, is_dropped, place + coalesce(n, 0) FROM r LEFT JOIN n USING (topic, target_partition)
UNION ALL SELECT topic, target_partition, batch_no, retries, is_dropped, NULL FROM s WHERE is_dropped""",
    "assign_sticky_contested": f"""WITH RECURSIVE mem AS (SELECT n_name AS member, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS m FROM nation), {RANGE},
mem2 AS (SELECT n_name AS member, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS m FROM nation WHERE n_regionkey <> 2), {RANGE.replace('pairs', 'pairs2').replace('rng', 'rng2').replace('FROM mem,', 'FROM mem2,')},
prev AS (SELECT * FROM rng UNION SELECT * FROM rng2), {UNIVERSE}, now AS (SELECT n_name AS member FROM nation),
cap AS (SELECT ceil((SELECT count(*) FROM uni) / (SELECT count(*) FROM now))::BIGINT AS s),
own AS (SELECT i, member, list({{'t': topic, 'p': partition}} ORDER BY topic, partition) AS ps FROM prev JOIN mem USING (member) GROUP BY ALL),
turn AS (SELECT -1::BIGINT AS i, []::STRUCT(t VARCHAR, p INTEGER)[] AS taken, []::STRUCT(member VARCHAR, t VARCHAR, p INTEGER)[] AS who
  UNION ALL SELECT turn.i + 1, list_concat(taken, list_filter(ps, lambda x: NOT list_contains(taken, x))[1:s]),
    list_concat(who, list_transform(list_filter(ps, lambda x: NOT list_contains(taken, x))[1:s], lambda x: {{'member': member, 't': x.t, 'p': x.p}}))
  FROM turn JOIN own ON own.i = turn.i + 1, cap),
keep AS (SELECT w.member, w.t AS topic, w.p AS partition FROM (SELECT unnest(who) AS w FROM turn WHERE i = (SELECT max(i) FROM turn))),
{STICKY.replace(STICKY[STICKY.index('keep AS'):STICKY.index('loads AS')], '')}""",
    "group_sync": f"""WITH {MEMBERS.format(where='')}, {RANGE},
t AS (SELECT member, topic, string_agg(partition::VARCHAR, ',' ORDER BY partition) AS ids FROM rng GROUP BY ALL)
SELECT mem.member, coalesce(string_agg(topic || '=' || ids, ';' ORDER BY topic), '') AS text FROM mem LEFT JOIN t USING (member) GROUP BY mem.member""",
    "assignor_choice": "SELECT * FROM (VALUES ('range', 'range'), ('RoundRobin', 'roundrobin'), ('STICKY', 'sticky'), ('other', 'range'), (NULL, 'range')) t(name, strategy)",
    "protocol_rounds": """
WITH j AS (SELECT c_mktsegment AS g, c_custkey AS a, c_name AS member, CASE WHEN c_custkey % 50 = 7 THEN ['custom'] WHEN c_custkey % 50 = 8 THEN []
  WHEN c_custkey % 2 = 0 THEN ['roundrobin', 'range'] ELSE ['range', 'sticky', 'roundrobin'] END AS ps,
  coalesce(sum((c_nationkey = 3)::INT) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS r FROM customer),
v AS (SELECT * FROM j WHERE len(ps) > 0),
l AS (SELECT g, r, arg_min(member, a) AS leader, arg_min(ps, a) AS pref, count(*) AS n FROM v GROUP BY g, r),
e AS (SELECT g, r, unnest(ps) AS p FROM v),
s AS (SELECT g, r, p FROM e JOIN l USING (g, r) GROUP BY g, r, p, n HAVING count(*) = n),
b AS (SELECT g, r, arg_min(p, list_position(pref, p)) AS p FROM s JOIN l USING (g, r) GROUP BY g, r),
o AS (SELECT l.*, p, row_number() OVER (PARTITION BY l.g ORDER BY l.r) AS k FROM l LEFT JOIN b USING (g, r))
SELECT g AS group_id, leader, n AS n_members, CASE WHEN p IS NULL THEN -1 ELSE k END::INT AS generation, p AS protocol,
  CASE WHEN p IS NULL THEN 'INCOMPATIBLE_PROTOCOL' ELSE 'SUCCESS' END AS status, r AS round FROM o""",
    "broker_marks": f"""WITH {LATEST}, x AS (SELECT *, regexp_replace(broker_id, '[^0-9]', '', 'g')::BIGINT AS n FROM live),
c AS (SELECT broker_id, count(*) AS beats FROM heartbeats GROUP BY ALL)
SELECT broker_id, timestamp_ms AS last_ms, is_alive AND NOT (n % 4 = 1 AND (n % 3 <> 0 OR (SELECT min(arrival_seq) + 1 > max(arrival_seq) FROM heartbeats h WHERE h.broker_id = x.broker_id))) AS is_alive
FROM x WHERE NOT (n % 4 = 2 AND (n % 3 <> 0 OR (SELECT min(arrival_seq) + 1 > max(arrival_seq) FROM heartbeats h WHERE h.broker_id = x.broker_id)))""",
    "topics_asked": """
WITH n AS (SELECT DISTINCT CASE WHEN snapshot_no % 7 = 0 THEN 'no-' || topic ELSE topic END AS topic FROM snap_topics)
SELECT n.topic, t.topic IS NOT NULL AS "exists", num_partitions FROM n LEFT JOIN topics t USING (topic)""",
    "broker_updates": """
WITH u AS (SELECT controller_id, broker_id, snapshot_no, max(num_partitions) AS num_partitions FROM snap_brokers GROUP BY ALL),
c AS (SELECT *, lag(num_partitions) OVER w AS was, row_number() OVER w AS i FROM u WINDOW w AS (PARTITION BY controller_id, broker_id ORDER BY snapshot_no))
SELECT controller_id, broker_id, snapshot_no, num_partitions FROM c WHERE i = 1 OR num_partitions IS DISTINCT FROM was
QUALIFY row_number() OVER (PARTITION BY controller_id, broker_id ORDER BY snapshot_no DESC) = 1""",
    "cluster_metadata": f"""WITH {OWNERS}, n AS (SELECT controller_id, broker_id, count(*) AS n_owned FROM owners GROUP BY ALL),
b AS (SELECT controller_id, broker_id, max({{'address': host || ':' || port, 'num_partitions': num_partitions}}) AS b
  FROM snap_brokers JOIN (SELECT controller_id, max(snapshot_no) AS snapshot_no FROM snap_brokers GROUP BY ALL) USING (controller_id, snapshot_no) GROUP BY ALL)
SELECT controller_id, broker_id, b.address, b.num_partitions, coalesce(n_owned, 0) AS n_owned FROM b LEFT JOIN n USING (controller_id, broker_id)""",
    "fetch_default": f"""WITH {LOG} SELECT arrival_seq, topic, target_partition, "offset" FROM log WHERE topic = (SELECT min(topic) FROM log) AND target_partition = 0 AND "offset" = 3""",
    "heartbeat_source": f"""
SELECT broker_id, n AS sequence_number, {NOW_MS} + n * 60000 AS timestamp_ms, 0 AS partition_count, 0 AS connection_count, 0::BIGINT AS available_memory
FROM (SELECT DISTINCT broker_id FROM snap_brokers WHERE broker_id IS NOT NULL), (SELECT unnest(range(10)) AS n)""",
    "controller_metadata": """
WITH l AS (SELECT controller_id, max(snapshot_no) AS snapshot_no FROM snapshots GROUP BY ALL),
a AS (SELECT controller_id, snapshot_no, bool_or(is_active) AS is_active FROM snapshots JOIN l USING (controller_id, snapshot_no) GROUP BY ALL)
SELECT a.*, (SELECT count(DISTINCT coalesce(broker_id, '')) FROM snap_brokers b WHERE b.controller_id = a.controller_id AND b.snapshot_no = a.snapshot_no) AS n_brokers,
  (SELECT count(DISTINCT topic) FROM snap_topics b WHERE b.controller_id = a.controller_id AND b.snapshot_no = a.snapshot_no) AS n_topics,
  (SELECT count(DISTINCT topic || '-' || target_partition) FROM snap_partitions b WHERE b.controller_id = a.controller_id AND b.snapshot_no = a.snapshot_no) AS n_partitions FROM a""",
    "metadata_maps": """
SELECT DISTINCT controller_id, broker_id, host, port FROM snap_brokers
JOIN (SELECT controller_id, max(snapshot_no) AS snapshot_no FROM snap_brokers GROUP BY ALL) USING (controller_id, snapshot_no) WHERE broker_id IS NOT NULL""",
    "settings_defaults": """SELECT * FROM (VALUES ('ProducerSettings', 'batch_size', '16384'), ('ProducerSettings', 'linger_ms', '100'), ('ProducerSettings', 'codec', 'none'),
  ('ProducerSettings', 'buffer_memory', '33554432'), ('ProducerSettings', 'max_block_ms', '60000'), ('ProducerSettings', 'retries', '3'),
  ('ProducerSettings', 'delivery_timeout_ms', '120000'), ('ProducerSettings', 'max_in_flight', '5'), ('ProducerSettings', 'max_request_size', '1048576'),
  ('BrokerSettings', 'heartbeat_interval_ms', '3000'), ('BrokerSettings', 'missed_heartbeats', '3'), ('BrokerSettings', 'heartbeat_timeout_ms', '5000'),
  ('BrokerSettings', 'retry_backoff_ms', '1000'), ('BrokerSettings', 'max_retries', '3'), ('BrokerSettings', 'segment_bytes', '1048576'),
  ('BrokerSettings', 'flush_bytes', '524288')) t(settings, name, value)""",
    "settings_checked": """
WITH r(name, low, high) AS (VALUES ('batch_size', 1, 1048576), ('heartbeat_interval_ms', 100, 60000), ('missed_heartbeats', 1, 10), ('heartbeat_timeout_ms', 100, 30000))
SELECT name, value::INT AS value, value BETWEEN low AND high AS is_taken FROM r, (SELECT unnest([0, 1, 10, 11, 99, 100, 30000, 30001, 60000, 60001, 1048576, 1048577]) AS value)""",
    "stamped_records": "SELECT topic, count(*) AS n_stamped, count(timestamp_ms) AS n_given, count(*) - count(timestamp_ms) AS n_new FROM records_in GROUP BY topic",
    "stream_append_counts": f"WITH {LOG}, {BOUNDS} SELECT * FROM bounds",
}

SQL["fetch_stored"] = SQL["fetch_at_offset"]
