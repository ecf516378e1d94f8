"""Queries p1-p6: data problems of the message log and of the cluster's measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.deduplicate import mark_copies
from tidelog.operators.heavy import heavy_keys, key_counts
from tidelog.operators.implausible import Measure, implausible_readings
from tidelog.operators.late import Idle, corrected_counts, late_records, punctuations
from tidelog.operators.regular import regular_grid
from tidelog.operators.snapshots import Entity, snapshot_changes
from tidelog.runtime import table

LOAD = (
    Measure("cpu_usage", low=0.0, high=100.0),
    Measure("available_memory", low=0.0),
    Measure("connection_count", low=0.0, least_scatter=1.0),
)


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The cases of p1_found, and further readings of implausible rates of change or by the scatter of their hour."""
    return implausible_readings(table(spark, d, "heartbeats"), "broker_id", "timestamp_ms", LOAD, further=True)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(table(spark, d, "heartbeats"), "broker_id", "timestamp_ms", LOAD).select("broker_id", "timestamp_ms", "metric_name")


def _marked(spark: SparkSession, d: str) -> DataFrame:
    identity = [F.col("topic"), F.coalesce("record_key", F.lit("")), F.col("timestamp_ms"), F.col("record_value")]
    return mark_copies(table(spark, d, "records_in"), "arrival_seq", identity, F.col("timestamp_ms").isNotNull())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where("is_copy").select("arrival_seq")


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """Messages with an event time of which exactly one row remains, by the row that remains."""
    return _marked(spark, d).where("not is_copy").select("arrival_seq")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return late_records(table(spark, d, "records_in"), ["topic"], "timestamp_ms", "arrival_seq")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return corrected_counts(table(spark, d, "records_in"), ["topic"], "timestamp_ms", "arrival_seq")


def p3_closed(spark: SparkSession, d: str) -> DataFrame:
    """Where each topic's hour closes once all of its partitions have passed it, idle ones not waited for."""
    rows = table(spark, d, "records_in")
    closed = punctuations(rows, ["topic"], "target_partition", "timestamp_ms", "arrival_seq", idle=Idle("append_ms", 7_200_000))
    return closed.select("topic", "period", "close_seq")


def p3_waiting(spark: SparkSession, d: str) -> DataFrame:
    """The late records of topics whose hours wait for all of their partitions."""
    rows = table(spark, d, "records_in")
    return late_records(rows, ["topic"], "timestamp_ms", "arrival_seq", source="target_partition", idle=Idle("append_ms", 7_200_000))


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "heartbeats"), "broker_id", "timestamp_ms", "cpu_usage")


def p4_status(spark: SparkSession, d: str) -> DataFrame:
    """The grid without what is estimated."""
    grid = p4_grid(spark, d)
    return grid.select("broker_id", "period_start_ms", "status", F.when(F.col("status") == "observed", F.col("cpu_usage")).alias("cpu_usage"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_grid(spark, d).where("status <> 'observed'").select("broker_id", "period_start_ms")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = [
        Entity("broker", table(spark, d, "snap_brokers"), F.col("broker_id"), ["host", "port", "num_partitions"]),
        Entity("topic", table(spark, d, "snap_topics"), F.col("topic"), ["num_partitions"]),
        Entity("partition", table(spark, d, "snap_partitions"), F.concat("topic", F.lit("-"), F.col("target_partition")), ["broker_id"]),
    ]
    return snapshot_changes(table(spark, d, "snapshots"), kinds, "controller_id", "snapshot_no")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "records_in"), "record_key").select("record_key")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return key_counts(table(spark, d, "records_in"), ["topic", "target_partition", "record_key"])


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_reasons, p2_found, p2_kept, p3_found, p3_counts, p3_closed, p3_waiting, p4_found, p4_grid, p4_status, p5_found, p6_found, p6_counts)}


# Readings with the level of their neighbours, their runs, rates of change and what is usual.
_READINGS = """
WITH h AS (SELECT DISTINCT broker_id, timestamp_ms, cpu_usage, available_memory, connection_count FROM heartbeats
           WHERE broker_id IS NOT NULL AND timestamp_ms IS NOT NULL),
r AS (SELECT broker_id, timestamp_ms, 'cpu_usage' AS metric_name, cpu_usage AS v, 100.0 AS high, 0.0 AS least FROM h
      UNION ALL SELECT broker_id, timestamp_ms, 'available_memory', available_memory::DOUBLE, 'inf'::DOUBLE, 0.0 FROM h
      UNION ALL SELECT broker_id, timestamp_ms, 'connection_count', connection_count::DOUBLE, 'inf'::DOUBLE, 1.0 FROM h),
i AS (SELECT *, isnan(v) OR v < 0 OR v > high AS impossible FROM r WHERE v IS NOT NULL),
o AS (SELECT *, CASE WHEN NOT impossible THEN v END AS ok FROM i),
n AS (SELECT *, list(ok) OVER a AS l1, list(ok) OVER b AS l2, lag(v) OVER o AS prior,
        (ok - lag(ok) OVER o) / ((timestamp_ms - lag(timestamp_ms) OVER o) / 60000) AS rate, (ok - lag(ok, 2) OVER o) / ((timestamp_ms - lag(timestamp_ms, 2) OVER o) / 60000) AS second
      FROM o WINDOW o AS (PARTITION BY broker_id, metric_name ORDER BY timestamp_ms),
                    a AS (PARTITION BY broker_id, metric_name ORDER BY timestamp_ms ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
                    b AS (PARTITION BY broker_id, metric_name ORDER BY timestamp_ms ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
m AS (SELECT *, list_filter(coalesce(l1, []), lambda x: x IS NOT NULL) AS c1, list_filter(coalesce(l2, []), lambda x: x IS NOT NULL) AS c2 FROM n),
e AS (SELECT *, ok - list_median(list_concat(c1, c2)) AS off,
        CASE WHEN len(c1) >= 5 THEN abs(ok - list_median(c1)) END AS d1, CASE WHEN len(c2) >= 5 THEN abs(ok - list_median(c2)) END AS d2,
        sum(CASE WHEN v = prior THEN 0 ELSE 1 END) OVER (PARTITION BY broker_id, metric_name ORDER BY timestamp_ms ROWS UNBOUNDED PRECEDING) AS run FROM m),
q AS (SELECT broker_id, metric_name, any_value(least) AS least, quantile_cont(off, [0.05, 0.25, 0.75, 0.95]) AS q, quantile_cont(rate, [0.05, 0.25, 0.75, 0.95]) AS t,
        count(*) FILTER (v <> prior) >= 0.5 * count(prior) AS changing FROM e GROUP BY ALL),
u AS (SELECT *, greatest(CASE WHEN q[3] > q[2] THEN (q[3] - q[2]) / 1.349 ELSE (q[4] - q[1]) / 3.29 END, least) AS scatter,
        CASE WHEN t[3] > t[2] THEN (t[3] - t[2]) / 1.349 ELSE (t[4] - t[1]) / 3.29 END AS rate_scatter FROM q),
g AS (SELECT *, least(abs(off), coalesce(d1, 'inf'::DOUBLE), coalesce(d2, 'inf'::DOUBLE)) AS apart, count(*) OVER (PARTITION BY broker_id, metric_name, run) AS len FROM e),
k AS (SELECT broker_id, metric_name, timestamp_ms // 3600000 AS hour, count(off) AS known, any_value(least) AS least, quantile_cont(off, [0.05, 0.25, 0.75, 0.95]) AS q FROM e GROUP BY ALL),
z AS (SELECT broker_id, metric_name, hour, greatest(CASE WHEN q[3] > q[2] THEN (q[3] - q[2]) / 1.349 ELSE (q[4] - q[1]) / 3.29 END, least) AS hour_scatter FROM k WHERE known >= 30)"""

# Where hours of topics close and are cut off, waiting for all partitions but those idle for two hours.
_CLOSED = """
WITH r AS (SELECT topic, target_partition AS src, timestamp_ms // 3600000 * 3600000 AS p, arrival_seq AS seq, append_ms AS wall FROM records_in WHERE timestamp_ms IS NOT NULL AND append_ms IS NOT NULL),
s AS (SELECT topic, src, p, min(seq) AS first_seq, max(wall) AS last_wall FROM r GROUP BY ALL),
g AS (SELECT a.topic, a.p, b.src, first_seq, last_wall FROM (SELECT DISTINCT topic, p FROM s) a JOIN (SELECT DISTINCT topic, src FROM s) b USING (topic)
      LEFT JOIN s ON s.topic = a.topic AND s.p = a.p AND s.src = b.src),
w AS (SELECT *, min(first_seq) OVER (PARTITION BY topic, src ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS pass_seq,
        min(first_seq) OVER (PARTITION BY topic, src ORDER BY p RANGE BETWEEN 25200000 FOLLOWING AND UNBOUNDED FOLLOWING) AS pass_cut,
        max(last_wall) OVER (PARTITION BY topic, src ORDER BY p ROWS UNBOUNDED PRECEDING) AS quiet_from FROM g),
t AS (SELECT topic, wall // 60000 AS tick, min(seq) AS tick_seq FROM r GROUP BY ALL),
l AS (SELECT topic, tick, min(tick_seq) OVER (PARTITION BY topic ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tick_seq FROM t),
x AS (SELECT w.*, tick_seq AS timeout FROM (SELECT *, (quiet_from + 7200000 + 59999) // 60000 AS due FROM w WHERE quiet_from IS NOT NULL) w
      ASOF LEFT JOIN l ON w.topic = l.topic AND w.due <= l.tick),
c AS (SELECT topic, p, CASE WHEN count(least(pass_seq, timeout)) = count(*) THEN max(least(pass_seq, timeout)) END AS close_seq,
        CASE WHEN count(least(pass_cut, timeout)) = count(*) THEN max(least(pass_cut, timeout)) END AS cut_seq FROM x GROUP BY ALL)"""

SQL = {
    "p1_found": f"""{_READINGS}
SELECT broker_id, timestamp_ms, metric_name FROM g JOIN u USING (broker_id, metric_name)
WHERE impossible OR apart > 10 * scatter OR (len >= 8 AND changing)""",
    "p1_reasons": f"""{_READINGS},
w AS (SELECT broker_id, timestamp_ms, metric_name, v AS value, CASE WHEN impossible THEN 'impossible' WHEN apart > 10 * scatter THEN 'spike' WHEN len >= 8 AND changing THEN 'stuck'
        WHEN second IS NOT NULL AND least(coalesce(abs(rate), 'inf'::DOUBLE), abs(second)) > 10 * rate_scatter THEN 'rate' WHEN apart > 10 * hour_scatter THEN 'hour' END AS reason
      FROM g JOIN u USING (broker_id, metric_name) LEFT JOIN z ON z.broker_id = g.broker_id AND z.metric_name = g.metric_name AND z.hour = timestamp_ms // 3600000)
SELECT * FROM w WHERE reason IS NOT NULL""".replace("SELECT broker_id, timestamp_ms, metric_name, v AS", "SELECT g.broker_id, timestamp_ms, g.metric_name, v AS"),
    "p2_found": """
SELECT arrival_seq FROM (SELECT arrival_seq, min(arrival_seq) OVER (PARTITION BY topic, coalesce(record_key, ''), timestamp_ms, record_value) AS first
FROM records_in WHERE timestamp_ms IS NOT NULL) WHERE arrival_seq > first""",
    "p2_kept": """
SELECT min(arrival_seq) AS arrival_seq FROM records_in WHERE timestamp_ms IS NOT NULL
GROUP BY topic, coalesce(record_key, ''), timestamp_ms, record_value""",
    "p3_found": """
WITH w AS (SELECT arrival_seq, (timestamp_ms // 3600000 + 1) * 3600000 AS e, max(timestamp_ms) OVER (PARTITION BY topic ORDER BY arrival_seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM records_in WHERE timestamp_ms IS NOT NULL)
SELECT arrival_seq, CASE WHEN w >= e + 21600000 THEN 'cut_off' ELSE 'corrects' END AS outcome FROM w WHERE w >= e""",
    "p3_counts": """
WITH w AS (SELECT topic, timestamp_ms // 3600000 * 3600000 AS p, max(timestamp_ms) OVER (PARTITION BY topic ORDER BY arrival_seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM records_in WHERE timestamp_ms IS NOT NULL),
o AS (SELECT topic, p, CASE WHEN w >= p + 25200000 THEN 2 WHEN w >= p + 3600000 THEN 1 ELSE 0 END AS o FROM w)
SELECT topic, p AS period_start_ms, count(*) FILTER (o = 0) AS n_on_time, count(*) FILTER (o = 1) AS n_corrects,
       count(*) FILTER (o = 2) AS n_cut_off, count(*) FILTER (o < 2) AS n FROM o GROUP BY ALL""",
    "p3_closed": f"{_CLOSED} SELECT topic, p AS period, close_seq FROM c",
    "p3_waiting": f"""{_CLOSED} SELECT seq AS arrival_seq, CASE WHEN seq > cut_seq THEN 'cut_off' ELSE 'corrects' END AS outcome
FROM r JOIN c USING (topic, p) WHERE seq > close_seq""",
    "p4_found": """
WITH m AS (SELECT DISTINCT broker_id, timestamp_ms // 60000 AS t FROM heartbeats
           WHERE broker_id IS NOT NULL AND timestamp_ms IS NOT NULL AND cpu_usage IS NOT NULL AND NOT isnan(cpu_usage)),
a AS (SELECT broker_id, unnest(generate_series(min(t), max(t))) AS t FROM m GROUP BY broker_id)
SELECT broker_id, t * 60000 AS period_start_ms FROM a ANTI JOIN m USING (broker_id, t)""",
    "p4_status": """
WITH c AS (SELECT broker_id, timestamp_ms // 60000 AS t, arg_max(cpu_usage, timestamp_ms) AS v FROM heartbeats
           WHERE broker_id IS NOT NULL AND timestamp_ms IS NOT NULL AND cpu_usage IS NOT NULL AND NOT isnan(cpu_usage) GROUP BY ALL),
a AS (SELECT broker_id, unnest(generate_series(min(t), max(t))) AS t FROM c GROUP BY broker_id),
r AS (SELECT broker_id, t // 30 AS row, count(*) FILTER (isfinite(v)) AS n FROM c GROUP BY ALL), p AS (SELECT t % 30 AS place, count(*) FILTER (isfinite(v)) AS m FROM c GROUP BY ALL)
SELECT a.broker_id, t * 60000 AS period_start_ms, v AS cpu_usage,
  CASE WHEN v IS NOT NULL THEN 'observed' WHEN coalesce(n, 0) >= 3 AND coalesce(m, 0) >= 2 THEN 'filled' ELSE 'unsupported' END AS status
FROM a LEFT JOIN c USING (broker_id, t) LEFT JOIN r ON r.broker_id = a.broker_id AND r.row = a.t // 30 LEFT JOIN p ON p.place = a.t % 30""",
    "p5_found": """
WITH s AS (SELECT DISTINCT controller_id, snapshot_no FROM snapshots),
o AS (SELECT *, lag(snapshot_no) OVER (PARTITION BY controller_id ORDER BY snapshot_no) AS prev FROM s),
x AS (SELECT DISTINCT controller_id, snapshot_no, 'broker' AS entity_kind, broker_id AS entity_id, {'a': host, 'b': port, 'c': num_partitions}::VARCHAR AS v FROM snap_brokers
      UNION SELECT DISTINCT controller_id, snapshot_no, 'topic', topic, {'a': num_partitions}::VARCHAR FROM snap_topics
      UNION SELECT DISTINCT controller_id, snapshot_no, 'partition', topic || '-' || target_partition, {'a': broker_id}::VARCHAR FROM snap_partitions),
n AS (SELECT o.controller_id, o.snapshot_no, entity_kind, entity_id, v FROM o JOIN x USING (controller_id, snapshot_no) WHERE prev IS NOT NULL),
p AS (SELECT o.controller_id, o.snapshot_no, entity_kind, entity_id, v FROM o JOIN x ON o.controller_id = x.controller_id AND o.prev = x.snapshot_no)
SELECT controller_id, snapshot_no, entity_kind, entity_id,
       CASE WHEN p.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM n FULL JOIN p USING (controller_id, snapshot_no, entity_kind, entity_id) WHERE n.v IS DISTINCT FROM p.v""",
    "p6_found": """
SELECT record_key FROM records_in WHERE record_key <> '' GROUP BY record_key HAVING count(*) * 100 >= (SELECT count(*) FROM records_in)""",
    "p6_counts": "SELECT topic, target_partition, record_key, count(*) AS n_rows FROM records_in GROUP BY ALL",
}
