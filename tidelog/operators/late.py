"""Event-time periods that are corrected by late records, closed by the low watermarks of their sources.

A group's records come from one or several sources. A source's low watermark passes the end of a period with the first
record, in order of arrival, whose event time is at or after that end: that arrival is the source's punctuation for the
period. A period closes for its group when every source has punctuated it or has been idle for too long. Punctuations are
compact (one row per source and period), come from one aggregate with map-side combining and need no order of the big
table: a record is late exactly if it arrives after the closing of its own period, so the records themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.runtime import cut, small


@dataclass(frozen=True)
class Idle:
    """When a source is no longer waited for: after ``after_ms`` without a record on the arrivals' clock ``wall``.

    Time-outs are looked at with the group's first arrival of each tick of ``tick_ms``.
    """

    wall: str
    after_ms: int
    tick_ms: int = 60_000


def punctuations(
    df: DataFrame, group: Sequence[str], source: str | None, time: str, order: str, period_ms: int = 3_600_000, lateness_ms: int = 0, idle: Idle | None = None
) -> DataFrame:
    """(group..., period, close_seq, cut_seq): where in the arrival order each period of a group closes, and is cut off.

    ``close_seq`` is the arrival with which the last of the group's sources passes the period's end, ``cut_seq`` that with
    which the last passes the end plus ``lateness_ms``; null if one has not. ``period`` is the period's start in ms. Without
    ``source`` the group is its only source. With ``idle`` a source that sends nothing of the period or an earlier
    one for so long is not waited for, nor is its lateness. Sources that have sent nothing up to the period are not waited
    for. Rows without event time, order or (with ``idle``) wall time carry no watermark; wall must not decrease along ``order``.
    """
    if lateness_ms % period_ms:
        raise ValueError("lateness_ms must be a multiple of period_ms")
    rows = df.where(F.col(time).isNotNull() & F.col(order).isNotNull())
    if idle:
        rows = rows.where(F.col(idle.wall).isNotNull())
    rows = rows.select(
        *group,
        (F.col(source) if source else F.lit(0)).alias("_src"),
        (F.floor(F.col(time) / period_ms) * period_ms).alias("period"),
        F.col(order).alias("_seq"),
        (F.col(idle.wall) if idle else F.lit(None).cast("long")).alias("_wall"),
    )
    seen = rows.groupBy(*group, "_src", "period").agg(F.min("_seq").alias("first_seq"), F.max("_wall").alias("last_wall"))
    grid = seen
    if source:  # every source of a group has to pass every period of the group
        seen = cut(seen)
        sources = seen.select(*[F.col(g).alias(f"_r_{g}") for g in group], "_src").distinct()
        periods = seen.select(*group, "period").distinct()
        same = F.lit(True)
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
        every = periods.join(sources, same).select(*group, "_src", "period", F.lit(None).cast("long").alias("first_seq"), F.lit(None).cast("long").alias("last_wall"))
        grid = seen.unionByName(every).groupBy(*group, "_src", "period").agg(F.min("first_seq").alias("first_seq"), F.max("last_wall").alias("last_wall"))
    by = Window.partitionBy(*group, "_src").orderBy("period")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    # What comes later is taken in descending order, so that each row adds to what is known of those after it.
    back = Window.partitionBy(*group, "_src").orderBy(F.col("period").desc())
    waits = (
        grid.withColumn("pass_seq", F.min("first_seq").over(back.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("pass_cut", F.min("first_seq").over(back.rangeBetween(Window.unboundedPreceding, -(lateness_ms + period_ms))))
        .withColumn("started", F.min("first_seq").over(so_far))
        .where(F.col("started").isNotNull())
    )
    if idle:
        waits = waits.withColumn("tick", F.ceil((F.max("last_wall").over(so_far) + idle.after_ms) / idle.tick_ms))
        ticks = rows.groupBy(*group, F.floor(F.col("_wall") / idle.tick_ms).alias("tick")).agg(F.min("_seq").alias("tick_seq"))
        ahead = Window.partitionBy(*group).orderBy(F.col("tick").desc()).rangeBetween(Window.unboundedPreceding, 0)
        waits = waits.unionByName(ticks, allowMissingColumns=True).withColumn("timeout", F.min("tick_seq").over(ahead)).where(F.col("period").isNotNull())
    else:
        waits = waits.withColumn("timeout", F.lit(None).cast("long"))
    done = lambda c: F.least(c, "timeout")
    passed = lambda c: F.when(F.count(done(c)) == F.count("*"), F.max(done(c)))
    return waits.groupBy(*group, "period").agg(passed("pass_seq").alias("close_seq"), passed("pass_cut").alias("cut_seq"))


def _joined(
    df: DataFrame, group: Sequence[str], time: str, order: str, period_ms: int, lateness_ms: int, source: str | None = None, idle: Idle | None = None
) -> DataFrame:
    keys = [f"_g{k}" for k in range(len(group))]
    more = [F.col(source).alias("_s")] if source else []
    more += [F.col(idle.wall).alias("_w")] if idle else []
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(time).alias("_t"), F.col(order).alias("_seq"), *more)
    waited = Idle("_w", idle.after_ms, idle.tick_ms) if idle else None
    bounds = small(cut(punctuations(rows, keys, "_s" if source else None, "_t", "_seq", period_ms, lateness_ms, waited)))
    rows = rows.where(F.col("_t").isNotNull() & F.col("_seq").isNotNull()).withColumn("_p", F.floor(F.col("_t") / period_ms) * period_ms)
    on = F.col("_p") == F.col("period")
    bounds = bounds.select("period", "close_seq", "cut_seq", *[F.col(k).alias(f"{k}_b") for k in keys])
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_b"))
    outcome = F.when(F.col("_seq") > F.col("cut_seq"), "cut_off").when(F.col("_seq") > F.col("close_seq"), "corrects").otherwise("on_time")
    return rows.join(bounds, on, "left").select(*[F.col(k).alias(g) for g, k in zip(group, keys, strict=True)], "_seq", "_p", outcome.alias("outcome"))


def late_records(
    df: DataFrame,
    group: Sequence[str],
    time: str,
    order: str,
    period_ms: int = 3_600_000,
    lateness_ms: int = 21_600_000,
    source: str | None = None,
    idle: Idle | None = None,
) -> DataFrame:
    """(order, outcome) of each record that arrives after its group's period closed, see punctuations.

    ``corrects``: within ``lateness_ms`` of the end, the period's aggregates still take it in; ``cut_off``: diverted.
    Defined results: records without event time or order belong to no period; a null ``group`` value is a
    group of its own; records with equal ``order`` do not make each other late; an empty table gives no rows.
    """
    return _joined(df, group, time, order, period_ms, lateness_ms, source, idle).where("outcome <> 'on_time'").select(F.col("_seq").alias(order), "outcome")


def corrected_counts(
    df: DataFrame,
    group: Sequence[str],
    time: str,
    order: str,
    period_ms: int = 3_600_000,
    lateness_ms: int = 21_600_000,
    source: str | None = None,
    idle: Idle | None = None,
) -> DataFrame:
    """(group..., period_start_ms, n_on_time, n_corrects, n_cut_off, n): counts per group and period of event time.

    ``n`` takes in records on time and corrections, not what was cut off. Other definitions as in late_records.
    """
    count = lambda what: F.count(F.when(F.col("outcome") == what, 1))
    return (
        _joined(df, group, time, order, period_ms, lateness_ms, source, idle)
        .groupBy(*group, F.col("_p").alias("period_start_ms"))
        .agg(
            count("on_time").alias("n_on_time"),
            count("corrects").alias("n_corrects"),
            count("cut_off").alias("n_cut_off"),
            F.count(F.when(F.col("outcome") != "cut_off", 1)).alias("n"),
        )
    )
