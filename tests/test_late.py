import random

import pytest

from tidelog.operators.late import Idle, corrected_counts, late_records, punctuations

H = 3_600_000


def brute(rows):
    out = {}
    for g, t, s, *_ in rows:
        if t is None or s is None:
            continue
        w = max((u for h, u, r, *_ in rows if h == g and u is not None and r is not None and r < s), default=None)
        e = (t // H + 1) * H
        if w is not None and w >= e:
            out[s] = "cut_off" if w >= e + 6 * H else "corrects"
    return out


def random_rows(n, seed):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), None if r.random() < 0.05 else int(i * H / 20 - r.choice([0, 0, 0, 2, 7, 30]) * H * r.random() + 10 * H), i, "c", 1) for i in range(n)]


SCHEMA = "topic string, ts long, seq long, period string, close_seq int"


def test_against_brute_force(spark):
    rows = random_rows(400, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["seq"]: r["outcome"] for r in late_records(df, ["topic"], "ts", "seq").collect()}
    want = brute(rows)
    assert got == want and {"corrects", "cut_off"} == set(want.values())
    counts = corrected_counts(df, ["topic"], "ts", "seq").collect()
    assert sum(r["n_corrects"] + r["n_cut_off"] for r in counts) == len(want)
    assert sum(r["n_on_time"] + r["n_corrects"] for r in counts) == sum(r["n"] for r in counts)


def test_empty_and_unusable_rows(spark):
    assert late_records(spark.createDataFrame([], SCHEMA), ["topic"], "ts", "seq").collect() == []
    rows = [("a", None, 1, "", 0), ("a", 5 * H, None, "", 0), ("a", 0, 2, "", 0)]
    assert late_records(spark.createDataFrame(rows, SCHEMA), ["topic"], "ts", "seq").collect() == []
    with pytest.raises(ValueError):
        punctuations(spark.createDataFrame([], SCHEMA), ["topic"], None, "ts", "seq", H, 5)


def test_bound_is_exclusive(spark):
    rows = [("a", H, 1, "", 0), ("a", H - 1, 2, "", 0), ("a", 7 * H, 3, "", 0), ("a", H - 1, 4, "", 0), ("a", H, 5, "", 0)]
    got = {r["seq"]: r["outcome"] for r in late_records(spark.createDataFrame(rows, SCHEMA), ["topic"], "ts", "seq").collect()}
    assert got == {2: "corrects", 4: "cut_off", 5: "corrects"}


def test_groups_wait_for_every_source_unless_idle(spark):
    rows = [
        # topic, source, time, order, wall
        ("t", 1, 0, 1, 0), ("t", 2, 10, 2, 10), ("t", 1, H + 1, 3, H), ("t", 2, H + 5, 4, H + 60_000), ("t", 1, 2 * H, 5, 2 * H),
        ("t", 1, 3 * H, 6, 3 * H), ("t", 1, 4 * H, 7, 4 * H),
    ]
    df = spark.createDataFrame(rows, "topic string, src int, ts long, seq long, wall long")
    got = {r["period"]: r["close_seq"] for r in punctuations(df, ["topic"], "src", "ts", "seq", H, idle=Idle("wall", 2 * H - 1)).collect()}
    # Hour 0 closes when source 2 has passed it; hour 1 when source 2 has been silent for two hours; hours 2 and 3 by source 1.
    assert got == {0: 4, H: 7, 2 * H: 7, 3 * H: 7, 4 * H: None}
    late = {r["seq"] for r in late_records(df, ["topic"], "ts", "seq", H, H, "src", Idle("wall", 2 * H - 1)).collect()}
    assert late == set()


def test_every_source_of_a_group(spark):
    r = random.Random(4)
    rows = [(g, s, None if r.random() < 0.05 else int(i * H / 20 + s * H - r.choice([0, 0, 3, 9]) * H * r.random() + 10 * H), i) for i in range(300) for g, s in [(r.choice(["a", None]), r.randrange(3))]]
    df = spark.createDataFrame(rows, "topic string, src int, ts long, seq long")
    want = {}
    for g, s, t, i in rows:
        if t is None:
            continue
        tops = {}
        for h, u, x, j in rows:
            if h == g and x is not None and j < i:
                tops[u] = max(tops.get(u, -1), x)
        # All sources that have anything up to the period must have passed its end before this arrival.
        end = (t // H + 1) * H
        waited = {u for h, u, x, _ in rows if h == g and x is not None and x < end}
        if all(tops.get(u, -1) >= end for u in waited):
            want[i] = "cut_off" if all(tops[u] >= end + 6 * H for u in waited) else "corrects"
    got = {x["seq"]: x["outcome"] for x in late_records(df, ["topic"], "ts", "seq", source="src").collect()}
    assert got == want and {"corrects", "cut_off"} == set(want.values())
