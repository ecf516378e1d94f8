import numpy as np

from tidelog.operators.regular import observed_cells, regular_grid

SCHEMA = "src string, ts long, v double, period long, status string, estimate double"
M = 60_000


def grid(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA)
    return {(r["src"], r["period_start_ms"] // M): r for r in regular_grid(df, "src", "ts", "v", **kw).collect()}


def test_gaps_are_marked_and_observed_cells_exact(spark):
    rows = [("a", 0, 1.0), ("a", 10, 2.0), ("a", 10, 2.0), ("a", 3 * M, -5.0), ("a", 5 * M + 1, float("inf")), ("a", 7 * M, None), ("a", 8 * M, float("nan")), ("b", 2 * M, 9.0), (None, 0, 1.0), ("c", None, 1.0)]
    got = grid(spark, rows)
    assert sorted(got) == [("a", m) for m in range(6)] + [("b", 2)]
    assert {k: r["v"] for k, r in got.items() if r["status"] == "observed"} == {("a", 0): 2.0, ("a", 3): -5.0, ("a", 5): float("inf"), ("b", 2): 9.0}
    assert all(got["a", m]["status"] == "unsupported" and got["a", m]["estimate"] is None for m in (1, 2, 4))
    assert grid(spark, []) == {}


def test_held_out_cells_of_a_low_rank_matrix(spark):
    r = np.random.default_rng(5)
    u, w = r.normal(size=(40, 2)), r.normal(size=(120, 2))
    x = 50 + 10 * r.normal(size=(40, 1)) + u @ w.T + 0.02 * r.normal(size=(40, 120))
    held = (r.random((40, 120)) < 0.15) & (np.arange(120) > 0) & (np.arange(120) < 119)
    got = grid(spark, [(f"s{i}", j * M + 7, float(x[i, j])) for i in range(40) for j in range(120) if not held[i, j]], width=120, rank=2, rounds=30, ridge=0.002, tolerance=1e-6)
    assert {k for k, c in got.items() if c["status"] == "filled"} == {(f"s{i}", j) for i, j in zip(*np.nonzero(held), strict=True)}
    error = [got[f"s{i}", j]["estimate"] - x[i, j] for i, j in zip(*np.nonzero(held), strict=True)]
    plain = [x[i][~held[i]].mean() - x[i, j] for i, j in zip(*np.nonzero(held), strict=True)]
    assert np.sqrt(np.mean(np.square(error))) < 0.2 * np.sqrt(np.mean(np.square(plain)))


def test_filled_cells_have_values_and_spikes_do_not_bend_them(spark):
    r = np.random.default_rng(2)
    level = lambda i, j: 40 + i + 3 * np.sin(j / 25)
    rows, held = [], []
    for i in range(20):
        for j in range(150):
            if 0 < j < 149 and r.random() < 0.2:
                held.append((f"s{i}", j))
            else:
                v = level(i, j) + 0.1 * r.normal()
                rows.append((f"s{i}", j * M + 1, float(v + (1000 if r.random() < 0.02 else 0))))
    got = grid(spark, rows)
    error = np.array([got[k]["v"] - level(int(k[0][1:]), k[1]) for k in held])
    assert all(got[k]["status"] == "filled" and got[k]["v"] == got[k]["estimate"] for k in held)
    assert np.sqrt(np.mean(error**2)) < 0.5


def test_a_far_timestamp_is_listed_in_pieces(spark, monkeypatch):
    rows = [("a", j * M, 1.0) for j in range(5)] + [("a", 3_000_007 * M, 1.0), ("b", -100 * M, 1.0), ("b", 100 * M, 2.0)]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA)
    counts = {(r["src"], r["status"]): r["count"] for r in regular_grid(df, "src", "ts", "v").groupBy("src", "status").count().collect()}
    assert counts == {("a", "observed"): 6, ("a", "unsupported"): 3_000_002, ("b", "observed"): 2, ("b", "unsupported"): 199}


def test_held_out_readings_of_the_data(spark):
    beats = spark.read.parquet("/root/testdata/sf0.01/heartbeats.parquet").select("broker_id", "timestamp_ms", "cpu_usage")
    cells = [tuple(r) for r in observed_cells(beats, "broker_id", "timestamp_ms", "cpu_usage", M).collect()]
    r = np.random.default_rng(1)
    out = r.random(len(cells)) < 0.1
    kept = [(s, p * M, v) for (s, p, v), o in zip(cells, out, strict=True) if not o]
    got = grid(spark, kept)
    by = {}
    for s, _, v in kept:
        by.setdefault(s, []).append(v)
    level, error, plain = {s: np.median(v) for s, v in by.items()}, [], []
    for (s, p, v), o in zip(cells, out, strict=True):
        if o and (s, p) in got and got[s, p]["status"] == "filled" and abs(v - level[s]) < 40:  # not the implausible ones
            error.append(v - got[s, p]["v"])
            plain.append(v - level[s])
    assert len(error) > 0.9 * out.sum()
    assert np.median(np.abs(error)) < 0.75 * np.median(np.abs(plain)) and np.mean(np.square(error)) < np.mean(np.square(plain))
