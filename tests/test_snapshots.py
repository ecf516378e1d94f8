import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidelog.operators import snapshots as S
from tidelog.operators.snapshots import Entity, snapshot_changes

ROWS = "owner string, no long, id string, a string, b int, kind string, pair int, kh long"


def changes(spark, listed, rows, **kw):
    lists = spark.createDataFrame(listed, "owner string, no long, prev int")
    kind = Entity("thing", spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS), F.col("id"), ["a", "b"])
    return {tuple(r) for r in snapshot_changes(lists, [kind], "owner", "no", **kw).collect()}


def test_added_removed_changed(spark):
    listed = [("c", 1, 0), ("c", 5, 0), ("c", 5, 0), ("c", 9, 0), ("d", 5, 0)]
    rows = [("c", 1, "x", "p", 1), ("c", 1, "y", None, 1), ("c", 1, "z", "q", 1), ("c", 5, "x", "p", 1), ("c", 5, "x", "p", 1), ("c", 5, "y", "", 1), ("c", 5, "n", "", None), ("c", 7, "k", "", 1), ("d", 5, "x", "p", 1), ("c", 5, None, "p", 1), (None, 5, "x", "p", 1)]
    assert changes(spark, listed, rows) == {
        ("c", 5, "thing", "y", "changed"), ("c", 5, "thing", "z", "removed"), ("c", 5, "thing", "n", "added"),
        ("c", 9, "thing", "x", "removed"), ("c", 9, "thing", "y", "removed"), ("c", 9, "thing", "n", "removed"),
    }
    assert changes(spark, [], []) == set()
    assert changes(spark, listed, []) == set()
    assert changes(spark, [], rows) == set()


def test_rows_of_one_entity_that_differ_are_one_state(spark):
    listed = [("c", 1, 0), ("c", 2, 0), ("c", 3, 0)]
    rows = [("c", 1, "x", "p", 1), ("c", 1, "x", "q", 1), ("c", 2, "x", "q", 1), ("c", 2, "x", "p", 1), ("c", 3, "x", "p", 1)]
    assert changes(spark, listed, rows) == {("c", 3, "thing", "x", "changed")}


def test_many_differences_enlarge_the_tables(spark):
    r = random.Random(2)
    before = {f"k{i}": r.randrange(5) for i in range(3000)}
    after = {k: (v if r.random() < 0.3 else v + 7) for k, v in before.items() if r.random() < 0.9} | {f"n{i}": 1 for i in range(500)}
    rows = [("c", 1, k, "", v) for k, v in before.items()] + [("c", 2, k, "", v) for k, v in after.items()]
    want = {("c", 2, "thing", k, "added" if k not in before else "removed" if k not in after else "changed") for k in before | after if before.get(k) != after.get(k)}
    assert changes(spark, [("c", 1, 0), ("c", 2, 0)], rows) == want
    assert changes(spark, [("c", 1, 0), ("c", 2, 0)], rows, bucket_rows=200) == want
    assert changes(spark, [("c", 1, 0), ("c", 2, 0)], rows * 2, group_rows=500) == want


def test_rows_are_compared_where_no_table_suffices(spark, monkeypatch):
    monkeypatch.setattr(S, "ROUNDS", 1)
    rows = [("c", 2, f"k{i}", "", 1) for i in range(500)]
    assert len(changes(spark, [("c", 1, 0), ("c", 2, 0)], rows)) == 500


def test_hashes_are_those_of_the_jvm(spark):
    df = spark.range(-5, 50).select(F.col("id").alias("a"), (F.col("id") * 7919 - 3).alias("b"))
    want = [r[0] for r in df.select(S._hash("a", "b", -3)).collect()]
    a = np.arange(-5, 50, dtype=np.int64)
    assert S._hash_np(a, a * 7919 - 3, -3).tolist() == want


def test_a_digest_that_is_not_explained_fails():
    k, v = np.array([11], np.int64), np.array([22], np.int64)
    cells = np.array([(S._hash_np(k, v, i) % 8 + 8 * i)[0] for i in range(3)])
    three = lambda x: np.repeat(x, 3)
    args = [np.zeros(3, np.int64), cells, np.ones(3, np.int64), three(k), three(v), three(S._hash_np(v, k, S.CHECK))]
    good = S._hash_np(k, v, S.DIGEST)
    found, ok = S.peel(*args, good, 8, 0)
    assert ok.tolist() == [True] and [x.tolist() for x in found] == [[0], [11], [22], [1]]
    assert S.peel(*args, good ^ 1, 8, 0)[1].tolist() == [False]


def test_random_snapshots_against_brute_force(spark):
    r = random.Random(6)
    rows, listed, want = [], [], set()
    for owner in "abc":
        before = None
        state = {f"e{i}": r.randrange(3) for i in range(40)}
        for no in sorted(r.sample(range(60), 25)):
            for _ in range(r.randrange(0, 8)):
                k = f"e{r.randrange(50)}"
                if r.random() < 0.4:
                    state.pop(k, None)
                else:
                    state[k] = r.choice([0, 1, None])
            rows += [(owner, no, k, "", v) for k, v in state.items() for _ in range(r.choice([1, 1, 3]))]
            if r.random() < 0.2:
                continue  # its rows are there, but it isn't listed
            listed += [(owner, no, 0)] * r.choice([1, 2])
            if before is not None:
                for k in before | state:
                    if (k in before, before.get(k)) != (k in state, state.get(k)):
                        want.add((owner, no, "thing", k, "added" if k not in before else "removed" if k not in state else "changed"))
            before = dict(state)
    r.shuffle(rows)
    assert len(want) > 50
    assert changes(spark, listed, rows) == want
    assert changes(spark, listed, rows, group_rows=100, bucket_rows=5) == want


def test_entities_whose_hashes_coincide_are_told_apart(monkeypatch):
    rows = [(7, "a", 0, 0, k, 5, s, n) for k, s, n in (("x", 1, 1), ("y", 1, 1), ("x", 1, 2), ("y", 2, 2))] + [(7, "a", 0, -1, None, 0, 0, n) for n in (1, 2)]
    names = ["h", "owner", "bucket", "kind", "id", "kh", "state", "no"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    out = [b.to_pylist() for b in S._compare(["thing"], 2048, 6)(S._pack(iter([batch])))]
    assert out == [[{"owner": "a", "no": 2, "entity_kind": "thing", "entity_id": "y", "change_kind": "changed"}]]
