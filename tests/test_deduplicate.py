import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.operators.arrow import whole_groups
from tidelog.operators.deduplicate import QuotientTable, first_copies, identifier_text, mark_copies, permute


def marked(spark, rows, schema="seq long, k string, v string, shard int, hi long"):
    df = spark.createDataFrame(rows, schema)
    return {r["seq"]: r["is_copy"] for r in mark_copies(df, "seq", [F.col("k"), F.col("v")], F.col("v").isNotNull()).collect()}


def test_one_copy_is_kept(spark):
    rows = [(5, "a", "x", 1, 1), (3, "a", "x", 2, 2), (9, "a", "x", 3, 3), (4, "a", "y", 1, 1), (1, None, "x", 1, 1), (2, None, "x", 1, 1), (6, "", "x", 1, 1), (7, "a", None, 1, 1)]
    assert marked(spark, rows) == {5: True, 3: False, 9: True, 4: False, 1: False, 2: True, 6: False}
    assert marked(spark, []) == {}


def test_fields_do_not_run_together(spark):
    rows = [(1, "a", "b:c", 0, 0), (2, "a:b", "c", 0, 0), (3, "1:a", "", 0, 0), (4, "", "1:a", 0, 0)]
    assert not any(marked(spark, rows).values())
    assert spark.range(1).select(identifier_text([F.lit("ab"), F.lit(None), F.lit(1)])).first()[0] == "2:ab~1:1"


def test_ties_and_rows_without_order(spark):
    assert marked(spark, [(1, "a", "x", 0, 0), (1, "a", "x", 0, 0), (2, "a", "x", 0, 0), (None, "a", "x", 0, 0)]) == {1: False, 2: True}


def test_hot_message_over_many_partitions(spark):
    df = spark.range(20_000, numPartitions=16).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = mark_copies(df, "seq", [F.col("k")]).groupBy("is_copy").count().collect()
    assert {r["is_copy"]: r["count"] for r in got} == {False: 20_000 - 6_666, True: 6_666}


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), min_size=1, max_size=40, unique=True))
@settings(max_examples=50, deadline=None)
def test_permutation_has_no_collisions(ids):
    hi, lo = permute(np.array([a for a, _ in ids], np.uint64), np.array([b for _, b in ids], np.uint64))
    assert len({*zip(hi.tolist(), lo.tolist(), strict=True)}) == len(ids)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=60))
@settings(max_examples=50, deadline=None)
def test_table_against_a_dictionary(ids):
    hi, lo = np.array([a for a, _ in ids], np.uint64), np.array([b for _, b in ids], np.uint64)
    seq = np.arange(len(ids), dtype=np.int64)[::-1].copy()
    kept, copies = QuotientTable().insert(hi, lo, seq)
    first: dict = {}
    for i, s in zip(ids, seq, strict=True):
        first[i] = min(first.get(i, s), s)
    assert sorted(seq[kept].tolist()) == sorted(first.values())
    assert len(kept) + len(copies) == len(ids)


@given(st.lists(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)).map(lambda x: (x[0] // 2**61 * 2**61, x[1])), max_size=30), max_size=5))
@settings(max_examples=50, deadline=None)
def test_table_takes_later_batches(batches):
    table, seen, n = QuotientTable(), set(), 0
    for ids in batches:
        hi, lo = np.array([a for a, _ in ids], np.uint64), np.array([b for _, b in ids], np.uint64)
        kept, copies = table.insert(hi, lo, np.arange(n, n + len(ids)))
        n += len(ids)
        new = [k for k, i in enumerate(ids) if i not in seen and i not in ids[:k]]
        assert sorted(kept.tolist()) == new and len(kept) + len(copies) == len(ids)
        seen |= set(ids)
        assert len(table) == len(seen) and table.contains(hi, lo).all()


def test_messages_of_earlier_batches_are_copies(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(rows, "seq long, k string")
    new = lambda df, n: sorted(r["seq"] for r in first_copies(df, n, str(tmp_path / "table"), "seq", [F.col("k")]).collect())
    assert new(batch((1, "a"), (2, "b"), (3, "a")), 0) == [1, 2]
    assert new(batch((4, "b"), (5, "c"), (0, "a"), (6, None)), 1) == [5, 6]
    assert new(batch((4, "b"), (5, "c"), (0, "a"), (6, None)), 1) == [5, 6]  # a batch that comes again
    assert new(batch((7, "c"), (8, None), (9, "d"), (9, "d")), 2) == [9, 9]


def test_batches_that_groups_extend_over():
    ids = np.repeat(np.arange(7), [1, 5, 1, 12, 2, 1, 3])
    for size in (1, 2, 3, 25):
        parts = [pa.RecordBatch.from_arrays([pa.array(ids[k : k + size])], names=["g"]) for k in range(0, len(ids), size)]
        for rows in (1, 4, 100):
            tables = [t.column("g").to_pylist() for t in whole_groups(iter(parts), ["g"], rows)]
            assert sum(tables, []) == ids.tolist()
            assert all(not set(a) & set(b) for i, a in enumerate(tables) for b in tables[i + 1 :])
