import duckdb
from pyspark.sql import functions as F

from conftest import DATA
from tidelog.operators.folding import greedy_fill, unfilled
from tidelog.plans import reference


def test_each_row_is_filled_or_rejected(spark):
    rows = [(1, "a", 90), (2, "a", 101), (3, "a", 100), (4, None, 5), (None, "a", 5), (5, "b", None), (6, "b", 500)]
    df = spark.createDataFrame(rows, "o long, k string, s long")
    got = {(r.o, r.k, r.s): r.reject for r in unfilled(df, ["k"], "o", "s", 100).collect()}
    assert got == {(2, "a", 101): "oversize", (4, None, 5): "no key", (None, "a", 5): "no order", (5, "b", None): "no size", (6, "b", 500): "oversize"}
    filled = {(r.o, r.k, r.s) for r in greedy_fill(df, ["k"], "o", "s", 100, "b", "u").collect()}
    assert filled | got.keys() == set(rows) and not filled & got.keys()


def test_long_values_are_listed(spark, tmp_path):
    records = spark.read.parquet(f"{DATA}/records_in.parquet")
    long = F.when(F.col("arrival_seq") % 500 == 7, F.repeat(F.lit("x"), F.lit(2_000))).when(F.col("arrival_seq") % 500 == 8, F.repeat(F.lit("x"), F.lit(20_000)))
    records.withColumn("record_value", F.coalesce(long, "record_value")).coalesce(1).write.parquet(f"{tmp_path}/records_in.parquet")
    spark.read.parquet(f"{DATA}/topics.parquet").write.parquet(f"{tmp_path}/topics.parquet")
    found = [tuple(r) for r in reference.fill_rejects(spark, str(tmp_path)).select("arrival_seq", "fill", "reject").collect()]
    assert {(f, r) for _, f, r in found} == {("batch", "oversize"), ("flush", "oversize"), ("segment", "oversize")}
    n = {f: sum(g == f for _, g, _ in found) for f in ("batch", "segment")}
    assert n["batch"] > n["segment"] > 0
    filled = reference.batch_fill(spark, str(tmp_path)).agg(F.sum("n_records")).first()[0]
    assert filled + n["batch"] == records.count()
    assert reference.offset_index(spark, str(tmp_path)).count() + n["segment"] == records.count()
    con = duckdb.connect()
    con.execute(f"create view records_in as select * from read_parquet('{tmp_path}/records_in.parquet/*.parquet')")
    assert sorted(found) == sorted(con.sql(f"select arrival_seq, fill, reject from ({reference.SQL['fill_rejects']})").fetchall())
