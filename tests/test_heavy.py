from pyspark.sql import functions as F

from tidelog.operators.heavy import heavy_keys, key_counts


def test_heavy_keys(spark):
    keys = ["a"] * 60 + ["b"] + [None] * 20 + [""] * 19 + ["c"] * 100
    df = spark.createDataFrame([(k, 1, 2) for k in keys], "k string, n_rows int, _key int")
    assert {tuple(r) for r in heavy_keys(df, "k", 0.3).collect()} == {("a", 60, 200), ("c", 100, 200)}
    assert {r["k"] for r in heavy_keys(df, "k", 0.005).collect()} == {"a", "b", "c"}  # exactly at the share
    assert {r["k"] for r in heavy_keys(df, "k", 0.0051).collect()} == {"a", "c"}
    assert heavy_keys(df.where("false"), "k").collect() == []


def test_counts_of_a_hot_key_and_null(spark):
    df = spark.range(10_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    got = {r["k"]: r["n_rows"] for r in key_counts(df, ["k"]).collect()}
    assert got["hot"] == 3334 and got[None] == 3333 and len(got) == 3335
    assert key_counts(df.where("false"), ["k"]).collect() == []
