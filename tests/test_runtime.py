from pyspark.sql import functions as F

from tidelog.runtime import small, spread


def hinted(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "hint" in df._jdf.queryExecution().logical().toString().lower()


def test_broadcast_only_within_bounds(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array("id").alias("a"))
    assert hinted(small(df)) and not hinted(small(df, rows=99)) and not hinted(small(df, size=50_000))
    assert hinted(small(df.where("false")))


def test_rows_are_dealt_out_only_if_there_are_few_splits(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(10, numPartitions=cores + 3)).rdd.getNumPartitions() == cores + 3
