"""Numbers along an order, without ever sorting a whole hot group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.runtime import cut, small

#: Span of the order column that is numbered by one task.
BLOCK = 1 << 18


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_r_{k}"])
    return on


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds ``name``: 0, 1, 2... along ``order`` within ``keys`` (none: over all rows).

    ``order`` must be a whole number, unique within the keys; rows without it are left out. Rows are numbered within blocks of the order
    column; the compact counts per block are added up before, so a key with most of the rows is spread over its blocks.
    """
    rows = df.where(F.col(order).isNotNull()).withColumn("_block", F.floor(F.col(order) / block))
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_block").alias("_r__block"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    bases = small(cut(bases))
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    joined = rows.join(bases, _same(rows, bases, [*keys, "_block"]))
    number = (F.row_number().over(within) - 1 + F.col("_base")).cast("long")
    return joined.select(*[rows[c] for c in df.columns], rows["_block"], "_base").withColumn(name, number).drop("_block", "_base")


def ranked(df: DataFrame, outer: str, inner: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the rank of each row by (outer, inner...), from 0. Only the counts per outer value meet in one task."""
    counts = df.groupBy(outer).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumnRenamed(outer, "_o").select("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(outer).orderBy(*inner)
    return df.join(bases, df[outer] == bases["_o"]).withColumn(name, (F.row_number().over(within) - 1 + F.col("_base")).cast("long")).drop("_o", "_base")
