"""Per-key results without imbalance: mergeable key states are combined in the map tasks before anything is shuffled."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, keys: Sequence[str], count: str = "n_rows") -> DataFrame:
    """(keys..., count) of all rows. Each map task sends one partial count per key it saw, however many rows the key has.

    The hash tables of the partial aggregate are bounded: when memory runs out they spill sorted and are merged. Null is a
    key of its own, and so is an empty text; an empty table gives no rows.
    """
    return df.groupBy(*keys).agg(F.count("*").alias(count))


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """(key, n_rows, n_total): keys, neither null nor empty, with at least ``share`` of all rows.

    All rows count in n_total, whatever their key. An empty table has no heavy keys. The total needs no column, so for
    it only the files' row counts are read.
    """
    part = Fraction(str(share))
    counts = key_counts(df.select(F.col(key).alias("_key")), ["_key"])
    total = df.agg(F.count("*").alias("n_total"))  # one row
    return (
        counts.where(F.col("_key").isNotNull() & (F.col("_key") != ""))
        .join(F.broadcast(total), F.col("n_rows") * part.denominator >= F.col("n_total") * part.numerator)
        .select(F.col("_key").alias(key), "n_rows", "n_total")
    )
