"""Greedy filling of batches and segments along an order: a fold that starts anew whenever the next record doesn't fit.

Where a fill starts depends on all records before, but a block of records needs to know of them only how full the
open bin is. So each block is summarised as a step function from the fill it is entered with to the fill it is left
with (within the first ``cap`` bytes of the block, later starts soon coincide, so the function has few steps). The functions are
applied one after the other per key, which only touches the compact summaries; then every block is filled by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.runtime import cut, small



def _starts(sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums before each record, for a bin that starts at record i the record at which the next one starts)."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    return sums, np.searchsorted(sums, sums[:-1] + cap, side="right") - 1


def _first_start(sums: np.ndarray, cap: int, fill: int) -> int:
    """The first record that doesn't fit a bin which is filled up to ``fill``."""
    return max(int(np.searchsorted(sums, cap - fill, side="right")) - 1, 0)


def block_summary(sizes: np.ndarray, cap: int) -> list[tuple[int, int, int]]:
    """Steps (least fill on entering, fill on leaving, bins opened) of a block; the first is for fills from 0.

    While the block fits the open bin the fill grows by all of it: such a step has -1 bins and the block's size.
    """
    n = len(sizes)
    sums, following = _starts(sizes, cap)
    leave = np.empty(n + 1, np.int64)
    bins = np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = following[i]
        leave[i], bins[i] = (sums[n] - sums[i], 1) if j >= n else (leave[j], bins[j] + 1)
    steps: list[tuple[int, int, int]] = []
    if sums[n] <= cap:
        steps.append((0, int(sums[n]), -1))
    last = _first_start(sums, cap, 0)  # the latest possible first start
    for p in range(min(last, n - 1), -1, -1):
        fill = max(0, int(cap - sums[p + 1]) + 1)  # from this fill on, record p doesn't fit
        step = (fill, int(leave[p]), int(bins[p]))
        if steps and steps[-1][0] == fill:
            steps.pop()
        if not steps or steps[-1][1:] != step[1:]:
            steps.append(step)
    return steps


def enter(steps: list[tuple[int, int, int]], fill: int) -> tuple[int, int]:
    """(fill on leaving, bins opened) of a block entered with ``fill``."""
    at = max(i for i, s in enumerate(steps) if s[0] <= fill)
    _, leave, bins = steps[at]
    return (fill + leave, 0) if bins < 0 else (leave, bins)


def fill_block(sizes: np.ndarray, cap: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins opened up to and with each record, bytes before it in its bin) of a block entered with ``fill``."""
    n = len(sizes)
    sums, following = _starts(sizes, cap)
    opened, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    p = min(_first_start(sums, cap, fill), n)
    before[:p] = fill + sums[:p]
    count = 0
    while p < n:
        q = min(int(following[p]), n)
        count += 1
        opened[p:q] = count
        before[p:q] = sums[p:q] - sums[p]
        p = q
    return opened, before


def _entry_states(slim: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """(keys..., _block, _fill, _base) of rows (keys..., _block, _order, _size): the state each block is entered with."""
    types = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys)

    def head(pdf: pd.DataFrame, n: int = 1) -> dict:
        return {k: [pdf[k].iloc[0]] * n for k in keys}

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = block_summary(pdf.sort_values("_order")["_size"].to_numpy(), cap)
        return pd.DataFrame(head(pdf) | {"_block": [pdf["_block"].iloc[0]], "steps": [[list(s) for s in steps]]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        fill, bins, fills, bases = cap + 1, 0, [], []
        pdf = pdf.sort_values("_block")
        for steps in pdf["steps"]:
            fills.append(fill)
            bases.append(bins)
            fill, opened = enter([tuple(map(int, s)) for s in steps], fill)
            bins += opened
        return pd.DataFrame(head(pdf, len(pdf)) | {"_block": pdf["_block"].to_numpy(), "_fill": fills, "_base": bases})

    summaries = slim.groupBy(*keys, "_block").applyInPandas(summarise, f"{types}, _block long, steps array<array<long>>")
    return summaries.groupBy(*keys).applyInPandas(chain, f"{types}, _block long, _fill long, _base long")


def unfilled(df: DataFrame, keys: Sequence[str], order: str, size: str, cap: int) -> DataFrame:
    """The rows that greedy_fill leaves out, with ``reject``: why they can't be filled in. Every row is in one of both."""
    reject = F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) > 0, "no key")
    reject = reject.when(F.col(order).isNull(), "no order").when(F.col(size).isNull(), "no size").when(F.col(size) > cap, "oversize")
    return df.withColumn("reject", reject).where("reject is not null")


def greedy_fill(df: DataFrame, keys: Sequence[str], order: str, size: str, cap: int, bin_name: str, before_name: str, block: int = 1 << 17) -> DataFrame:
    """Adds ``bin_name`` (0, 1... within keys) and ``before_name`` (bytes of the bin before the record).

    A record goes into the open bin if it fits (reaching ``cap`` exactly is allowed), else opens a new one. Records larger
    than ``cap`` fit no bin and are left out, as are rows without a key, ``order`` or ``size``; they don't close the open
    bin. ``unfilled`` has them, with the reason. Keys with more than ``block`` rows are filled block by block.
    """
    rows = df.where(F.col(order).isNotNull() & (F.col(size) <= cap))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    hot = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(*keys, F.lit(True).alias("_hot")))
    # A fill above cap opens a bin with the very first record: the state before any record.
    fresh, none = F.lit(cap + 1).cast("long"), F.lit(0).cast("long")
    if hot.isEmpty():
        rows = rows.select("*", none.alias("_block"), fresh.alias("_fill"), none.alias("_base"))
    else:
        rows = rows.join(small(hot), list(keys), "left").select(*[rows[c] for c in df.columns], F.when(F.col("_hot"), F.floor(F.col(order) / block)).otherwise(none).alias("_block"), "_hot")
        slim = rows.where("_hot").select(*keys, "_block", F.col(order).alias("_order"), F.col(size).cast("long").alias("_size"))
        states = cut(_entry_states(slim, keys, cap))
        rows = rows.join(small(states), [*keys, "_block"], "left").select(
            *[rows[c] for c in df.columns], rows["_block"], F.coalesce("_fill", fresh).alias("_fill"), F.coalesce("_base", none).alias("_base")
        )

    def apply(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[(order, "ascending")]))
        opened, before = fill_block(t[size].cast(pa.int64()).to_numpy(), cap, t["_fill"][0].as_py())
        out = t.drop_columns(["_block", "_fill", "_base"])
        return out.append_column(bin_name, pa.array(opened + t["_base"][0].as_py() - 1)).append_column(before_name, pa.array(before))

    schema = T.StructType([*df.schema.fields, T.StructField(bin_name, T.LongType()), T.StructField(before_name, T.LongType())])
    return rows.groupBy(*keys, "_block").applyInArrow(apply, schema)
