"""Irregular readings onto a regular grid, missing cells filled by a low-rank factorisation.

Every source's periods are laid out as a matrix of so many periods a row; the rows of all sources together form one
source-by-time matrix. A row is its median plus a few factors, each a course over the row that all sources share. Alternating
least squares fits both sides to the observed deviations: with the courses given, each row's factors follow from its own
cells; with the factors given, the courses follow from small normal equations that are summed over all rows. Only
these sums leave a task, so a round shuffles as many numbers as a row has cells, whatever the rows. Deviations far beyond the
source's usual scatter are cut to it while fitting, as implausible readings would else bend the courses.

Observed cells stay as they are. A cell whose row or column has too few observations to fit anything stays marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.runtime import cut, small

#: Multiple of a source's scatter, by its interquartile range, that deviations are cut to.
CUT, IQR_PER_SIGMA = 4.0, 1.349
#: Rows without any reading that are listed at a time.
PIECE = 1024


def observed_cells(df: DataFrame, source: str, time: str, value: str, period_ms: int) -> DataFrame:
    """(src, period, value): the last reading of each source and period (of equal times the greatest value)."""
    return (
        df.select(F.col(source).alias("src"), F.col(time).alias("ts"), F.col(value).cast("double").alias("v"))
        .where(F.col("src").isNotNull() & F.col("ts").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy("src", F.floor(F.col("ts") / period_ms).alias("period"))
        .agg(F.max(F.struct("ts", "v"))["v"].alias("v"))
    )


def matrix_rows(cells: DataFrame, width: int) -> DataFrame:
    """(src, row, place, v): the observed cells of each row of ``width`` periods, as two lists."""
    row = F.floor(F.col("period") / width)
    placed = cells.select("src", row.alias("row"), F.struct((F.col("period") - row * width).cast("int").alias("place"), "v").alias("c"))
    return placed.groupBy("src", "row").agg(F.collect_list("c").alias("c")).select("src", "row", F.col("c.place").alias("place"), F.col("c.v").alias("v"))  # width cells at most


def _median(values: F.Column) -> F.Column:
    s = F.sort_array(F.filter(values, lambda x: F.abs(x) < float("inf")))
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _with_scatter(rows: DataFrame) -> DataFrame:
    """Adds each row's median, and the most that its source's deviations count for."""
    rows = rows.withColumn("median", _median(F.col("v")))
    deviations = rows.select("src", F.explode("v").alias("x"), "median").select("src", (F.col("x") - F.col("median")).alias("x")).where(F.abs("x") < float("inf"))
    quartiles = F.percentile_approx("x", F.array(F.lit(0.25), F.lit(0.75)), 1000)
    scatter = deviations.groupBy(F.col("src").alias("_s")).agg(quartiles.alias("q")).select("_s", (CUT / IQR_PER_SIGMA * (F.col("q")[1] - F.col("q")[0])).alias("most"))
    return rows.join(small(cut(scatter)), F.col("src") == F.col("_s"), "left").drop("_s")


def _dense(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(deviations, whether there is one, values) by row and place; values are not a number where there is none."""
    lists = b.column("place")
    row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
    place, v = lists.flatten().to_numpy(), b.column("v").flatten().to_numpy()
    values = np.full((b.num_rows, width), np.nan)
    values[row, place] = v
    median, most = (np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("median", "most"))
    fitted = np.isfinite(values)
    x = np.where(fitted, np.clip(np.where(fitted, values, 0) - median[:, None], -most[:, None], most[:, None]), 0.0)
    return x, fitted, values


def _factors(x: np.ndarray, fitted: np.ndarray, courses: np.ndarray, ridge: float) -> np.ndarray:
    """Factors of each row by least squares, the courses given."""
    a = np.einsum("rc,ci,cj->rij", fitted, courses, courses, optimize=True) + ridge * np.eye(courses.shape[1])
    return np.linalg.solve(a, (x @ courses)[:, :, None])[:, :, 0]


def _sums(courses: np.ndarray, ridge: float):
    """The normal equations of the courses over a task's rows, what is left unexplained, and the cells by place, in one list."""
    width, rank = courses.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * (rank * rank + rank + 1) + 1)
        for b in batches:
            x, fitted, _ = _dense(b, width)
            u = _factors(x, fitted, courses, ridge)
            a = np.einsum("rc,ri,rj->cij", fitted, u, u, optimize=True)
            left = (np.where(fitted, x - u @ courses.T, 0) ** 2).sum()
            total += np.concatenate([a.ravel(), (x.T @ u).ravel(), fitted.sum(axis=0), [left]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def factorise(rows: DataFrame, width: int, rank: int, rounds: int, ridge: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(courses by place, observations by place) by alternating least squares, until a round explains hardly more.

    Rounds start from smooth courses: a constant, half a wave, a wave... The result has width x rank numbers.
    """
    courses = np.stack([np.cos(np.pi * j * (np.arange(width) + 0.5) / width) for j in range(rank)], axis=1)
    before = np.inf
    for _ in range(rounds):
        each = rows.mapInArrow(_sums(courses, ridge), "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
        total = np.zeros(width * (rank * rank + rank + 1) + 1)
        for r in each.groupBy("at").agg(F.sum("x").alias("x")).collect():  # a fixed number of sums
            total[r["at"]] = r["x"]
        a = total[: width * rank * rank].reshape(width, rank, rank)
        b = total[width * rank * rank : width * (rank * rank + rank)].reshape(width, rank)
        seen, left = total[-width - 1 : -1], total[-1]
        if left > before * (1 - tolerance):
            break
        before = left
        # A course stays close to what it was where hardly anything speaks for a change.
        courses = np.linalg.solve(a + ridge * np.eye(rank), (b + ridge * courses)[:, :, None])[:, :, 0]
    return courses, seen


def _filled(courses: np.ndarray, seen: np.ndarray, ridge: float, least_row: int, least_place: int):
    """The cells of rows, each from the source's first to its last period."""
    width = courses.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, fitted, values = _dense(b, width)
            guess = _factors(x, fitted, courses, ridge) @ courses.T + np.nan_to_num(b.column("median").to_numpy(zero_copy_only=False).astype(float))[:, None]
            period = b.column("row").to_numpy()[:, None] * width + np.arange(width)
            first, last = (b.column(c).to_numpy()[:, None] for c in ("first", "last"))
            r, c = np.nonzero((period >= first) & (period <= last))
            v = values[r, c]
            observed = ~np.isnan(v)
            held = ~observed & (fitted.sum(axis=1)[r] >= least_row) & (seen[c] >= least_place)
            estimate = np.where(held, guess[r, c], np.nan)
            status = np.where(observed, 0, np.where(held, 1, 2))
            names = np.array(["observed", "filled", "unsupported"], object)
            columns = [
                b.column("src").take(pa.array(r)), pa.array(period[r, c]), pa.array(np.where(observed, v, estimate), mask=~(observed | held)),
                pa.array(names[status], pa.string()), pa.array(estimate, mask=~held),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["src", "period", "v", "status", "estimate"])

    return run


def _empty_rows(rows: DataFrame, width: int) -> DataFrame:
    """(src, period) of the rows between two of a source that have no reading at all, listed a bounded piece at a time."""
    following = F.lead("row").over(Window.partitionBy("src").orderBy("row"))
    gaps = rows.select("src", "row", following.alias("next")).where(F.col("next") > F.col("row") + 1)
    pieces = gaps.select("src", "next", F.explode(F.sequence(F.col("row") + 1, F.col("next") - 1, F.lit(PIECE).cast("long"))).alias("from"))
    each = pieces.select("src", F.explode(F.sequence("from", F.least(F.col("from") + PIECE, F.col("next")) - 1)).alias("row"))
    return each.select("src", F.explode(F.sequence(F.col("row") * width, (F.col("row") + 1) * width - 1)).alias("period"))


def regular_grid(
    df: DataFrame,
    source: str,
    time: str,
    value: str,
    period_ms: int = 60_000,
    width: int = 30,
    rank: int = 2,
    rounds: int = 8,
    ridge: float = 3.0,
    tolerance: float = 0.01,
    least_row: int = 3,
    least_place: int = 2,
) -> DataFrame:
    """One row per source and period from its first to its last reading: (source, period_start_ms, value, status, estimate).

    ``status`` is ``observed`` (value is the period's last reading, estimate null), ``filled`` (value and estimate are from
    the factorisation) or ``unsupported`` (both null: of the ``width`` periods of its matrix row fewer than ``least_row`` are
    observed, or of all rows fewer than ``least_place`` have its place observed). Readings are rows with source and time whose
    value is neither null nor not-a-number; infinite values are observed but not fitted. Defined results: repeated rows count
    once; a source with one reading has one row; an empty table gives no rows; further columns are ignored.
    """
    rows = cut(matrix_rows(observed_cells(df, source, time, value, period_ms), width))
    kind = rows.schema["src"].dataType.simpleString()
    marked = _with_scatter(rows)
    courses, seen = factorise(marked, width, rank, rounds, ridge, tolerance)
    bounds = rows.groupBy(F.col("src").alias("_b")).agg(
        F.min(F.col("row") * width + F.array_min("place")).alias("first"), F.max(F.col("row") * width + F.array_max("place")).alias("last")
    )
    bounded = marked.join(small(cut(bounds)), F.col("src") == F.col("_b")).drop("_b")
    cells = bounded.mapInArrow(_filled(courses, seen, ridge, least_row, least_place), f"src {kind}, period long, v double, status string, estimate double")
    none = F.lit(None).cast("double")
    empty = _empty_rows(rows, width).select("src", "period", none.alias("v"), F.lit("unsupported").alias("status"), none.alias("estimate"))
    return cells.unionByName(empty).select(F.col("src").alias(source), (F.col("period") * period_ms).alias("period_start_ms"), F.col("v").alias(value), "status", "estimate")
