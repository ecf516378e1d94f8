"""Session helpers shared by the operators: tables, shared storage, checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a compact side table is broadcast; beyond either the join is left to a shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 48 << 20


def local_session(app: str = "tidelog", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("TIDELOG_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local one, but only on a single machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = named or _local_dir()
    sc.setCheckpointDir(path)
    return path


def _local_dir() -> str:
    """A folder for a session on a single machine, removed when Python ends."""
    path = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for results that are read lazily; what is there is removed when Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_if_possible, spark, path)
    return path


def _remove_if_possible(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        remove(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder, so that later jobs survive a lost executor without recomputing it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _width(f: T.StructField) -> Column:
    """Bytes of a field's values, about."""
    if isinstance(f.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 16
    if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
        return F.octet_length(F.to_json(F.struct(f"`{f.name}`"))) + 16
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast if the (already cut) table is within both bounds; else leaves the join to a shuffle."""
    widths = [_width(f) for f in df.schema.fields]
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(sum(widths[1:], widths[0]))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def spread(df: DataFrame) -> DataFrame:
    """Input of expensive Python work over all cores: rows are dealt out only if there are fewer splits than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
