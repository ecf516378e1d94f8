"""The stored log: Parquet by topic and partition, appended batch by batch; records from tables, files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS_IN = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("target_partition", T.IntegerType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("record_key", T.StringType()),
        T.StructField("record_value", T.StringType()),
        T.StructField(
            "headers",
            T.ArrayType(T.StructType([T.StructField("header_key", T.StringType()), T.StructField("header_value", T.BinaryType())])),
        ),
        T.StructField("arrival_seq", T.LongType()),
    ]
)


def read_records(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Records of a bounded source of any of Spark's formats, in the schema of RECORDS_IN; absent columns are null."""
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(RECORDS_IN) if fmt in ("json", "csv") else reader).load(path)
    return stamped(df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RECORDS_IN]))


def stream_records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same as a stream of the Parquet files of a folder."""
    return stamped(spark.readStream.schema(RECORDS_IN).options(**options).parquet(path))


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType, files: int = 8) -> DataFrame:
    """A table of a folder, one file or a folder of files, as a stream that takes so many files at a time."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files))
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def stamped(records: DataFrame) -> DataFrame:
    """Records without a timestamp get the present one."""
    return records.withColumn("timestamp_ms", F.coalesce("timestamp_ms", F.unix_millis(F.current_timestamp())))


def encode(records: DataFrame, columns: list[str]) -> DataFrame:
    """Wire rows: topic, target_partition and the record's fields as opaque bytes."""
    return records.select("topic", "target_partition", F.encode(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), "UTF-8").alias("data"))


def decode(wire: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The records of wire rows."""
    return wire.select(F.from_json(F.decode("data", "UTF-8"), schema).alias("r")).select("r.*")


def append(log: DataFrame, path: str, batch: int | None = None) -> None:
    """Appends records to the log. A numbered batch that comes again replaces itself, so retries store nothing twice.

    What is appended without a number is batch -1. A partition's rows should come in order of offset, so that its files and row
    groups cover ranges of offsets that reads can pass over.
    """
    writer = log.write.partitionBy("topic", "target_partition")
    writer.mode("append" if batch is None else "overwrite").parquet(f"{path}/batch={-1 if batch is None else batch}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; filters on topic, target_partition and offset prune files and row groups.

    Names of topics are texts even where they look like numbers.
    """
    found = spark.read.parquet(path).schema
    kinds = {"topic": T.StringType(), "target_partition": T.IntegerType(), "batch": T.LongType()}
    return spark.read.schema(T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])).parquet(path)


def stored_log(log: DataFrame, path: str) -> DataFrame:
    """Writes a numbered log as a whole, each partition in order of offset, and returns what is stored."""
    append(log.repartition("topic", "target_partition").sortWithinPartitions("topic", "target_partition", "offset"), path)
    return read_log(log.sparkSession, path)


def read_from(log: DataFrame, topic: str, partition: int, start: int, most: int = 1) -> DataFrame:
    """At most ``most`` records of one partition from an offset on; only its files and the row groups around the offset are read."""
    at = F.col("offset")
    return log.where((F.col("topic") == topic) & (F.col("target_partition") == partition) & (at >= start) & (at < start + most))


def tail_log(spark: SparkSession, path: str, schema: T.StructType, files: int = 64) -> DataFrame:
    """The stored log as a stream: what is there, then what is appended, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(path)


def high_water_marks(log: DataFrame) -> DataFrame:
    """(topic, target_partition, next_offset)."""
    return log.groupBy("topic", "target_partition").agg((F.max("offset") + 1).alias("next_offset"))


def commit_offsets(commits: DataFrame, path: str) -> None:
    """Stores commits (group_id, topic, target_partition, offset, commit_ts)."""
    commits.select("group_id", "topic", "target_partition", "offset", "commit_ts").write.mode("append").parquet(path)


def fetch_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, topic, target_partition, committed): the last commit of each group and partition; of equal times the greatest offset."""
    last = F.max(F.struct("commit_ts", "offset"))["offset"]
    return spark.read.parquet(path).groupBy("group_id", "topic", "target_partition").agg(last.alias("committed"))
