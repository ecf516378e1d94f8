"""Small text forms: ids, addresses, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def broker_number(broker_id: Column) -> Column:
    """Digits of a broker id as a number; null if it has none."""
    digits = F.regexp_replace(broker_id, "[^0-9]", "")
    return F.when(digits != "", digits).cast("long")


def addresses(text: Column) -> Column:
    """Array of (host, port) of "host:port,host:port"; parts without a port have a null one."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(F.split(p, ":")[0].alias("host"), F.try_element_at(F.split(p, ":"), F.lit(2)).cast("int").alias("port")),
    )


def topic_partition(topic: Column, partition: Column) -> Column:
    return F.concat_ws("-", topic, partition.cast("string"))


def segment_name(topic: Column, partition: Column, base_offset: Column) -> Column:
    return F.format_string("data/%s_partition%d_%05d.log", topic, partition, base_offset)
