"""Record headers: an ordered list of (key, value) in which keys may repeat, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY, VALUE = "header_key", "header_value"


def add(headers: Column, key: Column, value: Column) -> Column:
    return F.array_append(F.coalesce(headers, F.array().cast(f"array<struct<{KEY}:string,{VALUE}:binary>>")), F.struct(key.alias(KEY), value.alias(VALUE)))


def values(headers: Column, key: Column) -> Column:
    """All values of a key in order; empty if there is none."""
    return F.transform(F.filter(headers, lambda h: h[KEY].eqNullSafe(key)), lambda h: h[VALUE])


def last(headers: Column, key: Column) -> Column:
    """The last value of a key; null if there is none."""
    return F.try_element_at(values(headers, key), F.lit(-1))


def remove(headers: Column, key: Column) -> Column:
    return F.filter(headers, lambda h: ~h[KEY].eqNullSafe(key))


def keys(headers: Column) -> Column:
    """Distinct keys in the order of their first appearance."""
    return F.array_distinct(F.transform(headers, lambda h: h[KEY]))


def flat(headers: Column) -> Column:
    """The headers grouped by key, keys in the order of their first appearance, values in order."""
    return F.flatten(F.transform(keys(headers), lambda k: F.filter(headers, lambda h: h[KEY].eqNullSafe(k))))
