"""MurmurHash2 of keys and the partition it selects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Fixed values of the public MurmurHash2 function with its usual seed.
SEED = 0x9747B28C
MULTIPLIER = 0x5BD1E995


def murmur2_of(keys: list[bytes]) -> np.ndarray:
    """Signed 32-bit hashes. All keys are mixed block by block together, as long as they have blocks."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(keys) + b"\0" * 4, np.uint8).astype(np.uint32)
    m = np.uint32(MULTIPLIER)
    h = np.uint32(SEED) ^ lengths.astype(np.uint32)
    live, i = np.flatnonzero(lengths >= 4), 0
    with np.errstate(over="ignore"):
        while len(live):
            at = starts[live] + 4 * i
            k = data[at] | data[at + 1] << np.uint32(8) | data[at + 2] << np.uint32(16) | data[at + 3] << np.uint32(24)
            k = k * m
            k = (k ^ (k >> np.uint32(24))) * m
            h[live] = (h[live] * m) ^ k
            i += 1
            live = live[lengths[live] >= 4 * (i + 1)]
        at, rest = starts + lengths // 4 * 4, lengths % 4
        for n in (2, 1, 0):
            h = np.where(rest > n, h ^ (data[np.minimum(at + n, len(data) - 1)] << np.uint32(8 * n)), h)
        h = np.where(rest > 0, h * m, h)
        h = (h ^ (h >> np.uint32(13))) * m
        h = h ^ (h >> np.uint32(15))
    return h.view(np.int32)


@F.pandas_udf(IntegerType())
def _murmur2(keys: pd.Series) -> pd.Series:
    return pd.Series(murmur2_of([k.encode() for k in keys]))


def murmur2(key: Column) -> Column:
    """Signed 32-bit hash of the key's UTF-8 bytes; 0 for null.

    The function has no expression of its own in Spark, and one put together of others is interpreted byte by byte, so
    whole Arrow batches are hashed at a time.
    """
    return F.when(key.isNull(), 0).otherwise(_murmur2(F.coalesce(key, F.lit(""))))


def key_partition(key: Column, partitions: Column, first: Column | int = 0) -> Column:
    """Partition of a key in the range that starts at ``first``; ``first`` for a null or empty key."""
    first = F.lit(first) if isinstance(first, int) else first
    chosen = first + F.pmod(murmur2(key).cast("long").bitwiseAND(F.lit(0x7FFFFFFF)), partitions.cast("long"))
    return F.when(key.isNull() | (key == ""), first).otherwise(chosen).cast("int")
