"""Payload codecs, by Arrow batches: Spark SQL has none of them as a function.

Streams are the standard ones, so other programs can read them and be read: gzip members, raw snappy, zstd frames. Only an
lz4 block has four bytes before it, the length of its content, as the block itself doesn't tell.
"""

from __future__ import annotations

import gzip
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Names by their ids (fixed values).
CODECS = ("none", "gzip", "snappy", "lz4", "zstd")


def codec_id(name: str) -> int:
    """Id of a codec by its name in any case; ValueError if it is unknown."""
    if name is None or name.lower() not in CODECS:
        raise ValueError(f"unknown codec: {name}")
    return CODECS.index(name.lower())


def codec_name(number: int) -> str:
    if not 0 <= number < len(CODECS):
        raise ValueError(f"unknown codec id: {number}")
    return CODECS[number]


def configured_codec(name: Column) -> Column:
    """The codec a configuration names, in any case; none if it is null or unknown."""
    low = F.lower(F.trim(name))
    return F.when(low.isin(*CODECS), low).otherwise(F.lit("none"))


@lru_cache
def _codec(name: str) -> pa.Codec:
    return pa.Codec(name)


def compress_bytes(codec: str, data: bytes | None) -> bytes | None:
    if not data or codec == "none":
        return data
    if codec == "lz4":
        return len(data).to_bytes(4, "big") + _codec("lz4_raw").compress(data, asbytes=True)
    if codec == "snappy":  # the raw format carries the length itself
        return _codec("snappy").compress(data, asbytes=True)
    if codec == "gzip":
        return gzip.compress(data, mtime=0)
    return _codec("zstd").compress(data, asbytes=True)  # a frame with its content's size


def decompress_bytes(codec: str, data: bytes | None) -> bytes | None:
    if not data or codec == "none":
        return data
    if codec == "snappy":
        size, shift = 0, 0
        for b in data[:5]:
            size |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                break
        return _codec("snappy").decompress(data, decompressed_size=size, asbytes=True)
    if codec == "gzip":
        return gzip.decompress(data)
    if codec == "zstd":
        try:
            size = zstandard.frame_content_size(data)
        except zstandard.ZstdError:
            size = -1
        if size <= 0:
            raise ValueError("unknown length of zstd data")
        return _codec("zstd").decompress(data, decompressed_size=size, asbytes=True)
    size = int.from_bytes(data[:4], "big")
    if size <= 0:
        raise ValueError("unknown length of lz4 data")
    return _codec("lz4_raw").decompress(data[4:], decompressed_size=size, asbytes=True)


@F.pandas_udf(BinaryType())
def compress(codec: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([compress_bytes(c, d) for c, d in zip(codec, data, strict=True)], dtype=object)


@F.pandas_udf(BinaryType())
def decompress(codec: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([decompress_bytes(c, d) for c, d in zip(codec, data, strict=True)], dtype=object)
