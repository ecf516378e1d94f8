"""Exact removal of repeated messages with quotient hash tables.

A message's identity is turned into a fixed-width identifier, the 128 leading bits of a cryptographic digest of a
length-prefixed encoding of its fields (the encoding itself is one-to-one). The identifier is permuted by a bijection; the
leading bits of the image, the quotient, name the shard, and all the remaining bits are stored there. As the
permutation can be inverted, quotient and remainder together are the identifier: a table answers without false matches.

First every task inserts its own rows into a bounded local table, so a message with any number of copies sends one entry
per task to its shard; copies found on the way are settled at once and travel only as results, spread evenly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.arrow import whole_groups
from tidelog.runtime import cut, exists

#: Rows a task's local table takes before it is emptied into the shuffle.
LOCAL_ROWS = 1 << 20
#: So many shards that each holds few identifiers however many there are: of 2e12 some 500.
SHARD_BITS = 32

# Odd multipliers of the permutation (fixed values; any odd numbers do).
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def identifier_text(identity: Sequence[Column]) -> Column:
    """One-to-one text of the fields: every field as its length and value, null as a sign of its own."""
    parts = []
    for c in identity:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("~")))
    return F.concat(*parts)


def permute(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of 128-bit identifiers: Feistel rounds and odd multiplications, each of which can be undone."""
    hi, lo = hi.astype(np.uint64), lo.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in _ODD:
            hi, lo = lo, hi ^ ((lo ^ (lo >> np.uint64(29))) * np.uint64(k))
        return hi * np.uint64(_ODD[0]), lo * np.uint64(_ODD[1])


class QuotientTable:
    """A table of permuted identifiers that rows are inserted into; each is in it once.

    The leading bits of an image are its quotient, which names a run of the table; the remainders of a run are stored
    complete and in order, so nothing is found that isn't there. ``load`` is the mean length of a run.
    """

    def __init__(self, load: int = 4):
        self.load = load
        self.hi, self.lo = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self._index()

    def _index(self) -> None:
        """Quotients, as many as suit the entries, and where their runs start."""
        self.bits = max(int(np.ceil(np.log2(max(len(self.hi) / self.load, 2)))), 1)
        quotients = (self.hi >> np.uint64(64 - self.bits)).astype(np.int64)
        self.runs = np.searchsorted(quotients, np.arange((1 << self.bits) + 1))

    def __len__(self) -> int:
        return len(self.hi)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Whether each identifier is in the table: its run is gone through until its remainder is found."""
        quotient = (hi >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.runs[quotient], self.runs[quotient + 1]
        found, live = np.zeros(len(hi), bool), np.flatnonzero(at < end)
        at = at.copy()
        while len(live):
            same = (self.hi[at[live]] == hi[live]) & (self.lo[at[live]] == lo[live])
            found[live[same]] = True
            at[live] += 1
            live = live[~same & (at[live] < end[live])]
        return found

    def insert(self, hi: np.ndarray, lo: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inserts all rows; returns the places of the rows kept and of those that repeat an identifier.

        Of rows that come together the one with the lowest sequence number is kept; rows that tie with it are one delivery and
        are all kept. What was in the table before was kept then, so all rows with its identifiers repeat it.
        """
        order = np.lexsort((seq, lo, hi))
        h, r, s = hi[order], lo[order], seq[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(new)
        fresh = ~self.contains(h[first], r[first])
        at = np.cumsum(new) - 1
        kept = (s == s[first][at]) & fresh[at] if len(order) else new
        h, r = h[first[fresh]], r[first[fresh]]
        if len(self.hi):
            h, r = np.concatenate([self.hi, h]), np.concatenate([self.lo, r])
            merged = np.lexsort((r, h))
            h, r = h[merged], r[merged]
        self.hi, self.lo = h, r
        self._index()
        return order[kept], order[~kept]


_STAGE1 = "shard int, hi long, lo long, seq long, kind int"
#: Kinds of rows: entries to be settled, copies already found, entries of the table before.
ENTRY, COPY, KNOWN = 0, 1, 2


def _batch(shard, hi, lo, seq, kind: int) -> pa.RecordBatch:
    columns = [shard.astype(np.int32), hi.view(np.int64), lo.view(np.int64), seq, np.full(len(seq), kind, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "hi", "lo", "seq", "kind"])


def _halves(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of 16-byte identifiers."""
    raw = np.frombuffer(ids.cast(pa.binary(16)).buffers()[1], dtype=">u8", count=2 * len(ids), offset=16 * ids.offset)
    return raw[0::2].astype(np.uint64), raw[1::2].astype(np.uint64)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        hi, lo, seq = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        hi, lo = permute(hi, lo)
        kept, copies = QuotientTable().insert(hi, lo, seq)
        shift = np.uint64(64 - SHARD_BITS)
        for at, kind in ((kept, ENTRY), (copies, COPY)):
            for k in range(0, len(at), 1 << 16):
                x = at[k : k + (1 << 16)]
                yield _batch(seq[x] if kind == COPY else hi[x] >> shift, hi[x], lo[x], seq[x], kind)  # copies travel evenly spread

    rows = 0
    for b in batches:
        held.append((*_halves(b.column(0)), b.column(1).to_numpy()))
        rows += b.num_rows
        if rows >= LOCAL_ROWS:
            yield from flush()
            rows = 0
    if rows:
        yield from flush()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of shard; what is known of a shard is inserted first, then its entries."""
    for t in whole_groups(batches, ["shard"]):
        hi, lo, seq, kind = (t.column(c).to_numpy() for c in ("hi", "lo", "seq", "kind"))
        shards = QuotientTable()
        for k in (KNOWN, ENTRY):
            own = np.flatnonzero(kind == k)
            _, copies = shards.insert(hi[own].view(np.uint64), lo[own].view(np.uint64), seq[own])
        copy = kind == COPY
        copy[own[copies]] = True
        out = kind != KNOWN
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (hi, lo, seq, copy)], names=["hi", "lo", "seq", "copy"])


def settled(df: DataFrame, order: str, identity: Sequence[Column], where: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """(hi, lo, seq, copy) of every message: the two halves of its permuted identifier, its order, whether it is a copy.

    ``known`` (hi, lo) are the identifiers that earlier batches kept. The rows of the result that are no copies are what a
    later batch has to know besides.
    """
    rows = df.where(where) if where is not None else df
    digest = F.substring(F.unhex(F.sha2(identifier_text(identity), 256)), 1, 16)
    ids = rows.select(digest.alias("id"), F.col(order).cast("long").alias("seq")).where(F.col("seq").isNotNull())
    entries = ids.mapInArrow(_local, _STAGE1)
    if known is not None:
        shard = F.shiftright("hi", 64 - SHARD_BITS).cast("int")
        entries = entries.unionByName(known.select(shard.alias("shard"), "hi", "lo", F.lit(0).cast("long").alias("seq"), F.lit(KNOWN).alias("kind")))
    return entries.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards, "hi long, lo long, seq long, copy boolean")


def mark_copies(df: DataFrame, order: str, identity: Sequence[Column], where: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """(order, is_copy) for every row of ``df`` that fulfils ``where``; is_copy if an earlier row has the same identity.

    Earlier are rows of ``df`` with a lower ``order``, a whole number, and all messages that are ``known`` from batches before
    (see settled). Null equals only null in ``identity``. Defined results: rows that do not fulfil ``where`` are left out, as they
    are no messages; rows without ``order`` too; rows with equal ``order`` are one delivery, none a copy of the other; an
    empty table gives no rows; further columns are ignored.
    """
    return settled(df, order, identity, where, known).select(F.col("seq").alias(order), F.col("copy").alias("is_copy"))


def first_copies(stream_batch: DataFrame, number: int, path: str, order: str, identity: Sequence[Column], where: Column | None = None) -> DataFrame:
    """(order) of the messages of a numbered batch that no batch before it had, which are then known to later ones.

    The table of identifiers is kept under ``path``, a folder per batch; a batch that comes again replaces its own.
    """
    spark = stream_batch.sparkSession
    known = None
    if exists(spark, path):
        known = spark.read.schema("hi long, lo long, batch long").parquet(path).where(F.col("batch") < number)
    marked = cut(settled(stream_batch, order, identity, where, known))
    kept = marked.where("not copy")
    kept.select("hi", "lo").distinct().write.mode("overwrite").parquet(f"{path}/batch={number}")
    return kept.select(F.col("seq").alias(order))
