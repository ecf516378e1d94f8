"""What changed between full snapshots, by subtracting invertible Bloom lookup tables.

Every snapshot is summarised, per hash bucket of its entities, in a table of cells that hold a count and exclusive-ors
of key hashes, row hashes and check hashes. Subtracting a predecessor's table cancels what both have, however much that
is, so what is left depends on the differences alone; peeling cells with a single entry recovers the differing pairs of
key hash and row hash. Buckets that don't peel, or whose digest is not explained by what was recovered, are
done again with larger tables. Recovered keys are then looked up among the rows and classified.

The rows are shuffled once. Each task first packs its own rows: repeated ones go, and an entity that looks the same in
many snapshots is sent as one state with their numbers. All snapshots of an owner's bucket meet in one task, which
makes each snapshot's tables once and subtracts neighbours. Owners with many rows have many buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.arrow import codes, whole_groups
from tidelog.runtime import cut, small

CELLS = 24
GROW = 4
HASHES = 3
#: Entities of a snapshot that one table is meant for, and rows of an owner that meet in one task.
BUCKET_ROWS, GROUP_ROWS = 2048, 1 << 17
#: Rows that a task packs at a time.
LOCAL_ROWS = 1 << 18
#: After this many rounds a bucket has more cells than rows can fill; what is left then is compared row by row.
ROUNDS = 6
#: Salts that set the check, digest and state hashes apart from those of the cells.
CHECK, DIGEST, STATE, TWIN = -1, -1000, -2000, -3000

# Fixed values of the public XXH64 function.
XXH64_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


@dataclass(frozen=True)
class Entity:
    """A kind of entity in a snapshot: the column that names it, and the columns whose values are compared."""

    kind: str
    rows: DataFrame
    name: Column
    compared: Sequence[str]


def _rows(listed: DataFrame, kinds: Sequence[Entity], owner: str, number: str, group_rows: int) -> DataFrame:
    """(h, owner, bucket, kind, id, kh, state, no) of every row; ``kind`` -1 are the listed numbers, once for each bucket."""
    parts = []
    for k, e in enumerate(kinds):
        state = F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in e.compared])
        parts.append(e.rows.select(F.col(owner).alias("owner"), F.col(number).cast("long").alias("no"), F.lit(k).alias("kind"), e.name.cast("string").alias("id"), state.alias("state")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where(F.col("owner").isNotNull() & F.col("no").isNotNull() & F.col("id").isNotNull()).withColumn("kh", F.xxhash64("kind", "id"))
    sizes = rows.groupBy("owner").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("buckets"))
    sizes = small(cut(sizes))
    rows = rows.join(sizes, "owner").withColumn("bucket", F.pmod("kh", "buckets").cast("int"))
    none = F.lit(None)
    numbers = listed.select(F.col(owner).alias("owner"), F.col(number).cast("long").alias("no")).where(F.col("owner").isNotNull() & F.col("no").isNotNull())
    # An owner without any row has no changes.
    numbers = numbers.join(sizes, "owner").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    numbers = numbers.select("owner", "no", F.lit(-1).alias("kind"), none.cast("string").alias("id"), none.cast("long").alias("kh"), none.cast("long").alias("state"), "bucket")
    both = rows.select(*numbers.columns).unionByName(numbers)
    return both.select(F.xxhash64("owner", "bucket").alias("h"), "owner", "bucket", "kind", "id", F.coalesce("kh", F.lit(0)).alias("kh"), F.coalesce("state", F.lit(0)).alias("state"), "no")


def _hash(a: str, b: str, salt: int) -> Column:
    return F.xxhash64(a, b, F.lit(salt).cast("long"))


def _hash_np(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The same as _hash, of 64-bit arrays: the public XXH64 function of eight bytes, each value seeding the next."""

    def rotl(x, r):
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    p1, p2, p3, p4, p5 = map(np.uint64, XXH64_PRIMES)
    h = np.full(len(a), 42, np.uint64)
    with np.errstate(over="ignore"):
        for x in (a.view(np.uint64), b.view(np.uint64), np.full(len(a), salt, np.int64).view(np.uint64)):
            h = h + p5 + np.uint64(8)
            h = rotl(h ^ (rotl(x * p2, 31) * p1), 27) * p1 + p4
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def peel(group: np.ndarray, cell: np.ndarray, n, kx, vx, cx, digest: np.ndarray, cells: int, seed: int):
    """Peels many tables at once. ``group`` numbers them from 0; the other arrays are the contents of their nonempty cells,
    and the difference of the digests of each table's two sides.

    Returns (group, key hash, row hash, sign) of the entries recovered and, per group, whether its table came out empty
    and its digest is that of the recovered entries.
    """
    digest = digest.copy()
    width = HASHES * cells
    address = group * width + cell
    order = np.argsort(address)
    address = address[order]
    n, kx, vx, cx = (x[order].copy() for x in (n, kx, vx, cx))
    out: list[tuple[np.ndarray, ...]] = []
    live = np.arange(len(address))
    while len(live):
        single = live[np.abs(n[live]) == 1]
        single = single[_hash_np(vx[single], kx[single], CHECK - seed) == cx[single]]
        if not len(single):
            break
        g, k, v, sign = address[single] // width, kx[single], vx[single], n[single]
        # An entry may be alone in more than one cell: it is taken once.
        first = np.lexsort((v, k, g))
        new = np.ones(len(first), bool)
        new[1:] = (g[first][1:] != g[first][:-1]) | (k[first][1:] != k[first][:-1]) | (v[first][1:] != v[first][:-1])
        g, k, v, sign = (x[first[new]] for x in (g, k, v, sign))
        check = _hash_np(v, k, CHECK - seed)
        touched = []
        for i in range(HASHES):
            to = g * width + np.mod(_hash_np(k, v, seed * HASHES + i), cells) + i * cells
            at = np.minimum(np.searchsorted(address, to), len(address) - 1)
            hit = address[at] == to  # else the check hash has matched by chance; the digest tells
            at = at[hit]
            np.subtract.at(n, at, sign[hit])
            for x, y in ((kx, k), (vx, v), (cx, check)):
                np.bitwise_xor.at(x, at, y[hit])
            touched.append(at)
        np.bitwise_xor.at(digest, g, _hash_np(k, v, DIGEST))
        out.append((g, k, v, sign))
        live = np.unique(np.concatenate(touched))
        if len(out) > 10_000:
            break
    ok = digest == 0
    left = (n != 0) | (kx != 0) | (vx != 0) | (cx != 0)
    ok[np.unique(address[left] // width)] = False
    found = tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, np.int64) for _ in range(4))
    return found, ok


def _changed(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns differs from the row before; true on the first row."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return new


def _lists(values: np.ndarray | pa.Array, starts: np.ndarray, n: int) -> pa.ListArray:
    """Lists of successive values, each starting where one of the ``starts`` is."""
    ends = np.append(starts, n).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values))


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


_PACKED = "h long, owner {owner}, bucket int, id array<string>, kind array<int>, kh array<long>, entity array<int>, state array<long>, pair array<int>, no array<long>, listed array<long>"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task packed per owner and bucket: entities, their distinct states, and the snapshots of each state."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        held.clear()
        own, ids = codes(t.column("owner")), codes(t.column("id"))
        bucket, kind, state, no = (t.column(c).to_numpy() for c in ("bucket", "kind", "state", "no"))
        order = np.lexsort((no, state, ids, kind, bucket, own))
        o, b, k, i, s, n = (x[order] for x in (own, bucket, kind, ids, state, no))
        keep = _changed(o, b, k, i, s, n)
        order, o, b, k, i, s, n = (x[keep] for x in (order, o, b, k, i, s, n))
        group = _changed(o, b)
        # The listed numbers come first in each group.
        starts, real = np.flatnonzero(group), k >= 0
        of = np.cumsum(group) - 1
        entity, pair = _changed(of, k, i) & real, _changed(of, k, i, s) & real
        count = lambda mask: np.cumsum(mask) - mask
        at = lambda mask: count(mask)[starts]
        e, p = np.cumsum(entity) - 1, np.cumsum(pair) - 1
        within = lambda number, mask, rows: (number - np.repeat(at(mask), np.diff(np.append(starts, len(o)))))[rows].astype(np.int32)
        rows = pa.array(order[starts])
        return pa.RecordBatch.from_arrays(
            [
                _flat(t.column("h").take(rows)),
                _flat(t.column("owner").take(rows)),
                _flat(t.column("bucket").take(rows)),
                _lists(_flat(t.column("id").take(pa.array(order[entity]))), at(entity), int(entity.sum())),
                _lists(k[entity].astype(np.int32), at(entity), int(entity.sum())),
                _lists(_flat(t.column("kh").take(pa.array(order[entity]))), at(entity), int(entity.sum())),
                _lists(within(e, entity, pair), at(pair), int(pair.sum())),
                _lists(s[pair], at(pair), int(pair.sum())),
                _lists(within(p, pair, real), at(real), int(real.sum())),
                _lists(n[real], at(real), int(real.sum())),
                _lists(n[~real], at(~real), int((~real).sum())),
            ],
            names=["h", "owner", "bucket", "id", "kind", "kh", "entity", "state", "pair", "no", "listed"],
        )

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= LOCAL_ROWS:
            yield flush()
    if sum(x.num_rows for x in held):
        yield flush()


class _Bucket:
    """All snapshots of some owners' buckets: their distinct entity rows, and the listed numbers.

    ``kh`` tells the entities of a group apart for certain: those whose hashes coincide are given others.
    """

    def __init__(self, t: pa.Table):
        lists = {c: _flat(t.column(c)) for c in ("id", "kind", "kh", "entity", "state", "pair", "no", "listed")}
        sizes = {c: np.diff(x.offsets.to_numpy()) for c, x in lists.items()}
        flat = {c: x.flatten() for c, x in lists.items()}
        value = {c: flat[c].to_numpy(zero_copy_only=False) for c in ("kind", "kh", "entity", "state", "pair", "no", "listed")}
        part = codes(t.column("owner")).astype(np.int64) * (1 << 32) + t.column("bucket").to_numpy()
        _, self.part, group = np.unique(part, return_index=True, return_inverse=True)
        of = lambda c: np.repeat(np.arange(len(group)), sizes[c])
        first = lambda c: (np.cumsum(sizes[c]) - sizes[c])

        # One number for each entity of a group, whichever task it came from.
        g, ids = group[of("id")], codes(flat["id"])
        order = np.lexsort((ids, value["kind"], g))
        new = _changed(g[order], value["kind"][order], ids[order])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        at = order[new]
        self.id, self.kind, self.group, self.kh = flat["id"].take(pa.array(at)), value["kind"][at], g[at], value["kh"][at].copy()
        while True:
            order = np.lexsort((self.kh, self.group))
            twins = order[1:][(self.kh[order][1:] == self.kh[order][:-1]) & (self.group[order][1:] == self.group[order][:-1])]
            if not len(twins):
                break
            self.kh[twins] = _hash_np(self.kh[twins], twins, TWIN)
        self.by_key = order

        # The listed snapshots of each group, in order.
        g, no = group[of("listed")], value["listed"]
        order = np.lexsort((no, g))
        new = _changed(g[order], no[order])
        self.snap_group, self.snap_no = g[order][new], no[order][new]

        # Distinct rows of listed snapshots, the states of one entity in one snapshot being one.
        pair = first("state")[of("pair")] + value["pair"]
        entity = number[(first("id")[of("state")] + value["entity"])[pair]]
        state, no = value["state"][pair], value["no"]
        snap = self._snapshot(self.group[entity], no)
        order = np.lexsort((state, entity, snap))
        order = order[snap[order] >= 0]
        snap, entity, state = snap[order], entity[order], state[order]
        keep = _changed(snap, entity, state)
        snap, entity, state = snap[keep], entity[keep], state[keep]
        new = _changed(snap, entity)
        starts = np.flatnonzero(new)
        n = np.diff(np.append(starts, len(snap)))
        vh = _hash_np(state[starts], np.zeros(len(starts), np.int64), STATE)
        for j in range(1, int(n.max(initial=1))):
            more = np.flatnonzero(n > j)
            vh[more] = _hash_np(vh[more], state[starts[more] + j], STATE)
        self.snap, self.entity, self.vh = snap[starts], entity[starts], vh

    def _snapshot(self, group: np.ndarray, no: np.ndarray) -> np.ndarray:
        """The place of each (group, number) among the listed ones, -1 if it isn't."""
        if not len(self.snap_no):
            return np.full(len(no), -1)
        numbers, code = np.unique(np.concatenate([self.snap_no, no]), return_inverse=True)
        wide = len(numbers)
        have, want = self.snap_group * wide + code[: len(self.snap_no)], group * wide + code[len(self.snap_no) :]
        at = np.minimum(np.searchsorted(have, want), len(have) - 1)
        return np.where(have[at] == want, at, -1)


def _cells(kh: np.ndarray, vh: np.ndarray, table: np.ndarray, sign: np.ndarray, tables: int, cells: int, seed: int) -> list[np.ndarray]:
    """[count, key, row and check sums of every cell, digests of every table] of entries put into tables."""
    width = HASHES * cells
    n, kx, vx, cx = (np.zeros(tables * width, np.int64) for _ in range(4))
    check = _hash_np(vh, kh, CHECK - seed)
    for i in range(HASHES):
        at = table * width + np.mod(_hash_np(kh, vh, seed * HASHES + i), cells) + i * cells
        np.add.at(n, at, sign)
        for x, y in ((kx, kh), (vx, vh), (cx, check)):
            np.bitwise_xor.at(x, at, y)
    digest = np.zeros(tables, np.int64)
    np.bitwise_xor.at(digest, table, _hash_np(kh, vh, DIGEST))
    return [n, kx, vx, cx, digest]


def _peeled(sums: list[np.ndarray], tables: int, cells: int, seed: int):
    n, kx, vx, cx, digest = sums
    at = np.flatnonzero((n != 0) | (kx != 0) | (vx != 0) | (cx != 0))
    width = HASHES * cells
    return peel(at // width, at % width, n[at], kx[at], vx[at], cx[at], digest, cells, seed)


def _differences(b: _Bucket, bucket_rows: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(snapshot, key hash, sign) of every entry that a listed snapshot has and its predecessor has not, or the other way round."""
    kh = b.kh[b.entity]
    groups = int(b.snap_group.max()) + 1
    # Tables per snapshot, by its group's fullest one; a snapshot's tables lie side by side, then come its successor's.
    most = np.zeros(groups, np.int64)
    np.maximum.at(most, b.snap_group, np.bincount(b.snap, minlength=len(b.snap_no)))
    subs = np.maximum(-(-most // bucket_rows), 1)
    first = np.cumsum(subs[b.snap_group]) - subs[b.snap_group]
    table = first[b.snap] + np.mod(_hash_np(kh, np.zeros(len(kh), np.int64), STATE), subs[b.snap_group[b.snap]])
    total = int(subs[b.snap_group].sum())
    n, kx, vx, cx, digest = _cells(kh, b.vh, table, np.ones(len(kh), np.int64), total, CELLS, 0)
    of_table = np.repeat(np.arange(len(b.snap_no)), subs[b.snap_group])
    follows = np.r_[False, b.snap_group[1:] == b.snap_group[:-1]]
    later = np.flatnonzero(follows[of_table])
    earlier = later - subs[b.snap_group[of_table[later]]]
    width = HASHES * CELLS
    apart = lambda x: (x.reshape(-1, width)[later] ^ x.reshape(-1, width)[earlier]).ravel()
    less = (n.reshape(-1, width)[later] - n.reshape(-1, width)[earlier]).ravel()
    (g, k, v, sign), ok = _peeled([less, apart(kx), apart(vx), apart(cx), digest[later] ^ digest[earlier]], len(later), CELLS, 0)
    out = [(of_table[later[g[ok[g]]]], k[ok[g]], sign[ok[g]])]

    order = np.argsort(table, kind="stable")
    ends = np.searchsorted(table[order], np.arange(total + 1))
    failed, cells = np.flatnonzero(~ok), CELLS
    for seed in range(1, rounds):
        if not len(failed):
            break
        cells *= GROW
        pair, row, sign = _sided(order, ends, later[failed], earlier[failed])
        (g, k, v, s), ok = _peeled(_cells(kh[row], b.vh[row], pair, sign, len(failed), cells, seed), len(failed), cells, seed)
        out.append((of_table[later[failed[g[ok[g]]]]], k[ok[g]], s[ok[g]]))
        failed = failed[~ok]
    if len(failed):
        pair, row, sign = _sided(order, ends, later[failed], earlier[failed])
        at = np.lexsort((b.vh[row], kh[row], pair))
        pair, row, sign = pair[at], row[at], sign[at]
        new = np.flatnonzero(_changed(pair, kh[row], b.vh[row]))
        left = np.add.reduceat(sign, new) if len(new) else sign
        new, left = new[left != 0], left[left != 0]
        out.append((of_table[later[failed[pair[new]]]], kh[row[new]], left))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def _sided(order: np.ndarray, ends: np.ndarray, later: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, row, sign) of the rows of both sides' tables."""
    parts = []
    for tables, sign in ((later, 1), (earlier, -1)):
        n = ends[tables + 1] - ends[tables]
        at = np.repeat(ends[tables] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        parts.append((np.repeat(np.arange(len(tables)), n), order[at], np.full(len(at), sign)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _compare(names: Sequence[str], bucket_rows: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["h"], 64):
            b = _Bucket(t)
            if not len(b.snap_no) or not len(b.entity):
                continue
            snap, kh, sign = _differences(b, bucket_rows, rounds)
            order = np.lexsort((sign, kh, snap))
            snap, kh, sign = snap[order], kh[order], sign[order]
            starts = np.flatnonzero(_changed(snap, kh))
            n = np.diff(np.append(starts, len(snap)))
            low, high = sign[starts], sign[starts + n - 1] if len(starts) else sign[starts]
            what = np.where(low > 0, 0, np.where(high < 0, 1, 2))
            snap, kh = snap[starts], kh[starts]
            entity = _lookup(b, b.snap_group[snap], kh)
            columns = [
                _flat(t.column("owner").take(pa.array(b.part[b.snap_group[snap]]))),
                pa.array(b.snap_no[snap]),
                pa.array(np.array(names, object)[b.kind[entity]], pa.string()),
                b.id.take(pa.array(entity)),
                pa.array(np.array(["added", "removed", "changed"], object)[what], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["owner", "no", "entity_kind", "entity_id", "change_kind"])

    return run


def _lookup(b: _Bucket, group: np.ndarray, kh: np.ndarray) -> np.ndarray:
    """The entity of each (group, key hash)."""
    keys, code = np.unique(np.concatenate([b.kh, kh]), return_inverse=True)
    have, want = b.group * len(keys) + code[: len(b.kh)], group * len(keys) + code[len(b.kh) :]
    return b.by_key[np.searchsorted(have[b.by_key], want)]


def snapshot_changes(
    listed: DataFrame, kinds: Sequence[Entity], owner: str, number: str, bucket_rows: int = BUCKET_ROWS, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(owner, number, entity_kind, entity_id, change_kind) between each snapshot and the next lower one of its owner.

    ``listed`` names the snapshots; rows of others don't count, and a listed snapshot without rows of a kind has none of
    that kind. ``change_kind`` is ``added``, ``removed`` or ``changed`` (a compared column differs; null equals only null).
    Compared columns are compared by a 64-bit hash: a change is missed if both states have the same one, with a chance of
    2^-64 for each; entities are told apart for certain. Defined results: repeated deliveries and rows count once; rows of one
    entity that differ within a snapshot are one state, whatever their order; the first snapshot of an owner has no
    changes; rows without owner, number or entity name belong to nothing; empty tables give no rows; columns not named are ignored.
    """
    kind = listed.schema[owner].dataType.simpleString()
    packed = _rows(listed, kinds, owner, number, group_rows).mapInArrow(_pack, _PACKED.format(owner=kind))
    met = packed.repartition("h").sortWithinPartitions("h")
    found = met.mapInArrow(_compare([k.kind for k in kinds], bucket_rows, ROUNDS), f"owner {kind}, no long, entity_kind string, entity_id string, change_kind string")
    return found.select(F.col("owner").alias(owner), F.col("no").alias(number), "entity_kind", "entity_id", "change_kind")
