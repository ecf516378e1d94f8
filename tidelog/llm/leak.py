"""Passages of held-out items in a corpus, found with a distributed positional inverted index.

The index is sharded by document, as search engines do it: a shard is a bounded run of documents with, for each term, the list
of its places, stored as one row of a table. Only words that occur in some item are posted. How frequent a term is in the
whole corpus is the sum over all shards. Every window of an item's words is looked up from its rarest term: the places in
that term's list, less the term's place in the item, are the diagonals on which the passage may lie. These are
intersected with the lists of the neighbouring terms at their own offsets, one after the other, until a window is whole.
Shards know all about their documents, so nothing but term counts and results is ever shuffled.

For near passages a window is cut into one segment more than words may differ: one of them must then be whole, is
found as above, and the window around it is aligned with the document's words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.runtime import cut, remove, shared_dir, spread

#: Maximal runs of letters and digits.
_WORDS = re.compile(r"[^\W_]+").findall
_APART = re.compile(r"[\W_]")
#: Words and documents of a shard (a longer document is one by itself), and characters of a text that are split at a time.
SHARD_WORDS, SHARD_DOCS, SLICE = 1 << 18, 4096, 1 << 22
#: Words of the items that are looked up together; further ones are another block with an index of its own.
BLOCK_WORDS = 1 << 20
#: Candidates that are looked at together.
CANDIDATES = 1 << 20
#: Documents and items are set apart by more than any window can reach over.
_SLACK = 16


def words(text: str | None) -> Iterator[list[str]]:
    """The words of a text in lower case, in lists of a bounded stretch of it each."""
    text, at = (text or "").lower(), 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            m = _APART.search(text, end)
            end = m.start() if m else len(text)
        yield _WORDS(text[at:end])
        at = end


class _Shard:
    """Postings of documents, in one space of places; between two documents there is a gap."""

    def __init__(self, gap: int):
        self.gap, self.ids, self.starts, self.terms, self.places, self.end, self.size = gap, [], [], [], [], gap, 0

    def add(self, doc: pa.Scalar, text: str | None, known: dict[str, int]) -> None:
        self.ids.append(doc)
        self.starts.append(self.end)
        for ws in words(text):
            terms = np.fromiter(map(known.get, ws, repeat(-1)), np.int32, len(ws))
            hit = np.flatnonzero(terms >= 0)
            self.terms.append(terms[hit])
            self.places.append((hit + self.end).astype(np.int32))
            self.end += len(ws)
            self.size += len(ws)
        self.end += self.gap

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        terms = np.concatenate([np.empty(0, np.int32), *self.terms])
        places = np.concatenate([np.empty(0, np.int32), *self.places])
        order = np.argsort(terms, kind="stable")
        distinct, counts = np.unique(terms, return_counts=True)
        lists = (pa.array(self.ids, kind), self.starts, distinct, counts.astype(np.int32), places[order])
        cols = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, pa.int32())) for x in lists]
        return pa.RecordBatch.from_arrays([*cols, pa.array([self.end], pa.int32())], names=["ids", "starts", "terms", "counts", "places", "size"])


def build_index(docs: DataFrame, doc_id: str, text: str, vocabulary: list[str], gap: int, path: str) -> DataFrame:
    """Stores the postings of a vocabulary under ``path``, one row per shard, and returns what is stored."""
    spark = docs.sparkSession
    rows = spread(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    kind, arrow = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    given = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: k for k, w in enumerate(given.value)}
        shard = _Shard(gap)
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard.add(doc, t.as_py(), known)
                if shard.size >= SHARD_WORDS or len(shard.ids) >= SHARD_DOCS:
                    yield shard.row(arrow)
                    shard = _Shard(gap)
        if shard.ids:
            yield shard.row(arrow)

    schema = f"ids array<{kind}>, starts array<int>, terms array<int>, counts array<int>, places array<int>, size int"
    rows.mapInArrow(run, schema).write.parquet(path)
    return spark.read.parquet(path)


@dataclass
class _Plan:
    """What is looked up of a block of items: their terms in one space of places, and where lookups start."""

    terms: np.ndarray  # by place; -2 between items
    item: np.ndarray  # by place; the item's number
    first: np.ndarray  # by place; where the item starts
    last: np.ndarray  # by place; where it ends
    anchors: np.ndarray  # places, in order of their terms
    need: np.ndarray  # words in a row that each anchor asks for
    whole: np.ndarray  # whether that is all that is asked for
    length: int
    edits: int


def _rarest(frequency: np.ndarray, size: int) -> np.ndarray:
    """Places of the rarest term of each window of ``size`` places, for windows all of whose terms occur."""
    if len(frequency) < size:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(frequency, size)
    place = windows.argmin(axis=1)
    some = windows[np.arange(len(windows)), place] > 0
    return np.unique(np.flatnonzero(some) + place[some])


def _plan(items: list[list[int]], frequency: np.ndarray, length: int, edits: int, short: bool) -> _Plan:
    gap = length + _SLACK
    size = sum(len(x) + gap for x in items) + gap
    terms, item, first, last = np.full(size, -2, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64)
    at, anchors, need, whole = gap, [], [], []
    for k, x in enumerate(items):
        end = at + len(x)
        terms[at:end], item[at:end], first[at:end], last[at:end] = x, k, at, end
        if len(x) >= length or short:
            run = length // (edits + 1) if len(x) >= length else len(x)
            found = _rarest(frequency[terms[at:end]], run) + at
            anchors.append(found)
            need.append(np.full(len(found), run, np.int32))
            whole.append(np.full(len(found), edits == 0 or len(x) < length))
        at = end + gap
    none = np.empty(0, np.int64)
    anchors = np.concatenate([none, *anchors])
    order = np.argsort(terms[anchors], kind="stable")
    return _Plan(terms, item, first, last, anchors[order], np.concatenate([none, *need])[order], np.concatenate([none.astype(bool), *whole])[order], length, edits)


def _extent(tokens: np.ndarray, plan: _Plan, at: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """How many neighbours on one side of each candidate are in place too; lists are only read where all before them agreed."""
    out = np.zeros(len(at), np.int32)
    live = np.arange(len(at))
    for j in range(1, int(plan.need.max())):
        live = live[tokens[at[live] + j * step] == plan.terms[place[live] + j * step]]
        if not len(live):
            break
        out[live] = j
    return out


def _aligned(tokens: np.ndarray, plan: _Plan, start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fewest words replaced, missing or added between each window from ``start`` on and the document's words around ``at``."""
    e = plan.edits
    band = np.arange(-e, e + 1)
    cost = np.zeros((len(start), 2 * e + 1), np.int16)  # a passage may start anywhere
    for i in range(plan.length):
        nearby = tokens[at[:, None] + i + band]
        new = cost + (nearby != plan.terms[start + i][:, None])
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        for k in range(1, 2 * e + 1):
            np.minimum(new[:, k], new[:, k - 1] + 1, out=new[:, k])
        cost = new
    return cost.min(axis=1)


def _near(tokens: np.ndarray, plan: _Plan, at: np.ndarray, place: np.ndarray, left: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a place of the item, a place in the shard, words that agree) of the windows around runs that are near enough."""
    size = plan.length // (plan.edits + 1)
    n = run - size + 1  # segments in the run
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    segment, diagonal = np.repeat(place - left, n) + offset, np.repeat(at - place, n)
    out = []
    keys = []
    for k in range(plan.edits + 1):
        start = segment - k * size
        inside = (start >= plan.first[segment]) & (start + plan.length <= plan.last[segment])
        keys.append((start[inside] << 32) + (diagonal[inside] + (1 << 31)))
    keys = np.unique(np.concatenate(keys))
    for k in range(0, len(keys), CANDIDATES):
        start, diagonal = keys[k : k + CANDIDATES] >> 32, (keys[k : k + CANDIDATES] & ((1 << 32) - 1)) - (1 << 31)
        cost = _aligned(tokens, plan, start, start + diagonal)
        good = np.flatnonzero(cost <= plan.edits)
        # One place of the window is in the document for certain: the middle, as edits and gaps are few.
        middle = start[good] + plan.length // 2
        out.append((middle, middle + diagonal[good], plan.length - cost[good]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _search(shard: dict, plan: _Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of the shard, item, words that agree) of a shard's passages, the best of each pair."""
    terms, counts, places, starts = (shard[c] for c in ("terms", "counts", "places", "starts"))
    none = np.empty(0, np.int64)
    if not len(terms) or not len(plan.anchors):
        return none, none, none
    tokens = np.full(shard["size"] + 2 * _SLACK + 2 * plan.length, -1, np.int32)
    tokens[places] = np.repeat(terms, counts)
    begin = np.cumsum(counts) - counts
    wanted = plan.terms[plan.anchors]
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == wanted)
    n, begin = counts[at[hit]].astype(np.int64), begin[at[hit]]
    upto = np.cumsum(n)
    out: list[tuple[np.ndarray, ...]] = []
    a = 0
    while a < len(hit):
        b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CANDIDATES, side="right")), a + 1)
        for c in range(0, int(n[a:b].max()) if b == a + 1 else 1, CANDIDATES):  # one list may be longer than that
            m = np.minimum(n[a:b] - c, CANDIDATES) if b == a + 1 else n[a:b]
            j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + c
            anchor = np.repeat(hit[a:b], m)
            place, pos = plan.anchors[anchor], places[np.repeat(begin[a:b], m) + j].astype(np.int64)
            right = _extent(tokens, plan, pos, place, 1)
            left = _extent(tokens, plan, pos, place, -1)
            run, need, whole = left + right + 1, plan.need[anchor], plan.whole[anchor]
            good = np.flatnonzero((run >= need) & whole)
            out.append((place[good], pos[good], need[good]))
            good = np.flatnonzero((run >= need) & ~whole)
            if len(good):
                out.append(_near(tokens, plan, pos[good], place[good], left[good], run[good]))
        a = b
    place, pos, agree = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (none, none, none)
    doc, item = np.searchsorted(starts, pos, side="right") - 1, plan.item[place].astype(np.int64)
    order = np.lexsort((-agree, item, doc))
    doc, item, agree = doc[order], item[order], agree[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[new], item[new], agree[new]


def _blocks(items: DataFrame, length: int) -> Iterator[tuple[list, list[list[str]]]]:
    """Ids and words of the items, a bounded number of words at a time; a longer item comes in pieces that overlap by a window."""
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        ws = [w for part in words(row["prompt"]) for w in part]
        for k in range(0, max(len(ws), 1), BLOCK_WORDS):
            piece = ws[max(k - length + 1, 0) : k + BLOCK_WORDS]
            if not piece:
                continue
            ids.append(row["id"])
            texts.append(piece)
            size += len(piece)
            if size >= BLOCK_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _looked_up(
    docs: DataFrame, doc_id: str, text: str, known: dict[str, int], items: list[list[int]], ids: list, schema: str, item_type: pa.DataType, asked: tuple[int, int, bool]
) -> DataFrame:
    """(doc, item, n_terms) of a block of items. Its index is removed in any case; the result is stored."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    try:
        index = build_index(docs, doc_id, text, list(known), asked[0] + _SLACK, path)
        counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n"))
        frequency = np.zeros(len(known), np.int64)
        for r in counts.toLocalIterator():  # as many as the block has distinct words
            frequency[r["terms"]] = r["n"]
        plan = spark.sparkContext.broadcast((_plan(items, frequency, *asked), ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            looked_for, item_ids = plan.value
            item_ids = pa.array(item_ids, item_type)
            for b in batches:
                for k in range(b.num_rows):
                    shard = {c: b.column(c)[k].values.to_numpy() for c in ("starts", "terms", "counts", "places")} | {"size": b.column("size")[k].as_py()}
                    doc, item, agree = _search(shard, looked_for)
                    columns = [b.column("ids")[k].values.take(pa.array(doc)), item_ids.take(pa.array(item)), pa.array(agree.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "item", "n_terms"])

        return cut(index.mapInArrow(run, schema).groupBy("doc", "item").agg(F.max("n_terms").alias("n_terms")))
    finally:
        remove(spark, path)


def passages(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, prompt: str, length: int, edits: int, short: bool
) -> DataFrame:
    """(doc_id, item_id, n_terms): passages of ``length`` words of an item with at most ``edits`` of them different."""
    spark = docs.sparkSession
    given = items.where(F.col(item_id).isNotNull() & F.col(prompt).isNotNull()).select(F.col(item_id).alias("id"), F.col(prompt).alias("prompt")).distinct()
    doc_type, item_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    schema = f"doc {doc_type.simpleString()}, item {item_type.simpleString()}, n_terms int"
    item_arrow = to_arrow_type(item_type)
    found: list[DataFrame] = []
    for ids, texts in _blocks(given, length):
        known: dict[str, int] = {}
        numbered = [[known.setdefault(w, len(known)) for w in ws] for ws in texts]
        found.append(_looked_up(docs, doc_id, text, known, numbered, ids, schema, item_arrow, (length, edits, short)))
    out = spark.createDataFrame([], schema) if not found else found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if len(found) > 1:
        out = out.groupBy("doc", "item").agg(F.max("n_terms").alias("n_terms"))
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "n_terms")


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", prompt: str = "prompt", length: int = 12, short: bool = False
) -> DataFrame:
    """(doc_id, item_id): the text contains ``length`` consecutive words of the item in their order.

    Words are maximal runs of letters and digits, compared in lower case. With ``short`` an item of fewer words is found
    where the text contains all of it; without, it has no passage that long and matches nothing. Defined results: null or
    empty texts and items, and rows without an id match nothing; repeated rows give one result row; of an id with
    several texts each text counts by itself; empty tables give no rows; further columns are ignored.
    """
    return passages(docs, items, doc_id, text, item_id, prompt, length, 0, short).select(doc_id, item_id)


def near_passages(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", prompt: str = "prompt", length: int = 12, least: int = 10
) -> DataFrame:
    """(doc_id, item_id, n_terms): the text has a passage that is a window of ``length`` words of the item but for a few words.

    At most ``length - least`` words in all are replaced, missing or added between; ``n_terms`` is ``length`` less the fewest
    such changes of any window. An item with fewer than ``length`` words must be there whole, and has ``n_terms`` words. All
    such passages are found: a window with that few changes has a segment without any. Otherwise as leaked_passages.
    """
    return passages(docs, items, doc_id, text, item_id, prompt, length, length - least, True)
