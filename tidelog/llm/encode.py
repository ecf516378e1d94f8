"""Encoding of texts with a byte-level BPE vocabulary, the merges done by recursive queries in DuckDB.

Each task splits its texts into words. Of the words it hasn't met before, every byte becomes a row (word, position,
token). A recursive query joins neighbouring rows with the merge table and contracts, in every word at once, the pair of
lowest rank, from the left, until no word has a pair left; ordered aggregation then gives the ids of each word. A text's
ids are those of its words in order. The vocabulary file's path is a parameter.

A long word is cut into pieces, which are merged by the same query, and mended where they meet. That is exact: a sequence of
tokens is a word's encoding if and only if every two neighbours of it are the encoding of their own bytes. (Merges within
tokens happen in the same order whatever stands beside them; the first one across a boundary would happen in the two neighbours
alone as well.) So if a stretch around the place where two pieces meet is merged anew, and begins and ends with the tokens
that were there, all neighbours are right; else a longer stretch is. The work grows with a word's length only.

Decoding puts the bytes of each text's ids together in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.runtime import spread

#: Splits a text into words before the merges (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a Python worker remembers; then it starts afresh.
REMEMBERED = 400_000
#: Sum of squared lengths of the words in one recursive query, whose rows of all steps are in memory together.
QUERY_SIZE = 3_000_000
#: Bytes of the pieces of a long word, and tokens on either side of a place where pieces meet that are merged anew at first.
PIECE, MENDED = 32, 3
#: Bytes from which such a stretch is merged step by step, so that only its latest state is kept. Stretches only grow that
#: long where a word repeats itself, which takes few steps.
LONG_STRETCH = 2_048

# One contraction of every word in {rows}: pairs of neighbours, their ranks, the word's lowest rank. Occurrences of the
# pair that touch ("aaaa") are taken alternately from the left. Words without a pair to merge give no rows.
_STEP = """
SELECT {step} w, p, CASE WHEN take THEN merged ELSE t END AS t FROM (
  SELECT *, lag(take, 1, false) OVER (PARTITION BY w ORDER BY p) AS gone FROM (
    SELECT *, hit AND (i - max(CASE WHEN hit THEN 0 ELSE i END) OVER (PARTITION BY w ORDER BY p)) % 2 = 1 AS take FROM (
      SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY w), false) AS hit, min(rank) OVER (PARTITION BY w) AS lowest FROM (
        SELECT {carry} x.w, x.p, x.t, x.i, m.rank, m.merged
        FROM (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY p) AS t2, row_number() OVER (PARTITION BY w ORDER BY p) AS i FROM {rows}) x
        LEFT JOIN merges m ON m.a = x.t AND m.b = x.t2))
    WHERE lowest IS NOT NULL))
WHERE NOT gone"""

_RECURSIVE = f"""
WITH RECURSIVE r AS (
  SELECT 0 AS step, w, p, t FROM bytes
  UNION ALL
  {_STEP.format(step="step + 1 AS step,", carry="x.step,", rows="r")})
SELECT w, list(t ORDER BY p) AS ids FROM r SEMI JOIN (SELECT w, max(step) AS step FROM r GROUP BY w) USING (w, step) GROUP BY w ORDER BY w"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, the others from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Ids of words, remembered per Python worker."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for letters, k in vocab.items():
            self.lengths[k] = len(letters)  # a letter stands for a byte
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = pa.table(
            {
                "a": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
                "b": pa.array([vocab[b] for _, b in pairs], pa.int32()),
                "rank": pa.array(range(len(pairs)), pa.int32()),
                "merged": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
            }
        )
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1; SET memory_limit = '600MB'")
        self.con.register("given_merges", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given_merges")
        self.split = regex.compile(PATTERN).findall
        self.ids: dict[str, np.ndarray] = {}

    def _byte_rows(self, words: list[bytes]) -> pa.Table:
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        return pa.table(
            {
                "w": pa.array(word.astype(np.int32)),
                "p": pa.array((np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int32)),
                "t": pa.array(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]),
            }
        )

    def _recursive(self, words: list[bytes]) -> list[np.ndarray]:
        self.con.register("given_bytes", self._byte_rows(words))
        self.con.execute("CREATE OR REPLACE TEMP TABLE bytes AS SELECT * FROM given_bytes")
        found = self.con.sql(_RECURSIVE).to_arrow_table()["ids"].combine_chunks()
        return np.split(found.values.to_numpy(), found.offsets.to_numpy()[1:-1])

    def _stepwise(self, word: bytes) -> np.ndarray:
        self.con.register("given_bytes", self._byte_rows([word]))
        self.con.execute("CREATE OR REPLACE TEMP TABLE state AS SELECT * FROM given_bytes")
        while True:
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE next AS {_STEP.format(step='', carry='', rows='state')}")
            if not self.con.execute("SELECT count(*) FROM next").fetchone()[0]:
                return self.con.execute("SELECT t FROM state ORDER BY p").fetchnumpy()["t"]
            self.con.execute("CREATE OR REPLACE TEMP TABLE state AS SELECT * FROM next")

    def _merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of bounded length, in queries of bounded size."""
        out: list[np.ndarray] = []
        part: list[bytes] = []
        size = 0
        for w in [*words, None]:
            if part and (w is None or size > QUERY_SIZE or len(w) > LONG_STRETCH):
                out += self._recursive(part)
                part, size = [], 0
            if w is not None and len(w) > LONG_STRETCH:
                out.append(self._stepwise(w))
            elif w is not None:
                part.append(w)
                size += len(w) ** 2
        return out

    def _mended(self, word: bytes) -> np.ndarray:
        """Ids of a long word, from those of its pieces."""
        pieces = [word[k : k + PIECE] for k in range(0, len(word), PIECE)]
        ids = np.concatenate(self._merged(pieces))
        ends = np.cumsum(self.lengths[ids])
        open_ = [(k * PIECE, MENDED) for k in range(1, len(pieces))]  # where pieces meet, and tokens to either side
        while open_:
            meet = np.searchsorted(ends, [p for p, _ in open_]) + 1
            stretches: list[list] = []  # from, to, where pieces meet in it
            for at, (place, reach) in zip(meet, open_, strict=True):
                a, b = max(int(at) - reach, 0), min(int(at) + reach, len(ids))
                if stretches and a <= stretches[-1][1]:
                    stretches[-1][1] = max(stretches[-1][1], b)
                    stretches[-1][2].append((place, reach))
                else:
                    stretches.append([a, b, [(place, reach)]])
            starts = np.append(0, ends)
            new = self._merged([word[starts[a] : starts[b]] for a, b, _ in stretches])
            out, upto, open_ = [], 0, []
            for (a, b, places), found in zip(stretches, new, strict=True):
                fits = (a == 0 or found[0] == ids[a]) and (b == len(ids) or found[-1] == ids[b - 1])
                out += [ids[upto:a], found if fits else ids[a:b]]
                upto = b
                if not fits:
                    open_ += [(place, 2 * reach) for place, reach in places]
            ids = np.concatenate([*out, ids[upto:]])
            ends = np.cumsum(self.lengths[ids])
        return ids

    def learn(self, words: set[str]) -> None:
        """Encodes the words that aren't remembered."""
        new = sorted(words - self.ids.keys(), key=len)
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids.clear()
            new = sorted(words, key=len)
        given = [w.encode() for w in new]
        short = [k for k, w in enumerate(given) if len(w) <= 2 * PIECE]
        self.ids |= zip([new[k] for k in short], self._merged([given[k] for k in short]), strict=True)
        for k, w in enumerate(given):
            if len(w) > 2 * PIECE:
                self.ids[new[k]] = self._mended(w)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of each text; an empty list for an empty and for a null text."""
        words = [self.split(t) if t else [] for t in texts]
        self.learn({w for ws in words for w in ws})
        ids = [self.ids[w] for ws in words for w in ws]
        counts = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        per_text = np.add.reduceat(np.append(counts, 0), np.minimum(starts, len(counts))) if len(starts := np.cumsum([0, *map(len, words)])[:-1]) else counts
        per_text = np.where([len(ws) > 0 for ws in words], per_text, 0)
        offsets = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


_ENCODERS: dict[str, WordEncoder] = {}
#: Characters of text encoded at a time.
SLICE_CHARS = 1 << 22


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, WordEncoder(vocabulary))
        for b in batches:
            texts = b.column(1).to_pylist()
            start, chars = 0, 0
            for k, t in enumerate(texts):
                chars += len(t or "")
                if chars > SLICE_CHARS or k == len(texts) - 1:
                    part = b.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(texts[start : k + 1])], names=["id", "ids"])
                    start, chars = k + 1, 0

    return run


def encode_texts(df: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """(doc_id, ids): the token ids of each row's text by the byte-level BPE vocabulary file, without special tokens.

    The strings of special tokens are ordinary text. Defined results: an empty list for an empty and for a null text; one
    row out per row in, rows with equal or null ids included; whole texts, however long; an empty table gives no rows;
    further columns are ignored.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(_encode(vocabulary), f"id {kind}, ids array<int>").withColumnRenamed("id", doc_id)


class IdDecoder:
    """Texts of ids: the letters of each text's tokens, aggregated in order, then letters to bytes."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1; SET memory_limit = '600MB'")
        self.con.register("given", pa.table({"t": pa.array(list(vocab.values()), pa.int32()), "letters": pa.array(list(vocab))}))
        self.con.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self.bytes = {ord(c): b for b, c in enumerate(byte_letters())}

    def decode(self, ids: pa.ListArray) -> list[str | None]:
        flat, sizes = ids.flatten(), np.diff(ids.offsets.to_numpy())
        self.con.register("given_ids", pa.table({"d": pa.array(np.repeat(np.arange(len(ids)), sizes)), "p": pa.array(np.arange(len(flat))), "t": flat}))
        found = self.con.execute("SELECT d, string_agg(letters, '' ORDER BY p) AS x, count(*) AS n FROM given_ids JOIN tokens USING (t) GROUP BY d").fetchall()
        out: list[str | None] = [None if null else "" for null in ids.is_null().to_pylist()]
        for d, letters, n in found:
            if n != sizes[d]:
                raise ValueError("an id is not in the vocabulary")
            out[d] = bytes(map(self.bytes.__getitem__, map(ord, letters))).decode("utf-8", "replace")
        return out


_DECODERS: dict[str, IdDecoder] = {}


def decode_ids(df: DataFrame, doc_id: str, ids: str, vocabulary: str) -> DataFrame:
    """(doc_id, text): the text of each row's ids, which encode_texts gives back unchanged.

    Defined results: an empty text for an empty list, null for null; bytes that are no UTF-8 become the replacement
    character; an id or a null in a list that is not in the vocabulary is an error; one row out per row in.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _DECODERS.get(vocabulary) or _DECODERS.setdefault(vocabulary, IdDecoder(vocabulary))
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(decoder.decode(part.column(1)), pa.string())], names=["id", "text"])

    rows = df.select(F.col(doc_id).alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", doc_id)
