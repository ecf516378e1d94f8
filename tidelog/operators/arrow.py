"""Arrow batches of sorted partitions, cut between groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups of at least ``rows`` rows where there are so many. The rows come sorted by ``keys``, whole numbers.

    Every batch is copied once, however many of them a group extends over.
    """
    done: list[pa.RecordBatch] = []
    open_: list[pa.RecordBatch] = []
    held, key = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if key is not None and key != tuple(c[0] for c in columns):
            done, open_, held = done + open_, [], held + sum(x.num_rows for x in open_)
        key = tuple(c[-1] for c in columns)
        same = np.ones(b.num_rows, bool)
        for c in columns:
            same &= c == c[-1]
        start = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if start:
            done = [*done, *open_, b.slice(0, start)]
            held += sum(x.num_rows for x in open_) + start
            open_ = [b.slice(start)]
        else:
            open_.append(b)
        if held >= rows:
            yield pa.Table.from_batches(done)
            done, held = [], 0
    if done or open_:
        yield pa.Table.from_batches(done + open_)


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers that tell a column's values apart; null is a value of its own."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], flat.type)
    return flat.dictionary_encode(null_encoding="encode").indices.to_numpy()
