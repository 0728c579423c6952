"""Columns of texts as distinct words and their places (Arrow and numpy), so
that Python handles each distinct word of a batch once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], column: str, nbytes: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``nbytes`` of that string column
    (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, before + nbytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def distinct(lists: pa.ListArray) -> tuple[list, np.ndarray, np.ndarray]:
    """(distinct values, place of each value among them, offsets of the rows)."""
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]


def ragged(values: list[bytes], at: np.ndarray, item: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """(items of ``values[k]`` for every k of ``at`` in one line, ends of each k)."""
    line = np.frombuffer(b"".join(values), dtype=item)
    size = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // line.itemsize
    first = np.cumsum(size) - size
    taken = size[at]
    ends = np.cumsum(taken)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - (ends - taken), taken)
    return line[place], ends


def row_ends(ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the rows, from the ends of their values and the rows' offsets."""
    return np.concatenate([[0], ends])[offsets[1:]]


def as_one(at: np.ndarray, offsets: np.ndarray, rows: np.ndarray, value: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and offsets with each of the ascending ``rows`` turned into one
    value; these are numbered from ``value`` on."""
    if not len(rows):
        return at, offsets
    parts, sizes, done = [], np.diff(offsets), 0
    for n, k in enumerate(rows.tolist()):
        parts += [at[offsets[done] : offsets[k]], np.array([value + n], dtype=at.dtype)]
        sizes[k], done = 1, k + 1
    return np.concatenate([*parts, at[offsets[done] :]]), np.concatenate([[0], np.cumsum(sizes)])


def rows_with(marked: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold a marked value."""
    seen = np.concatenate([[0], np.cumsum(marked[at])])
    return np.flatnonzero(seen[offsets[1:]] > seen[offsets[:-1]])
