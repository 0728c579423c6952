"""Statistics of whole texts, computed once per text inside Arrow batches.

Words are runs of characters other than blank and \\t-\\r. A null text has
no words and counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paramforge.llm.common import WORD_SPACE

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct", "n_bytes", "longest_word"]


def repeat_words(codes: np.ndarray, distinct: int) -> int:
    """Positions inside 3-word windows that occur at least twice."""
    n = len(codes)
    if n < 4:
        return 0
    if distinct < 2_000_000:  # three codes fit one 64-bit key
        key = (codes[:-2] * distinct + codes[1:-1]) * distinct + codes[2:]
    else:
        pair = np.unique(codes[:-1] * distinct + codes[1:], return_inverse=True)[1]
        key = pair[:-1] * distinct + codes[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values named in ``STATS``, over the whole text."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    words = raw.split()
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.encode("utf-8", "surrogatepass").split())
            else:
                seen.add(line)
    return (
        len(words), len(text) - without(WORD_SPACE), without(SYMBOLS), dup, repeat_words(codes, max(1, len(ids))), len(lines),
        without(UPPER), without(DIGITS), without(PUNCTUATION), len(ids), len(raw), max(map(len, ids), default=0),
    )


def add_stats(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([text_stats(t) for t in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(rows[:, k]) for k in range(len(STATS)))], [*keep, *STATS])


def with_stats(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of column ``text``; map-only."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(s, T.LongType()) for s in STATS])
    return df.mapInArrow(lambda it: add_stats(it, keep), schema)
