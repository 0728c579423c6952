"""Packing of token streams into windows by order-preserving dynamic programming.

Documents keep their order: that of the table's rows, so nothing is shuffled
(a caller who wants another order sorts first). The ids of a partition are
worked off in blocks of whole documents; the ids of a block form one line,
and window cuts are chosen on it such that padding plus penalties is least:

* padding: a window of n ids is filled up to ``window``, unless n is a power
  of two;
* penalties: 0 for a cut at the end of a document, ``sentence_cost`` at the
  end of a sentence, ``word_cost`` elsewhere. Cuts elsewhere are offered only
  inside sentences longer than ``long_sentence`` and, so that the end of a
  block fills its windows, within the last window of the block.

``best[j] = penalty[j] + min(best[i] + window - (j - i))`` over the cuts i in
reach is the minimum of ``best[i] + i`` over a sliding window: a monotone
queue gives it in constant time. Lengths of a power of two are at most 13
single transitions more.

Ids of a text come from the tokenizers library. A tokenizer that drops white
space and marks word ends encodes each word on its own, so a worker asks the
library once per distinct word and remembers it (bounded in bytes).
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramforge.llm.distinct import distinct, ragged, row_ends, slices
from paramforge.llm.remember import Remembered, in_worker


@dataclass(frozen=True)
class Params:
    tokenizer: str  # path of a tokenizers JSON file
    end_id: int = 2
    window: int = 4096
    sentence_cost: int = 16  # in ids of padding
    word_cost: int = 64
    long_sentence: int = 512
    grid: int = 64  # distance of the cuts offered inside a long sentence
    block_ids: int = 1 << 20  # a block ends with the document that reaches it
    slice_bytes: int = 8 << 20  # of text encoded at once
    cache_bytes: int = 192 << 20  # of a generation of remembered words


SENTENCE_END = re.compile(r"[\"')\]]*[.!?]+[\"')\]]*(</w>)?")
#: Signs after a letter or digit, at the end of a word: a token run of their own.
TAIL = r"([0-9a-z])([!-/:-@\[-`{-~]+)(\s)"


class WordEncoder:
    """Text (UTF-8) -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, spec: str, cache_bytes: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        model = json.loads(spec)
        kinds = [n["type"] for n in (model.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = model["model"].get("end_of_word_suffix") == "</w>" and kinds == ["NFC", "Replace", "Lowercase"]
        self.added = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.ender = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ender[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.stop = np.zeros(len(self.ender), dtype=bool)
        self.stop[[i for t, i in vocab.items() if SENTENCE_END.fullmatch(t)]] = True
        self.known = Remembered(self.new_words, cache_bytes)

    def whole(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def new_words(self, words: list[bytes]) -> list[bytes]:
        """Words of letters have one word end each, so many are encoded in one
        call and cut there; the others are encoded one by one."""
        out: dict[bytes, bytes] = {}
        text = {w: w.decode("utf-8", "replace") for w in words}
        plain = [w for w in words if text[w].isalpha() and "İ" not in text[w]]
        groups = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        for group, e in zip(groups, self.tok.encode_batch_fast([" ".join([text[w] for w in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.flatnonzero(self.ender[ids]) + 1) * 4
            if len(ends) != len(group):
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            out.update(zip(group, [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self.whole(rest), strict=True))
        return [out[w] for w in words]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one line, end of each text). ASCII letters are
        lower-cased first, which the tokenizer would do."""
        if not self.by_word:
            raws = self.whole(texts.cast(pa.binary()).to_pylist())
            return np.frombuffer(b"".join(raws), dtype="<u4"), np.cumsum([len(r) // 4 for r in raws])
        low = pc.ascii_lower(texts)
        plain = pc.replace_substring_regex(low, TAIL, r"\1 \2\3")
        for token in self.added:
            plain = pc.if_else(pc.match_substring(low, token), texts, plain)
        words, at, offsets = distinct(pc.ascii_split_whitespace(plain).cast(pa.list_(pa.binary())))
        known = self.known.learn(set(words))
        ids, ends = ragged([known[w] for w in words], at)
        return ids, row_ends(ends, offsets)


def offered_cuts(ids: np.ndarray, doc_ends: np.ndarray, stop: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of the cuts of a line of ids, both ends included."""
    n = len(ids)
    cost = np.full(n + 1, -1, dtype=np.int64)
    ends = stop[ids]
    cost[1:][ends & ~np.append(ends[1:], False)] = p.sentence_cost
    cost[0] = 0
    cost[doc_ends] = 0
    tail = cost[max(0, n - p.window) :]
    tail[tail < 0] = p.word_cost
    at = np.flatnonzero(cost >= 0)
    for a, b in zip(at[:-1][np.diff(at) > p.long_sentence].tolist(), at[1:][np.diff(at) > p.long_sentence].tolist(), strict=True):
        cost[a + p.grid : b : p.grid] = p.word_cost
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int) -> np.ndarray:
    """Places of the window ends of least padding plus penalty; of equal ones
    the window that reaches back furthest, a padded one before an exact one.
    No two neighbours of ``at`` are further apart than ``window``."""
    n = len(at)
    pairs = []
    for k in range(window.bit_length()):
        if 1 << k <= window:
            want = at - (1 << k)
            near = np.searchsorted(at, want)
            hit = np.flatnonzero((want >= 0) & (at[near] == want))
            pairs.append(np.stack([hit, near[hit]]))
    pairs = np.concatenate(pairs, axis=1)
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    first = np.searchsorted(pairs[0], np.arange(n + 1)).tolist()
    exact, places, costs = pairs[1].tolist(), at.tolist(), cost.tolist()
    best, back, key = [0] * n, [0] * n, [0] * n
    queue: deque[int] = deque()
    for j in range(1, n):
        i, place = j - 1, places[j]
        k = key[i] = best[i] + places[i]
        while queue and key[queue[-1]] > k:
            queue.pop()
        queue.append(i)
        while places[queue[0]] < place - window:
            queue.popleft()
        i = queue[0]
        least = key[i] + window - place
        for e in exact[first[j] : first[j + 1]]:
            if best[e] < least:
                least, i = best[e], e
        best[j], back[j] = least + costs[j], i
    out, j = [], n - 1
    while j:
        out.append(places[j])
        j = back[j]
    return np.array(out[::-1], dtype=np.int64)


def padding(length: np.ndarray, window: int) -> np.ndarray:
    return np.where(length & (length - 1) == 0, 0, window - length)


PIECE = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, padding long"
FIELDS = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "padding"]


def pieces_of_block(docs: list[int | None], lines: list[np.ndarray], sizes: np.ndarray, number: int, stop: np.ndarray, p: Params) -> tuple[pa.RecordBatch, int]:
    """Rows of one block, whose sequences are numbered from ``number``."""
    line = np.concatenate(lines)
    doc_ends = np.cumsum(sizes)
    at, cost = offered_cuts(line, doc_ends, stop, p)
    line = line.tobytes()
    wins = best_cuts(at, cost, p.window)
    cuts = np.union1d(doc_ends, wins)
    starts = np.concatenate([[0], cuts[:-1]])
    doc, win = np.searchsorted(doc_ends, starts, side="right"), np.searchsorted(wins, starts, side="right")
    win_starts = np.concatenate([[0], wins[:-1]])
    pad = padding(wins - win_starts, p.window)
    ids = [line[a * 4 : b * 4] for a, b in zip(starts.tolist(), cuts.tolist(), strict=True)]
    cols = [
        pa.array(docs, pa.int64()).take(pa.array(doc)), pa.array(starts - (doc_ends - sizes)[doc]), pa.array(ids, pa.binary()),
        pa.array(sizes[doc]), pa.array(number + win), pa.array(starts - win_starts[win]), pa.array(pad[win]),
    ]
    return pa.RecordBatch.from_arrays(cols, FIELDS), len(wins)


def pack(docs: DataFrame, params: Params) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per piece: doc_id, start (ids of its
    document before it), ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset (in its sequence), padding (of its sequence).

    Each id of each row, with ``end_id`` after its text, lies in exactly one
    piece. A null or empty text is the end id alone; a null doc_id stays null;
    repeated rows are packed as often as they come; other columns are not
    read. A partition's sequences are numbered from its number times 2^32.
    """
    p, spec = params, Path(params.tokenizer).read_text()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = in_worker(("words", spec, p.cache_bytes), lambda: WordEncoder(spec, p.cache_bytes))
        number = TaskContext.get().partitionId() << 32
        ids, lines, sizes, held = [], [], [], 0
        for part in slices(batches, "text", p.slice_bytes):
            line, ends = enc.encode(part.column("text").fill_null(""))
            line = np.insert(line, ends, np.uint32(p.end_id))
            ends += np.arange(1, len(ends) + 1)
            docs, lo = part.column("doc_id").to_pylist(), 0
            while lo < len(docs):  # up to the document that completes the block
                before = ends[lo - 1] if lo else 0
                hi = min(len(docs), int(np.searchsorted(ends, before + p.block_ids - held)) + 1)
                ids.extend(docs[lo:hi])
                lines.append(line[before : ends[hi - 1]])
                sizes.append(np.diff(ends[lo:hi], prepend=before))
                held += len(lines[-1])
                lo = hi
                if held >= p.block_ids:
                    out, n = pieces_of_block(ids, lines, np.concatenate(sizes), number, enc.stop, p)
                    yield out
                    number, ids, lines, sizes, held = number + n, [], [], [], 0
        if ids:
            yield pieces_of_block(ids, lines, np.concatenate(sizes), number, enc.stop, p)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)
