"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked as SentencePiece marks it: a blank becomes ``▁`` and one
``▁`` is put in front. No piece of the vocabulary reaches over the start of a
marked word (a run of ``▁`` and the characters after it), so the best
segmentation of a text is that of its marked words. The distinct marked
words of an Arrow batch are sorted, which is a depth-first walk of their
trie; the forward scores of a word are kept up to the prefix it shares with
the next one, and only the rest is computed.

Scores are those of the model file. Of equally good segmentations the one
whose last piece starts first wins, as in the library's unigram search (the
BPE flag of the file is not used: the search is Viterbi). A character in no
piece becomes the pieces of its UTF-8 bytes, at a score below every other.
Decoding joins the pieces again; a text without ``▁`` of its own comes back
exactly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")
UNKNOWN = 10.0  # below the least score


@dataclass
class Vocabulary:
    raw: dict[str, bytes]  # piece -> its id as 4 little-endian bytes
    ends: dict[str, float]  # every suffix of a piece -> score, -inf if no piece
    bytes_: list[int]  # ids of the 256 byte pieces
    pieces: list[str]
    unknown: float

    @classmethod
    def load(cls, proto: bytes) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        normal = {p: i for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece reaches over the start of a marked word")
        ends = {p[k:]: float("-inf") for p in normal for k in range(len(p))}
        ends |= {p: sp.get_score(i) for p, i in normal.items()}
        unknown = min(ends[p] for p in normal) - UNKNOWN
        return cls({p: i.to_bytes(4, "little") for p, i in normal.items()}, ends, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], pieces, unknown)


def segment_sorted(words: list[str], v: Vocabulary) -> Iterator[tuple[str, bytes]]:
    """(word, ids) of sorted distinct marked words, reusing forward scores.
    For each end, pieces are tried backwards until no piece ends so."""
    best, back = [0.0], [0]  # score and start of the last piece, by end
    get, raw, last = v.ends.get, v.raw, ""
    for word in words:
        n, same = len(word), 0
        for a, b in zip(word, last):
            if a != b:
                break
            same += 1
        del best[same + 1 :], back[same + 1 :]
        for end in range(same + 1, n + 1):
            start = at = end - 1
            top = best[start] + v.unknown if word[start] not in raw else -1e300
            while start >= 0:
                score = get(word[start:end])
                if score is None:
                    break
                score += best[start]
                if score >= top:
                    top, at = score, start
                start -= 1
            best.append(top)
            back.append(at)
        last, parts, end = word, [], n
        while end:
            start = back[end]
            piece = raw.get(word[start:end])
            parts.append(piece if piece is not None else b"".join(v.bytes_[b].to_bytes(4, "little") for b in word[start:end].encode("utf-8", "surrogatepass")))
            end = start
        parts.reverse()
        yield word, b"".join(parts)


def marked_words(text: str) -> list[str]:
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


class Decoder:
    """Pieces joined; runs of byte pieces are UTF-8, broken ones become U+FFFD."""

    def __init__(self, v: Vocabulary):
        self.byte_of = {i: b for b, i in enumerate(v.bytes_)}
        self.text = list(v.pieces)
        for b, i in enumerate(v.bytes_[:128]):
            self.text[i] = chr(b)  # an ASCII byte is a character of its own
        self.wide = np.zeros(len(v.pieces), dtype=bool)
        self.wide[v.bytes_[128:]] = True

    def __call__(self, ids: np.ndarray) -> str:
        if self.wide[ids].any():
            out, run = [], bytearray()
            for i in ids.tolist():
                if self.wide[i]:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(self.text[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            table = self.text
            text = "".join([table[i] for i in ids.tolist()])
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class Codec:
    """Encodes batches; remembers at most ``cache`` words between them."""

    def __init__(self, proto: bytes, cache: int = 300_000):
        self.v, self.cache = Vocabulary.load(proto), cache
        self.decode = Decoder(self.v)
        self.ids: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for lo in range(0, len(texts), 256):
            split = [marked_words(t or "") for t in texts[lo : lo + 256]]
            if len(self.ids) > self.cache:
                self.ids.clear()
            new = sorted({w for words in split for w in words if w not in self.ids})
            for word, ids in segment_sorted(new, self.v):
                self.ids[word] = ids
            for words in split:
                yield np.frombuffer(b"".join([self.ids[w] for w in words]), dtype="<i4")

    def round_trip(self, text: str | None, ids: np.ndarray) -> bool:
        return self.decode(ids) == (text or "")


def pieces_of(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` columns (doc_id, text) -> doc_id, n_tokens, ids_crc32,
    round_trip, ids for every row. A null or empty text has no ids. ``round_trip``:
    decoding the ids gives the text again (false only if it holds ``▁``)."""
    with open(model, "rb") as f:
        proto = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(proto)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts = batch.column("text").to_pylist()
                ids = list(codec.encode(texts))
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([codec.round_trip(t, x) for t, x in zip(texts, ids, strict=True)]), lists],
                    ["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"],
                )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def texts_of(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text): decoding; null ids give null."""
    with open(model, "rb") as f:
        proto = f.read()

    @F.pandas_udf("string")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = Decoder(Vocabulary.load(proto))
        for ids in batches:
            yield ids.map(lambda x: None if x is None else decode(np.asarray(x, dtype=np.int64)))

    return encoded.select("doc_id", joined("ids").alias("text"))
