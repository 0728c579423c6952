"""Token ids on disk: one zstandard frame per document, all with one shared
dictionary.

File format: Parquet written by Spark, so it lies in any store that Spark
reaches. A row is a block of documents in ascending order:

====================  ==================================================
``part``, ``block``   place in the order of all documents
``dict_sha256``       hash of the zstandard dictionary of the frames
``doc_ids``           ids of the documents (null stays null)
``offsets``           document k is ``data[offsets[k] : offsets[k + 1]]``
``n_tokens``          number of ids of each document, end id included
``data``              frames, each an array of little-endian unsigned
                      32-bit ids, readable on its own (no whole block is
                      decompressed to read a short document)
====================  ==================================================

A second table, ``dictionary``, holds the dictionary under its hash. It is
trained on the id arrays of at most ``sample_docs`` documents (drawn by a
seeded share of the rows of at most ``sample_bytes`` bytes of text);
everything else covers all documents.

Texts are split at single blanks between other characters, where the
tokenizer never joins; each distinct piece of a slice is encoded once by the
tokenizers library and remembered by the worker, bounded in bytes. A text
that contains an added token of the tokenizer is encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramforge.llm.common import Scratch, parts_for, text_bytes
from paramforge.llm.distinct import as_one, distinct, ragged, row_ends, rows_with, slices
from paramforge.llm.remember import Remembered, in_worker


@dataclass(frozen=True)
class Params:
    tokenizer: str  # path of a tokenizers JSON file
    end_id: int = 0
    level: int = 3
    dict_bytes: int = 64 << 10
    sample_docs: int = 1_000  # bound of the dictionary's training sample
    sample_bytes: int = 16 << 10
    block_bytes: int = 1 << 20  # compressed bytes of a block
    slice_bytes: int = 4 << 20  # of text encoded at once
    cache_bytes: int = 64 << 20  # of a generation of remembered pieces


#: Signs after a letter or digit, at the end of a piece, are a piece of their
#: own; it is set apart by a blank and ``BARE``, the sign of a piece without one.
TAIL = r"([0-9A-Za-z])([!-/:-@\[-`{-~]+)( )"
BARE = "\0"
#: Pieces that are empty or have white space (of ``str.isspace``) at an end.
ODD = r"^$|^[\t-\r\x1c-\x1f\x{85}\pZ]|[\t-\r\x1c-\x1f\x{85}\pZ]$"


class Encoder:
    """Text -> ids, by the tokenizers library, one distinct piece at a time.

    A byte-level tokenizer cuts between a character and a blank before another
    character. New pieces are encoded joined, many in one call: each begins
    with a blank and holds no other, so the tokens that begin with a blank are
    where pieces begin. Texts whose blanks stand otherwise, or that hold an
    added token, are encoded whole.
    """

    def __init__(self, spec: str, cache_bytes: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.blank = np.zeros(max(self.tok.get_vocab().values()) + 1, dtype=bool)
        self.blank[[i for t, i in self.tok.get_vocab().items() if t.startswith("\u0120")]] = True  # the byte-level sign of a blank
        self.known = Remembered(self.new_pieces, cache_bytes)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def new_pieces(self, pieces: list[str]) -> list[bytes]:
        """A piece follows a blank, or ``BARE`` if it does not."""
        out = {"": b""}
        joined = [x for x in pieces if x and x[0] != BARE]
        for k in range(0, len(joined), 500):  # one call each: the library's encodings are many times the text
            group = joined[k : k + 500]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(group)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = (np.flatnonzero(self.blank[ids]) * 4).tolist()
            if len(at) == len(group) and at[0] == 0:
                raw = ids.tobytes()
                out.update(zip(group, [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)], strict=True))
        rest = [x for x in pieces if x not in out]
        out.update(zip(rest, self.whole([x[1:] if x[0] == BARE else " " + x for x in rest]), strict=True))
        return [out[x] for x in pieces]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one line, end of each text)."""
        strange = pc.match_substring(texts, BARE)
        for token in self.added:
            strange = pc.or_(strange, pc.match_substring(texts, token))
        apart = pc.replace_substring_regex(texts, TAIL, r"\1 " + BARE + r"\2\3")
        words, at, offsets = distinct(pc.split_pattern(pc.if_else(strange, "", apart), " "))
        odd = pc.match_substring_regex(pa.array(words, pa.string()), ODD).to_numpy(zero_copy_only=False)
        whole = rows_with(odd, at, offsets)
        heads, nth = np.unique(at[offsets[:-1]], return_inverse=True)  # the first word of a text has no blank
        at = at.copy()
        at[offsets[:-1]] = len(words) + nth
        keys = words + ["" if odd[h] else BARE + words[h] for h in heads.tolist()]
        for k in np.flatnonzero(odd).tolist():
            keys[k] = ""
        known = self.known.learn(set(keys))
        values = [known[k] for k in keys]
        at, offsets = as_one(at, offsets, whole, len(values))
        ids, ends = ragged(values + self.whole(texts.take(pa.array(whole)).to_pylist()), at)
        return ids, row_ends(ends, offsets)


def encoded(batches: Iterator[pa.RecordBatch], spec: str, p: Params) -> Iterator[tuple[int | None, bytes]]:
    enc = in_worker(("pieces", spec, p.cache_bytes), lambda: Encoder(spec, p.cache_bytes))
    end = np.array([p.end_id], dtype="<u4").tobytes()
    for part in slices(batches, "text", p.slice_bytes):
        ids, ends = enc.encode(part.column("text"))
        raw, at = ids.tobytes(), (ends * 4).tolist()
        yield from zip(part.column("doc_id").to_pylist(), [raw[i:j] + end for i, j in zip([0, *at[:-1]], at, strict=True)], strict=True)


def train_dictionary(docs: DataFrame, spec: str, p: Params) -> bytes:
    """Bytes of the dictionary; empty if there is too little to learn from."""
    short = docs.where(F.octet_length("text").between(1, p.sample_bytes))
    # about twice the rows that are wanted, whatever the ids; only these are sorted
    share = min(1.0, 2 * p.sample_docs / max(1, short.count()))
    sample = short.where(F.rand(7) < share).orderBy(F.xxhash64("doc_id", "text")).limit(p.sample_docs)

    def ids(batches):
        for _, raw in encoded(batches, spec, p):
            yield pa.RecordBatch.from_arrays([pa.array([raw])], ["ids"])

    arrays = [r.ids for r in sample.mapInArrow(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(p.dict_bytes, [bytes(a) for a in arrays]).as_bytes()
    except zstandard.ZstdError:
        return b""


def frames(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


BLOCK = "part int, block int, dict_sha256 string, doc_ids array<long>, offsets array<int>, n_tokens array<long>, data binary"


def write_store(docs: DataFrame, params: Params, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Writes all documents; returns the tables (blocks, dictionary) as read back."""
    p, spec = params, Path(params.tokenizer).read_text()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, spec, p)
    name = hashlib.sha256(dictionary).hexdigest()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        comp = zstandard.ZstdCompressor(level=p.level, dict_data=frames(dictionary))
        number, ids, sizes, counts, data = 0, [], [0], [], []

        def block():
            row = {"part": part, "block": number, "dict_sha256": name, "doc_ids": ids, "offsets": sizes, "n_tokens": counts, "data": b"".join(data)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("dict_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int64())), ("data", pa.binary())]))

        for doc, raw in encoded(batches, spec, p):
            frame = comp.compress(raw)
            if data and sizes[-1] + len(frame) > p.block_bytes:
                yield block()
                number, ids, sizes, counts, data = number + 1, [], [0], [], []
            ids.append(doc)
            data.append(frame)
            sizes.append(sizes[-1] + len(frame))
            counts.append(len(raw) // 4)
        if data:
            yield block()

    parts = parts_for(docs.sparkSession, text_bytes(docs))
    ordered = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    store = scratch.table(ordered.mapInArrow(blocks, BLOCK), "blocks")
    words = scratch.table(docs.sparkSession.createDataFrame([(name, dictionary)], "dict_sha256 string, dictionary binary"), "dictionary")
    return store, words


def read_store(store: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian bytes) of every stored document.
    ``start`` counts the ids before it: totals of parts, then of the blocks
    of a part, then of the documents of a block."""
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = store.select("part", "block", total.alias("total"))
    parts = sizes.groupBy("part").agg(F.sum("total").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    inside = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select("part", "block", (F.col("part_start") + F.coalesce(F.sum("total").over(inside), F.lit(0))).alias("start"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if hashlib.sha256(row["dictionary"]).hexdigest() != row["dict_sha256"]:
                    raise ValueError("the dictionary is not the one the frames were written with")
                comp = zstandard.ZstdDecompressor(dict_data=frames(row["dictionary"]))
                at, view = row["offsets"], memoryview(row["data"])
                ids = [comp.decompress(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                first = row["start"] + np.concatenate([[0], np.cumsum(row["n_tokens"])[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(first.astype(np.int64)), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    rows = store.join(starts, ["part", "block"]).join(F.broadcast(words), "dict_sha256")  # one row of dict_bytes
    return rows.mapInArrow(unpack, "doc_id long, start long, ids binary")


def stored_report(docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of ``docs``, read back
    from the written files. A null text is empty; rows of one doc_id follow
    each other by the hash of their text, null doc_ids come first."""
    rows = read_store(*write_store(docs, params, Scratch(docs.sparkSession, "tokens")))
    # computed in the JVM: a second Python stage would hold two workers a task
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
