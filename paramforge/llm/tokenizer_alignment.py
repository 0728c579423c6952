"""Alignment of the tokens of two tokenizers over the same bytes.

A text is encoded with one blank in front by a byte-level BPE of the
tokenizers library (A) and by a SentencePiece model (B, which adds that blank
itself). The character offsets of A and the spans of B's proto give coarse
ends; where several tokens share a character (A) or a token has an empty span
(B's byte pieces), the ends are refined with the bytes the tokens decode to.
Byte offsets where tokens of both end cut the tokens into groups; a link is a
pair of an A and a B token whose byte ranges overlap.

Both tokenizers cut between a character and a blank before another character,
so a text is a line of units of one blank and the characters after it. Each
distinct unit of a batch is aligned once, many joined in one call of each
library; a worker remembers them (bounded in bytes).

The corpus-wide count of a pair of ids comes from sums per chunk of
documents. Chunks ask for the counts of their own distinct pairs by a join,
so no table of all pairs is sent to a task or to the driver.
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
from pyspark.sql import functions as F

from paramforge.llm.common import Scratch, parts_for
from paramforge.llm.distinct import as_one, distinct, ragged, rows_with, slices
from paramforge.llm.remember import Remembered, in_worker

MARK = "▁"


@dataclass(frozen=True)
class Params:
    tokenizer: str  # path of a byte-level BPE of the tokenizers library (A)
    pieces: str  # path of a SentencePiece model (B)
    chunk_bytes: int = 8 << 20  # of text; a longer document is a chunk alone
    cache_bytes: int = 96 << 20  # of a generation of remembered units


def byte_of_sign() -> dict[str, int]:
    """The signs in which byte-level vocabularies write bytes: printable Latin-1
    bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in plain}
    for n, b in enumerate(sorted(set(range(256)) - set(plain))):
        signs[chr(0x100 + n)] = b
    return signs


def refined(ends: np.ndarray, sure: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Byte ends of tokens. ``sure`` marks those whose coarse end holds; the
    tokens before one, back to the sure one before, end where the decoded
    bytes of those after them leave off. The last token must be sure."""
    total = np.cumsum(lens)
    anchor = np.flatnonzero(sure)
    anchor = anchor[np.searchsorted(anchor, np.arange(len(ends)))]
    return ends[anchor] - (total[anchor] - total)


@dataclass
class Line:
    """Tokens of one text with a blank in front: ids and byte ends of both."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def group_ends(self) -> np.ndarray:
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(byte ends of the overlaps, A id * 2^32 + B id of each)."""
        ends = np.union1d(self.a_ends, self.b_ends)
        a, b = self.a[np.searchsorted(self.a_ends, ends)], self.b[np.searchsorted(self.b_ends, ends)]
        return ends, (a << 32) + b


class GroupWriter:
    """Lines as ``a1,a2|b1;a3|b2;``: each token is written with the sign after it."""

    def __init__(self, a_size: int, b_size: int):
        self.a_size = a_size
        ids = [*map(str, range(a_size)), *map(str, range(b_size))]
        self.table = [x + sign for x in ids for sign in ",|;"]
        self.size = np.array([len(x) for x in self.table], dtype=np.int64)

    def __call__(self, line: Line) -> tuple[np.ndarray, str, np.ndarray]:
        """(byte ends of the groups, all groups, their ends in the string)."""
        ends = line.group_ends()
        group = np.concatenate([np.searchsorted(ends, line.a_ends), np.searchsorted(ends, line.b_ends)])
        side = np.repeat([0, 1], [len(line.a), len(line.b)])
        order = np.argsort(group * 2 + side, kind="stable")
        key = (group * 2 + side)[order]
        last = np.append(key[1:] != key[:-1], True) if len(key) else np.empty(0, bool)
        code = np.concatenate([line.a, line.b + self.a_size])[order] * 3 + np.where(last, 1 + (key & 1), 0)
        at = np.cumsum(self.size[code])
        return ends, "".join(map(self.table.__getitem__, code.tolist())), at[last & (key & 1 == 1)]


class Aligner:
    def __init__(self, spec: str, proto: bytes, cache_bytes: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = True
        sign = byte_of_sign()
        vocab = self.tok.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(sign[c] for c in t) if all(c in sign for c in t) else t.encode()
        self.a_len = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        if any(MARK in p.lstrip(MARK) for p in pieces if p != MARK):
            raise ValueError("a piece reaches over the start of a marked word")
        self.write = GroupWriter(len(self.a_bytes), len(self.b_bytes))
        self.flat = [(np.frombuffer(b"".join(x), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in x])])) for x in (self.a_bytes, self.b_bytes)]
        self.units = Remembered(self.new_units, cache_bytes, lambda u: 0 if u is None else len(u[0]) + len(u[1]) + 250)

    def spelled(self, which: int, ids: np.ndarray, lens: np.ndarray, raw: bytes) -> bool:
        flat, first = self.flat[which]
        ends = np.cumsum(lens[ids])
        if not len(ids) or ends[-1] != len(raw):
            return False
        place = np.arange(ends[-1]) + np.repeat(first[ids] - (ends - lens[ids]), lens[ids])
        return flat[place].tobytes() == raw

    def line(self, text: str) -> Line | None:
        """None if the tokens do not spell a blank and the text."""
        raw = b" " + text.encode("utf-8", "surrogatepass")
        e = self.tok.encode(" " + text, add_special_tokens=False)
        a = np.array(e.ids, dtype=np.int64)
        try:
            spans = self.sp.encode(text, return_type="proto").pieces
        except TypeError:  # older versions
            spans = self.sp.encode(text, out_type="immutable_proto").pieces
        b = np.fromiter([x.id for x in spans], dtype=np.int64, count=len(spans))
        b_ends = np.fromiter([x.end for x in spans], dtype=np.int64, count=len(spans)) + 1
        if not (self.spelled(0, a, self.a_len, raw) and self.spelled(1, b, self.b_len, raw)):
            return None
        a_ends = np.array(e.offsets, dtype=np.int64)[:, 1]
        if len(text) + 1 != len(raw):
            start = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)  # of each character
            a_ends = np.append(start, len(raw))[a_ends]
        a_ends = refined(a_ends, np.append(a_ends[1:] != a_ends[:-1], True), self.a_len[a])
        b_ends = refined(b_ends, np.diff(b_ends, prepend=1) > 0, self.b_len[b])
        return Line(a, a_ends, b, b_ends)

    def unit(self, line: Line | None) -> tuple | None:
        """(groups, links, n_a, n_b, n_groups) of a whole line."""
        if line is None:
            return None
        ends, groups, _ = self.write(line)
        return groups.encode(), line.links()[1].tobytes(), len(line.a), len(line.b), len(ends)

    def new_units(self, words: list[str]) -> list[tuple | None]:
        """Units of words without their blank, many aligned in one line."""
        out: list[tuple | None] = []
        for lo in range(0, len(words), 500):
            some = words[lo : lo + 500]
            text = " ".join(some)
            line = self.line(text)
            chars = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1)
            size = chars
            if not text.isascii():
                size = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in some])
            if line is None or not (np.isin(size, line.a_ends).all() and np.isin(size, line.b_ends).all()):
                out += [self.unit(self.line(w)) for w in some]
                continue
            ends, groups, at = self.write(line)
            link_ends, links = line.links()
            g, k, a, b = (np.concatenate([[0], np.searchsorted(x, size, side="right")]) for x in (ends, link_ends, line.a_ends, line.b_ends))
            t, raw, groups = np.concatenate([[0], at])[g].tolist(), links.tobytes(), groups.encode()
            counts = zip(np.diff(a).tolist(), np.diff(b).tolist(), np.diff(g).tolist(), strict=True)
            k = (8 * k).tolist()
            out += [(groups[t[n] : t[n + 1]], raw[k[n] : k[n + 1]], *c) for n, c in enumerate(counts)]
        return out

    def texts(self, texts: pa.StringArray) -> tuple[list[tuple | None], np.ndarray, np.ndarray]:
        """(distinct units, place of each unit of the texts among them, offsets
        of the texts). A text whose blanks do not stand between other
        characters, or with a unit that is not spelled by its tokens, is one
        unit; None has no tokens."""
        words, at, offsets = distinct(pc.split_pattern(texts, " "))
        odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], dtype=bool)
        known = self.units.learn({w for w, o in zip(words, odd.tolist(), strict=True) if not o})
        found = [None if o else known[w] for w, o in zip(words, odd.tolist(), strict=True)]
        odd |= np.array([f is None for f in found], dtype=bool)
        whole = rows_with(odd, at, offsets)
        at, offsets = as_one(at, offsets, whole, len(found))
        for text in texts.take(pa.array(whole)).to_pylist():
            found.append(self.unit(self.line(text)) if text else None)
        return found, at, offsets


DOC = "struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>"
CHUNK = f"chunk long, docs array<{DOC}>, pairs array<long>, counts array<long>, places binary"


def aligner_of(p: Params):
    spec, proto = Path(p.tokenizer).read_text(), Path(p.pieces).read_bytes()
    return lambda: in_worker(("aligner", spec, proto, p.cache_bytes), lambda: Aligner(spec, proto, p.cache_bytes))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def alignments(docs: DataFrame, params: Params) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, a, b (ids), a_ends, b_ends (byte
    offsets in blank + text where tokens end), groups (``a1,a2|b1;a3|b2``) of
    every row. Texts without tokens have empty lists and an empty string."""
    make = aligner_of(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = make()
        for part in slices(batches, "text", params.chunk_bytes // 16):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                line = al.line(text) if text else None
                line = line or Line(*[np.empty(0, np.int64)] * 4)
                rows.append({"doc_id": doc, "a": line.a, "b": line.b, "a_ends": line.a_ends, "b_ends": line.b_ends, "groups": al.write(line)[1][:-1]})
            ids = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("a", ids), ("b", ids), ("a_ends", ids), ("b_ends", ids), ("groups", pa.string())]))

    return texts_of(docs).mapInArrow(run, "doc_id long, a array<long>, b array<long>, a_ends array<long>, b_ends array<long>, groups string")


def pack_arrays(*arrays: np.ndarray) -> bytes:
    body = b"".join([np.ascontiguousarray(x, dtype="<i4").tobytes() for x in arrays])
    return np.array([len(x) for x in arrays], dtype="<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def unpack_arrays(raw: bytes, n: int) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, dtype="<i8", count=n)
    return np.split(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8 * n :]), dtype="<i4"), np.cumsum(sizes)[:-1])


def chunk_row(al: Aligner, chunk: int, ids: list, texts: pa.StringArray) -> pa.RecordBatch:
    """One row: its documents, its distinct pairs with their links, and where
    they stand: units of the documents, pairs of the units."""
    units, at, offsets = al.texts(texts)
    spelled = [u or (b"", b"", 0, 0, 0) for u in units]
    at, ends = at.astype(np.int64), offsets[1:]
    sizes = np.array([[u[2], u[3], u[4], len(u[1]) // 8] for u in spelled], dtype=np.int64).reshape(-1, 4)
    before = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sizes[at], axis=0)])
    per_doc = np.diff(before[np.concatenate([[0], ends])], axis=0).tolist()
    name, docs = [u[0] for u in spelled].__getitem__, []
    for doc, (a, b, g, n), i, j in zip(ids, per_doc, offsets[:-1].tolist(), ends.tolist(), strict=True):
        sha = hashlib.sha256(b"".join(map(name, at[i:j].tolist()))[:-1]).hexdigest() if a else ""
        docs.append({"doc_id": doc, "n_a": a, "n_b": b, "n_groups": g, "n_links": n, "groups_sha256": sha})
    links, link_ends = ragged([u[1] for u in spelled], np.arange(len(spelled)), "<i8")
    pairs, place = np.unique(links, return_inverse=True)
    times = np.repeat(np.bincount(at, minlength=len(spelled)), np.diff(link_ends, prepend=0))
    counts = np.bincount(place, weights=times, minlength=len(pairs)).astype(np.int64)
    row = {"chunk": chunk, "docs": docs, "pairs": pairs, "counts": counts, "places": pack_arrays(at, ends, place, link_ends)}
    doc = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
    return pa.RecordBatch.from_pylist([row], schema=pa.schema([("chunk", pa.int64()), ("docs", pa.list_(doc)), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("places", pa.binary())]))


def align_chunks(docs: DataFrame, p: Params) -> DataFrame:
    """Rows of ``chunk_row``; a chunk lies within a partition of the input."""
    make = aligner_of(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        al, chunk = make(), TaskContext.get().partitionId() << 32
        held, size = [], 0
        for part in slices(batches, "text", p.chunk_bytes):
            n = int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
            if held and size + n > p.chunk_bytes:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield chunk_row(al, chunk, whole.column("doc_id").to_pylist(), whole.column("text").combine_chunks())
                chunk, held, size = chunk + 1, [], 0
            held.append(part)
            size += n
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield chunk_row(al, chunk, whole.column("doc_id").to_pylist(), whole.column("text").combine_chunks())

    return texts_of(docs).mapInArrow(run, CHUNK)


REPORT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def alignment_report(docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of
    every row of ``docs`` (doc_id, text).

    Texts that are null, empty or not spelled by the tokens have zeros and an
    empty ``groups_sha256``. A null doc_id stays null; repeated rows each count
    and each return; other columns are not read.
    """
    spark, p = docs.sparkSession, params
    scratch = Scratch(spark, "alignment")
    chunks = scratch.table(align_chunks(docs, p), "chunks")
    asked = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    pairs = scratch.table(asked.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = pairs.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))  # one row per B id
    told = pairs.withColumn("b", b_id).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    told = asked.select("chunk", "pair").join(told.hint("shuffle_hash"), "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("told"))
    told = told.select("chunk", F.col("told.count").alias("count"), F.col("told.best").alias("best"))
    parts = parts_for(spark, chunks.count() * p.chunk_bytes)
    rows = chunks.select("chunk", "docs", "places").repartition(parts, "chunk").join(told.repartition(parts, "chunk").hint("merge"), "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs = batch.column("docs")[k].values
                at, ends, place, link_ends = unpack_arrays(batch.column("places")[k].as_py(), 4)
                out = []
                for c in ("best", "count"):
                    value = batch.column(c)[k].values
                    value = np.empty(0, np.int64) if value is None else value.to_numpy(zero_copy_only=False).astype(np.int64)
                    unit = np.diff(np.concatenate([[0], np.cumsum(value[place])])[link_ends], prepend=0)
                    out.append(np.diff(np.concatenate([[0], np.cumsum(unit[at])])[ends], prepend=0))
                cols = {c: docs.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | {"n_best": pa.array(out[0], pa.int64()), "count_sum": pa.array(out[1], pa.int64())}
                yield pa.RecordBatch.from_arrays([cols[c] for c in REPORT], REPORT)

    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in REPORT))
