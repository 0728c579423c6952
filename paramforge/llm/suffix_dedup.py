"""Removal of repeated byte strings by blockwise suffix sorting with a
precomputed cover sample.

Every suffix that begins a string of ``min_len`` bytes has to be compared
with all others to that depth. As in the difference-cover construction, a
sample of the suffixes is named first, such that any two equal strings of
``min_len`` bytes hold a sampled suffix at the same shift. Ranks (here: 64-bit
names of ``name_len`` bytes) of the sample then send the suffixes into
buckets and resolve their ties, and the buckets are worked off one at a time,
so that neither memory nor disk ever holds all suffixes.

The sample is a content-defined cover (a string synchronising set): of the
31 names in each 50-byte string the least is sampled, about one position in
16. A difference cover modulo 31 has the same property but samples 6 of 31
positions; its names alone would take more disk than the operator may use.

1. names: the distinct sampled names of each document, written by bucket.
2. one bucket at a time: names that occur in two documents or more.
3. suffixes whose sampled name is shared become rows (name, document, bytes
   of up to 31 suffixes around the sampled position), sorted by name and
   document; within a name, suffixes are equal if their shift to the sampled
   position and their 50 bytes are. The first document of equal suffixes
   keeps them, all later ones lose these bytes. Names held by more than
   ``hot_rows`` documents are first settled in salted groups; what is lost
   there is a span, and only the suffixes that are first in a salted group
   meet again, by shift and 50 bytes, so unequal ones in different groups.
4. per document, the union of its lost strings is cut out.

Whole copies of a text are settled by their hash and take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paramforge.llm.common import Scratch, nested
from paramforge.llm.shingles import mix

NONE = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Params:
    min_len: int = 50
    name_len: int = 20
    buckets: int = 4  # suffix buckets, worked off one at a time
    hot_rows: int = 5_000  # a name in more documents is settled in salted groups
    piece: int = 1 << 20  # bytes of a text handled at once

    @property
    def span(self) -> int:  # names in a string of min_len bytes
        return self.min_len - self.name_len + 1


def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def names_of(raw: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of all substrings of ``length`` bytes, by doubling."""
    power, span = byte_codes()[raw], 1
    out, done, rest = None, 0, length
    while True:
        if rest & 1:
            if out is None:
                out, done = power, span
            else:
                n = len(power) - done
                out = out[:n] * np.uint64(0xD1342543DE82EF95) + power[done : done + n]
                done += span
        rest >>= 1
        if not rest:
            return mix(out)
        power = power[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + power[span:]
        span *= 2


def slide(op, x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x, span = op(x[:-span], x[span:]), span * 2
    return op(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def sampled(names: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(least name of each window, positions that hold one)."""
    least = slide(np.minimum, names, span)
    pad = np.zeros(span - 1, dtype=np.uint64)
    return least, np.flatnonzero((names == slide(np.maximum, np.concatenate([pad, least, pad]), span)) & (names != NONE))


def pieces(raw: bytes, p: Params) -> Iterator[tuple[int, np.ndarray]]:
    """The strings that start in [at, at + piece), so each starts in one piece."""
    for at in range(0, max(0, len(raw) - p.min_len + 1), p.piece):
        yield at, np.frombuffer(raw, dtype=np.uint8, offset=at, count=min(len(raw) - at, p.piece + p.min_len - 1))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def sample_names(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Distinct (name, doc) of the cover sample."""

    def flush(docs, parts):
        raw = np.concatenate(parts)
        ends = np.cumsum([len(x) for x in parts])
        names = names_of(raw, p.name_len)
        for e in ends[:-1]:  # names that run over the end of a text
            names[max(0, e - p.name_len + 1) : e] = NONE
        _, at = sampled(names, p.span)
        doc = np.array(docs, dtype=np.int64)[np.searchsorted(ends, at, side="right")]
        name = names[at]
        order = np.lexsort((name, doc))
        doc, name = doc[order], name[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
        doc, name = doc[new], name[new]
        return pa.RecordBatch.from_arrays([pa.array((name % np.uint64(p.buckets)).astype(np.int32)), pa.array(name.view(np.int64)), pa.array(doc)], ["bucket", "name", "doc"])

    docs, parts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for _, piece in pieces(as_bytes(text), p):
                docs.append(doc)
                parts.append(piece)
                size += len(piece)
                if size > p.piece // 4:
                    yield flush(docs, parts)
                    docs, parts, size = [], [], 0
    if parts:
        yield flush(docs, parts)


ROW = "name long, salts int, doc long, first long, mask long, ctx binary"


def suffix_rows(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """The suffixes whose sampled name is shared: one row per sampled
    position, with the bytes of all strings that lean on it."""
    schema = pa.schema([("name", pa.int64()), ("salts", pa.int32()), ("doc", pa.int64()), ("first", pa.int64()), ("shift", pa.int32()), ("mask", pa.int64()), ("ctx", pa.binary())])
    for batch in batches:
        hits = batch.column("hits")
        at_hit = hits.offsets.to_numpy()
        all_names, all_salts = (hits.values.field(c).to_numpy(zero_copy_only=False) for c in ("name", "salts"))
        for k, (doc, text) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            shared = all_names[at_hit[k] : at_hit[k + 1]].view(np.uint64)
            salts = all_salts[at_hit[k] : at_hit[k + 1]]
            order = np.argsort(shared)
            shared, salts = shared[order], salts[order]
            raw = as_bytes(text)
            for at, piece in pieces(raw, p):
                names = names_of(piece, p.name_len)
                least, cand = sampled(names, p.span)
                # leftmost sampled position in each window that holds its least name
                is_cand = np.zeros(len(names), dtype=np.int64)
                is_cand[cand] = 1
                nth = (np.cumsum(is_cand) - is_cand)[: len(least)]  # sampled positions before each window
                value = names[cand]
                todo = np.flatnonzero(value[nth] != least)
                while len(todo):
                    nth[todo] += 1
                    todo = todo[value[nth[todo]] != least[todo]]
                cuts = np.flatnonzero(np.diff(nth)) + 1
                first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(nth)]]) - 1
                pos = cand[nth[first]]
                hit = np.searchsorted(shared, names[pos])
                hit[hit == len(shared)] = 0
                ok = shared[hit] == names[pos]
                first, last, pos, hit = first[ok], last[ok], pos[ok], hit[ok]
                data = piece.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[pos].view(np.int64)), pa.array(salts[hit]), pa.array(np.full(len(pos), doc)), pa.array((first + at).astype(np.int64)), pa.array((pos - first).astype(np.int32)),
                        pa.array(np.zeros(len(pos), dtype=np.int64)), pa.array([data[a : b + p.min_len] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
                    ],
                    schema=schema,
                )


def open_strings(batch: pa.RecordBatch, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, key) of the strings whose mask bit is not set;
    equal strings at the same shift to the same name have equal keys."""
    name, mask = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("name", "mask"))
    ctx = batch.column("ctx").to_pylist()
    size = np.array([len(x) for x in ctx], dtype=np.int64)
    count = size - p.min_len + 1  # strings of each row
    ends = np.cumsum(size)
    raw = np.frombuffer(b"".join(ctx), dtype=np.uint8)
    row = np.repeat(np.arange(len(ctx)), count)
    off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    windows = names_of(raw, p.min_len)[(ends - size)[row] + off]
    shift = batch.column("shift").to_numpy()[row] - off
    key = np.stack([mix(name.view(np.uint64)[row] + shift.astype(np.uint64)), windows], axis=1)
    open_ = (mask[row] >> off) & 1 == 0
    return row[open_], off[open_], key[open_]


def keyed(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """(k1, k2, doc, first, bit) of every open string."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 4_000):
            batch = whole.slice(lo, 4_000)
            row, off, key = open_strings(batch, p)
            doc, first = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "first"))
            bit = np.int64(1) << off.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[:, 0].copy().view(np.int64), key[:, 1].copy().view(np.int64), doc, first, bit)], ["k1", "k2", "doc", "first", "bit"])


def meet(hot: DataFrame, p: Params) -> DataFrame:
    """(doc, first, mask): strings of ``hot`` that are open in their salted
    group and also start in an earlier document of another one."""
    strings = hot.mapInArrow(lambda it: keyed(it, p), "k1 long, k2 long, doc long, first long, bit long")
    owner = F.min("doc").over(Window.partitionBy("k1", "k2"))
    return strings.withColumn("owner", owner).where("owner < doc").select("doc", "first", F.col("bit").alias("mask"))


def settle(batches: Iterator[pa.RecordBatch], p: Params, carry: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (name, doc): sets the mask bits of strings that also
    start in an earlier document. Only the strings of the last name stay in
    memory between batches. ``carry``: all columns, else doc, first, mask."""
    old_key, old_doc, old_name = np.empty((0, 2), np.uint64), np.empty(0, np.int64), None
    for whole in batches:
        for lo in range(0, whole.num_rows, 4_000):
            batch = whole.slice(lo, 4_000)
            name, doc, mask = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("name", "doc", "mask"))
            row, off, key = open_strings(batch, p)
            keep = old_name is not None and len(name) and name[0] == old_name
            all_key = np.concatenate([old_key, key]) if keep else key
            all_doc = np.concatenate([old_doc, doc[row]]) if keep else doc[row]
            n_old = len(all_key) - len(key)
            order = np.argsort(all_key[:, 0] ^ (all_key[:, 1] * np.uint64(0xD6E8FEB86659FD93)), kind="stable")  # equal keys stay in order
            sk = all_key[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (sk[1:] != sk[:-1]).any(axis=1)
            owner = np.empty(len(order), dtype=np.int64)
            owner[order] = all_doc[order][new][np.cumsum(new) - 1]
            lost = (owner < all_doc)[n_old:]
            np.bitwise_or.at(mask, row[lost], np.int64(1) << off[lost].astype(np.int64))
            if len(name):
                firsts = order[new]
                all_name = np.concatenate([np.full(n_old, old_name or 0, dtype=np.int64), name[row]])
                stay = firsts[all_name[firsts] == name[-1]]
                old_key, old_doc, old_name = all_key[stay], all_doc[stay], name[-1]
            if carry:
                yield pa.RecordBatch.from_arrays([pa.array(mask) if c == "mask" else batch.column(c) for c in batch.schema.names], batch.schema.names)
            else:
                hit = mask != 0
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), batch.column("first").filter(pa.array(hit)), pa.array(mask[hit])], ["doc", "first", "mask"])


def cut(raw: bytes, spans: list | None, whole: bool, p: Params) -> tuple[bytes, int]:
    """What is left of a text, and the number of removed runs."""
    if whole and len(raw) >= p.min_len:
        return b"", 1
    if not spans:
        return raw, 0
    first = np.array([s["first"] for s in spans], dtype=np.int64)
    mask = np.array([s["mask"] for s in spans], dtype=np.int64)
    row, k = np.nonzero((mask[:, None] >> np.arange(p.span)) & 1)
    at = first[row] + k
    edge = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + p.min_len, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), runs


def lost_strings(docs: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """(doc, copy, spans): for the documents that lose bytes, the strings lost
    (start of a run of strings and a mask), or that it is a later copy."""
    ids = scratch.table(docs.where("doc is not null").select("doc", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")), "ids")
    reps = ids.groupBy("sha").agg(F.min("doc").alias("rep"))
    copies = scratch.table(ids.join(reps, "sha").where("doc > rep").select("doc").distinct(), "copies")
    texts = docs.where(F.col("doc").isNotNull() & (F.octet_length("text") >= p.min_len))

    names = texts.mapInArrow(lambda it: sample_names(it, p), "bucket int, name long, doc long").join(copies, "doc", "left_anti")
    path = f"{scratch.base}/names"
    names.write.partitionBy("bucket").parquet(path)
    hits = None
    for b in range(p.buckets):
        bucket = docs.sparkSession.read.schema("name long, doc long, bucket int").parquet(path).where(F.col("bucket") == b).drop("bucket")
        shared = bucket.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = scratch.table(bucket.join(shared, "name"), "hits")
        hits = found if hits is None else hits.unionByName(found)
        scratch.release_shuffles()
    scratch.drop(path)
    salts = F.when(F.col("n") > p.hot_rows, F.ceil(F.col("n") / p.hot_rows)).otherwise(0).cast("int")
    by_doc = hits.groupBy("doc").agg(F.collect_set(F.struct("name", salts.alias("salts"))).alias("hits"))
    rows = scratch.table(texts.join(by_doc, "doc").select("doc", "text", "hits").mapInArrow(lambda it: suffix_rows(it, p), "name long, salts int, doc long, first long, shift int, mask long, ctx binary"), "suffixes")
    scratch.release_shuffles()

    kind = rows.schema
    hot = rows.where("salts > 0").withColumn("salt", F.pmod(F.hash("doc"), F.col("salts"))).repartition("name", "salt").sortWithinPartitions("name", "salt", "doc").drop("salt")
    hot = scratch.table(hot.mapInArrow(lambda it: settle(it, p, True), kind), "hot")
    open_ = rows.where("salts = 0").repartition("name").sortWithinPartitions("name", "doc", "first")
    spans = open_.mapInArrow(lambda it: settle(it, p, False), "doc long, first long, mask long")
    spans = scratch.table(spans.unionByName(hot.where("mask <> 0").select("doc", "first", "mask")).unionByName(meet(hot, p)), "spans")
    scratch.drop(rows, hot)
    scratch.release_shuffles()
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("first", "mask")).alias("spans"))
    return copies.withColumn("copy", F.lit(True)).join(by_doc, "doc", "full")


def removed_report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of
    ``docs`` (doc_id, text). A null text is empty; a row without a doc_id
    loses nothing and is no evidence; equal doc_ids never remove each other."""
    p = params
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    lost = lost_strings(docs, p, Scratch(docs.sparkSession, "suffix"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, copy, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "copy", "spans")), strict=True):
                raw = as_bytes(text)
                left, runs = cut(raw, spans, bool(copy), p)
                out.append((doc, len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), r, strict=True)) for r in out], schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return docs.join(lost, "doc", "left").select("doc", "text", "copy", "spans").mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` with repeated strings cut from ``text`` (null stays null) and
    ``n_chars`` set anew if there; a character that lost some of its bytes goes."""
    p = params
    ids = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    lost = lost_strings(ids, p, Scratch(docs.sparkSession, "suffix"))

    @F.pandas_udf("string")
    def rest(text, copy, spans):
        return text.combine(copy, lambda t, c: (t, c)).combine(spans, lambda tc, s: None if tc[0] is None else cut(as_bytes(tc[0]), None if s is None else list(s), tc[1] is True or tc[1] == True, p)[0].decode("utf-8", "ignore"))  # noqa: E712

    new = {"text": F.when(F.col("copy") | F.col("spans").isNotNull(), rest("text", F.coalesce("copy", F.lit(False)), "spans")).otherwise(F.col("text"))}
    rows = nested(docs, "doc_id", "text").withColumnRenamed("doc_id", "doc").join(lost, "doc", "left").withColumns(new)
    out = F.col("_doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        out = out.withField("n_chars", F.when(F.col("text") != F.col("_doc.text"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars")))
    return rows.select(out.alias("_doc")).select("_doc.*")
