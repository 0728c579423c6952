"""Word n-gram scores by deleted interpolation.

A token's probability mixes three maximum-likelihood estimates,

    p(w | u) = a_b * c(u w) / c(u) + b_b * c(w) / N + g_b / (V + 1),

with weights for each bucket ``b`` of the context's frequency (powers of
two of ``c(u)``). The weights are learned by expectation-maximisation on
deleted counts: each training token is held out in turn, so it is scored
with every count that includes it lowered by one. Counts cover all training
documents; contexts start with a begin mark in each document.

Documents are dealt into chunks of a few MB by the hash of their id. A chunk
asks for the counts of its distinct words and of its distinct word pairs;
the questions are keyed by a 64-bit hash and answered by the partition of
the hash, so that a frequent word is asked for once a chunk and no count
table is ever broadcast. A pair is not asked for where its count is known
from the chunk itself: where all training occurrences of one of its words
lie in this chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramforge.llm.common import Scratch, parts_for, text_bytes
from paramforge.llm.shingles import MULT, mix

END = 1  # hash of the end token; words hash to other values
BEGIN = 2


@dataclass(frozen=True)
class Params:
    folds: int = 10  # documents whose crc32(doc_id) leaves 0 are held out
    alpha: float = 0.1  # of the base score
    buckets: int = 16  # of context frequency, by powers of two
    iterations: int = 40
    bins: int = 48  # of each estimate's logarithm, for the EM table
    chunk_bytes: int = 6 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Chunk:
    """Tokens of a chunk: word codes with an end after each document."""

    words: np.ndarray  # hash by word code, ascending; code of END, BEGIN at their place
    code: np.ndarray  # of each token
    prev: np.ndarray  # code of its context
    doc: np.ndarray  # row number of its document
    train: np.ndarray  # bool by token

    @classmethod
    def of(cls, texts: list[str | None], held: np.ndarray) -> Chunk:
        ids: dict[bytes, int] = {}
        parts, sizes = [], []
        for t in texts:
            w = tokens(t)
            parts.append(np.fromiter((ids.setdefault(x, len(ids)) for x in w), dtype=np.int64, count=len(w)))
            sizes.append(len(w) + 1)
        hashes = np.array([xxhash.xxh3_64_intdigest(x) | 4 for x in ids] + [END, BEGIN], dtype=np.uint64)
        end, begin = len(ids), len(ids) + 1
        code = np.concatenate([np.append(p, end) for p in parts])
        prev = np.concatenate([np.append(begin, p) for p in parts])
        words, place = np.unique(hashes, return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), sizes)
        return cls(words, place[code], place[prev], doc, ~held[doc])

    def word_counts(self) -> np.ndarray:
        """Training occurrences of each word."""
        return np.bincount(self.code[self.train], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each distinct pair ascending, pair of each token, training count)."""
        key = mix(self.words[self.prev] * MULT + mix(self.words[self.code]))
        pair, at = np.unique(key, return_inverse=True)
        return pair, at, np.bincount(at[self.train], minlength=len(pair))


ASK = "part int, chunk int, keys binary, counts binary"


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the keys ordered by partition of their hash, its bounds)."""
    part = (mix(keys) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def ask(chunk: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pd.DataFrame:
    """Questions by partition of the key's hash; keys stay ascending."""
    order, cuts = by_part(keys, parts)
    rows = [(p, chunk, keys[o].tobytes(), counts[o].astype("<u4").tobytes()) for p in range(parts) if len(o := order[cuts[p] : cuts[p + 1]])]
    return pd.DataFrame(rows, columns=["part", "chunk", "keys", "counts"])


def answer(asked: pd.DataFrame) -> pd.DataFrame:
    """The sum of each key's counts over all chunks, back to each chunk in the
    order it asked; it can tell its keys again, so they are not sent back."""
    keys = [np.frombuffer(k, dtype=np.uint64) for k in asked["keys"]]
    all_keys = np.concatenate(keys)
    distinct, at = np.unique(all_keys, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([np.frombuffer(c, dtype="<u4") for c in asked["counts"]]), minlength=len(distinct)).astype(np.int64)
    sole = np.bincount(at, minlength=len(distinct)) == 1
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    back = pd.DataFrame({"part": asked["part"], "chunk": asked["chunk"]})
    back["counts"] = [narrow(x) for x in np.split(total[at], cuts)]
    back["sole"] = [np.packbits(x).tobytes() for x in np.split(sole[at], cuts)]
    back["distinct"] = [int((total > 0).sum())] + [0] * (len(back) - 1)
    return back


def narrow(x: np.ndarray) -> bytes:
    """Counts as 32-bit integers, or as 64-bit ones if one needs it."""
    return x.astype("<u8" if len(x) and x.max() >= 2**32 else "<u4").tobytes()


def widened(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def told(answers: list | None, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, asked by no other chunk) in the order of the asked ``keys``."""
    out, sole = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    order, cuts = by_part(keys, parts)
    for r in answers if answers is not None else ():
        at = order[cuts[r["part"]] : cuts[r["part"] + 1]]
        out[at] = widened(r["counts"], len(at))
        sole[at] = np.unpackbits(np.frombuffer(r["sole"], dtype=np.uint8), count=len(at)).astype(bool)
    return out, sole


def known_pairs(c: Chunk, pair_at: np.ndarray, n_pairs: int, sole: np.ndarray) -> np.ndarray:
    """Pairs one of whose words is in no other chunk (each chunk has BEGIN)."""
    known = np.zeros(n_pairs, dtype=bool)
    known[pair_at] = sole[c.code] | (sole[c.prev] & (c.words[c.prev] != BEGIN))
    return known


def estimates(c2: np.ndarray, c1: np.ndarray, c: np.ndarray, n: float, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of pair and word, with counts lowered by ``less``."""
    context = np.maximum(c1 - less, 0)
    p2 = np.where(context > 0, np.maximum(c2 - less, 0) / np.maximum(context, 1), 0.0)
    return p2, np.maximum(c - less, 0) / max(1.0, n - less)


def bucket_of(c1: np.ndarray, buckets: int) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(np.maximum(c1, 0) + 1)).astype(np.int64), buckets - 1)


def expectation_maximisation(table: list[tuple[int, float, float, float]], vocabulary: int, p: Params) -> np.ndarray:
    """Weights (bucket, pair / word / uniform) from rows (bucket, p2, p1, tokens)."""
    weights = np.full((p.buckets, 3), 1 / 3)
    if not table:
        return weights
    rows = np.array(table)
    b, n = rows[:, 0].astype(np.int64), rows[:, 3]
    ps = np.stack([rows[:, 1], rows[:, 2], np.full(len(rows), 1 / (vocabulary + 1))], axis=1)
    for _ in range(p.iterations):
        mixed = weights[b] * ps
        share = n[:, None] * mixed / mixed.sum(axis=1, keepdims=True)
        for k in range(3):
            weights[:, k] = np.bincount(b, weights=share[:, k], minlength=p.buckets) + 1e-3
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def scores(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row of ``docs`` (doc_id, text).

    A null text is empty and has the end token only. Repeated rows count as
    often as they occur. If nothing is held in, the estimates are uniform.
    """
    p, spark = params, docs.sparkSession
    scratch = Scratch(spark, "lm")
    total_bytes = text_bytes(docs)
    chunks = max(1, -(-total_bytes // p.chunk_bytes))
    parts = parts_for(spark, 4 * total_bytes, 64 << 20)
    held = fold(F.col("doc_id"), p.folds) == 0
    rows = docs.select("doc_id", "text", held.alias("held"), F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(chunks)).cast("int").alias("chunk"))

    def ask_words(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Chunk.of(pdf["text"].tolist(), pdf["held"].to_numpy(dtype=bool))
        return ask(int(pdf["chunk"].iloc[0]), c.words, c.word_counts(), parts)

    kind = "part int, chunk int, counts binary, sole binary, distinct long"
    words = scratch.table(rows.groupBy("chunk").applyInPandas(ask_words, ASK).groupBy("part").applyInPandas(answer, kind), "words")
    scratch.release_shuffles()
    numbers = words.agg(F.sum("distinct")).first()
    vocabulary = int(numbers[0] or 0)

    def lists(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "sole")).alias(name))

    def of_chunk(pdf: pd.DataFrame, replies: pd.DataFrame) -> tuple[Chunk, np.ndarray, np.ndarray]:
        c = Chunk.of(pdf["text"].tolist(), pdf["held"].to_numpy(dtype=bool))
        return c, *told(replies["words"].iloc[0], c.words, parts)

    def ask_pairs(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["part", "chunk", "keys", "counts"])
        c, total, sole = of_chunk(pdf, replies)
        pair, at, count = c.pairs()
        wanted = ~known_pairs(c, at, len(pair), sole)
        return ask(int(pdf["chunk"].iloc[0]), pair[wanted], count[wanted], parts)

    by_chunk = lists(words, "words")
    pairs = rows.groupBy("chunk").cogroup(by_chunk.groupBy("chunk")).applyInPandas(ask_pairs, ASK)
    pairs = scratch.table(pairs.groupBy("part").applyInPandas(answer, kind), "pairs")
    scratch.release_shuffles()

    # counts of every token of every document, as arrays of unsigned 32-bit integers
    def token_counts(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["doc_id", "held", "n", "c2", "c"])
        c, total, sole = of_chunk(pdf, replies)
        pair, at, count = c.pairs()
        wanted = ~known_pairs(c, at, len(pair), sole)
        count = count.astype(np.int64)
        count[wanted] = told(replies["pairs"].iloc[0], pair[wanted], parts)[0]
        ends = np.flatnonzero(np.diff(c.doc)) + 1
        split = lambda x: [narrow(a) for a in np.split(x, ends)]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "held": pdf["held"], "n": np.bincount(c.doc), "c2": split(count[at]), "c": split(total[c.code])})

    both = by_chunk.join(lists(pairs, "pairs"), "chunk", "left")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(token_counts, f"doc_id {id_type}, held boolean, n long, c2 binary, c binary")
    counted = scratch.table(counted, "counts")
    scratch.drop(words, pairs)
    scratch.release_shuffles()

    totals = docs.where(~held).select(F.count(F.lit(1)).alias("docs")).first()
    n_docs = int(totals["docs"])
    n_tokens = int(counted.where("not held").select(F.sum("n")).first()[0] or 0)

    def unpack(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for n, c2, c in zip(*(batch.column(x).to_pylist() for x in ("n", "c2", "c")), strict=True):
            c2, c = widened(c2, n).astype(np.float64), widened(c, n).astype(np.float64)
            yield c2, np.append(float(n_docs), c[:-1]), c

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens by bucket and binned estimates, with their mean estimates."""
        size = p.bins + 1
        acc = np.zeros((3, p.buckets * size * size))
        for batch in batches:
            for c2, c1, c in unpack(batch):
                p2, p1 = estimates(c2, c1, c, float(n_tokens), 1)
                bin_ = lambda x: np.where(x > 0, np.clip(p.bins + np.floor(2 * np.log2(np.maximum(x, 1e-300))), 1, p.bins), 0).astype(np.int64)
                cell = (bucket_of(c1 - 1, p.buckets) * size + bin_(p2)) * size + bin_(p1)
                for k, w in enumerate((None, p2, p1)):
                    acc[k] += np.bincount(cell, weights=w, minlength=acc.shape[1])
        full = np.flatnonzero(acc[0])
        yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(acc[k][full]) for k in range(3))], ["cell", "n", "s2", "s1"])

    cells = counted.where("not held").select("n", "c2", "c").mapInArrow(deleted, "cell long, n double, s2 double, s1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1"))
    size = p.bins + 1
    table = [(r.cell // (size * size), r.s2 / r.n, r.s1 / r.n, r.n) for r in cells.orderBy("cell").collect()]  # at most buckets * 49 * 49 rows
    weights = expectation_maximisation(table, vocabulary, p)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c2, c1, c in unpack(batch):
                p2, p1 = estimates(c2, c1, c, float(n_tokens))
                w = weights[bucket_of(c1, p.buckets)]
                model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (vocabulary + 1)).sum()
                base = np.log10((c + p.alpha) / (n_tokens + p.alpha * (vocabulary + 1))).sum()
                out.append((len(c), int((c > 0).sum()), n_tokens, float(base), float(model)))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
