"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles. A run starts with all sets in one
node; a node is split by sampled tokens: set ``x`` follows token ``j`` if
``hash(node, j) < 1 / (similarity * |x|)``, so two similar sets share a child
with an expected number of at least one. Nodes of at most ``leaf_rows`` sets
are compared by brute force, larger ones are split again up to ``max_depth``.
``runs`` is chosen so that a pair at the threshold is missed with a
probability of at most ``1 - recall``.

One pass over the texts writes the nodes of all depths of each set, and a
sketch: the counts of its shingles by bins of their hash. Sets never leave
this pass; the brute force in a leaf starts on sizes and sketches alone. The
sum of the bins' minima bounds the intersection from above, so a pair is
discarded only where it is provably below the threshold. What is left in a
leaf falls into connected cells. A cell found in several leaves counts once;
only then the sets of the cells' members are fetched, once a cell, and every
pair is verified by the exact Jaccard similarity. A pair that shares several
cells is counted in the least of them, so links are counted without ever
writing a pair.

A leaf that is still too large at the last depth is cut by size, and compared
in pairs of blocks of at most ``block_rows`` sets and ``block_bytes``.

Identical texts are joined once. Their key is their least doc_id; if that
doc_id names several texts, all but one of these have keys from their hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramforge.llm.common import Scratch, parts_for
from paramforge.llm.components import components
from paramforge.llm.shingles import WordHashes, mix, word_shingles

HAS_WORD = r"[^ \t-\r]"


@dataclass(frozen=True)
class Params:
    similarity: float = 0.8
    width: int = 5  # words of a shingle
    recall: float = 0.999  # of pairs at the threshold, after all runs
    max_depth: int = 3
    leaf_rows: int = 200
    block_rows: int = 2_500
    block_bytes: int = 32 << 20  # of the sets of a block

    def runs(self) -> int:
        """A pair at the threshold shares Poisson(1) children of each node
        they share, so it is lost by depth d with miss(d) = exp(miss(d-1) - 1)."""
        miss = 0.0
        for _ in range(self.max_depth):
            miss = math.exp(miss - 1)
        return math.ceil(math.log(1 - self.recall) / math.log(miss))


def children(s: np.ndarray, nodes: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(children of the set ``s`` in ``nodes``, place of the parent of each)."""
    found, parents, step = [], [], max(1, (1 << 20) // max(1, len(s)))
    for lo in range(0, len(nodes), step):
        some = nodes[lo : lo + step, None]
        row, col = np.nonzero(mix(s[None, :] ^ some) <= limit)
        found.append(mix(s[col] + some[row, 0] * np.uint64(0xD6E8FEB86659FD93)))
        parents.append(row + lo)
    return (np.concatenate(found), np.concatenate(parents)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Counts by bins of the hash, four to eight shingles a bin, up to 255."""
    bits = max(0, (len(s) - 1).bit_length() - 3)
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


LEVELS = ", ".join(f"n{d} array<long>, p{d} array<int>" for d in range(1, 9))


def paths(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """doc, sha, size, sketch, and for each depth d the nodes (nd) of the set
    and the place of their parents among those of the depth before (pd)."""
    roots = mix(np.arange(1, p.runs() + 1, dtype=np.uint64))
    hashes = WordHashes()
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            batch, rows = whole.slice(lo, 1000), []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = word_shingles(text, hashes, p.width)
                limit = np.uint64(min(2**64 - 1, int(2**64 / max(1.0, p.similarity * len(s)))))
                row, nodes = {"doc": doc, "sha": hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), "size": len(s), "sketch": sketch(s)}, roots
                for d in range(1, p.max_depth + 1):
                    nodes, parents = children(s, nodes, limit)
                    row |= {f"n{d}": nodes.view(np.int64), f"p{d}": parents.astype(np.int32)}
                rows.append(row)
            kinds = [("doc", pa.int64()), ("sha", pa.binary()), ("size", pa.int64()), ("sketch", pa.binary())]
            for d in range(1, p.max_depth + 1):
                kinds += [(f"n{d}", pa.list_(pa.int64())), (f"p{d}", pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def bounds(sizes: np.ndarray, sketches: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that sizes and sketches do not rule out. Two sets whose
    sizes allow the similarity differ by one doubling of bins at most."""
    bins = np.array([len(x) for x in sketches])
    left, right = [], []
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        twice = np.flatnonzero(bins == 2 * b)
        flat = np.frombuffer(b"".join([sketches[k] for k in own]), dtype=np.uint8).reshape(len(own), b).astype(np.uint16)
        more = np.frombuffer(b"".join([sketches[k] for k in twice]), dtype=np.uint8).reshape(len(twice), b, 2).astype(np.uint16)
        full = np.concatenate([(flat == 255).any(axis=1), (more == 255).any(axis=(1, 2))])
        table = np.concatenate([flat, more.sum(axis=2, dtype=np.uint16)])
        ids = np.concatenate([own, twice])
        size = sizes[ids]
        for k in range(len(own)):
            rest = slice(k + 1, None)
            least = np.minimum(size[k], size[rest])
            fits = np.flatnonzero(least >= similarity * np.maximum(size[k], size[rest]) - 1e-9) + k + 1
            if not len(fits):
                continue
            shared = np.minimum(table[k], table[fits]).sum(axis=1, dtype=np.int64)
            shared = np.where(full[fits] | full[k], np.minimum(size[k], size[fits]), shared)
            near = fits[shared >= similarity * (size[k] + size[fits] - shared) - 1e-9]
            left.append(np.full(len(near), ids[k]))
            right.append(ids[near])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of the component of each of ``n``."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def cells(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leaf, i, j) -> (cell, key): the connected members of
    each run that may be similar; a cell is named by its members."""
    schema = pa.schema([("cell", pa.int64()), ("key", pa.int64())])
    now, rows = None, []

    def flush():
        if len(rows) < 2:
            return None
        keys = np.array([r[0] for r in rows], dtype=np.int64)
        root = joined(len(keys), *bounds(np.array([r[1] for r in rows], dtype=np.int64), [r[2] for r in rows], similarity))
        member = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        if not len(member):
            return None
        total, count = np.zeros(len(root), np.uint64), np.bincount(root, minlength=len(root)).astype(np.uint64)
        np.add.at(total, root, mix(keys.view(np.uint64) + np.uint64(1)))
        name = mix(total + count * np.uint64(0x9E3779B97F4A7C15))[root[member]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(keys[member])], schema=schema)

    for batch in batches:
        for leaf, i, j, *row in zip(*[batch.column(c).to_pylist() for c in ("leaf", "i", "j", "key", "size", "sketch")], strict=True):
            if (leaf, i, j) != now:
                if (out := flush()) is not None:
                    yield out
                now, rows = (leaf, i, j), []
            rows.append(row)
    if (out := flush()) is not None:
        yield out


def with_shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            batch = whole.slice(lo, 1000)
            sets = [word_shingles(t, hashes, width).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("cells"), pa.array(sets, pa.binary())], ["key", "cells", "set"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, in slabs of columns to bound memory."""
    m = len(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    ids, code = np.unique(code[shared], return_inverse=True)
    rows, out = rows[shared], np.zeros((m, m), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, rows = code[order], rows[order]
    for lo in range(0, len(ids), 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        slab = np.zeros((m, min(4096, len(ids) - lo)), dtype=np.float32)
        slab[rows[a:b], code[a:b] - lo] = 1
        out += slab @ slab.T
    return out


def compare(cell: int, keys: np.ndarray, sets: list[np.ndarray], cells: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that belong to this cell, and the least member reached, of each row."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    inter = overlaps(sets).astype(np.float64)
    similar = inter >= similarity * (sizes[:, None] + sizes[None, :] - inter) - 1e-9
    np.fill_diagonal(similar, False)
    mine = similar
    if similar.any():
        earlier = [x[x < cell] for x in cells]
        if sum(map(len, earlier)):
            mine = similar & (overlaps(earlier) == 0)
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    i, j = np.nonzero(similar)
    return mine.sum(axis=1), keys[order][joined(len(keys), rank[i], rank[j])[rank]]


def brute_force(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: compares each run of equal cells."""
    schema = pa.schema([("key", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    now, rows = None, []

    def flush():
        if len(rows) < 2:
            return None
        keys = np.array([r[0] for r in rows], dtype=np.int64)
        links, root = compare(now, keys, [np.frombuffer(r[1], dtype=np.uint64) for r in rows], [np.array(r[2], dtype=np.int64) for r in rows], similarity)
        hit = (links > 0) | (root != keys)
        return pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], schema=schema) if hit.any() else None

    for batch in batches:
        for cell, *row in zip(*[batch.column(c).to_pylist() for c in ("cell", "key", "set", "cells")], strict=True):
            if cell != now:
                if (out := flush()) is not None:
                    yield out
                now, rows = cell, []
            rows.append(row)
    if (out := flush()) is not None:
        yield out


def leaves_of(sets: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """(leaf, key, size, n, total): the nodes at which sets are compared, of
    all runs, with their number of sets and of shingles. Leaves with the same
    members hold the same pairs: one of them stays."""
    out, hot = None, None
    for d in range(1, p.max_depth + 1):
        if d == 1:
            level = sets.select("key", "size", F.explode("n1").alias("leaf"))
        else:
            level = sets.select("key", "size", f"n{d - 1}", F.explode(F.arrays_zip(f"n{d}", f"p{d}")).alias("e"))
            level = level.select("key", "size", F.col(f"e.n{d}").alias("leaf"), F.element_at(f"n{d - 1}", F.col(f"e.p{d}") + 1).alias("hot")).join(hot, "hot", "left_semi")
        level = scratch.table(level.select("leaf", "key", "size"), "nodes")
        sizes = scratch.table(level.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.sum(F.shiftright(F.xxhash64("key"), 20)).alias("x1"), F.sum(F.shiftright(F.xxhash64("key", F.lit(7)), 20)).alias("x2")).where("n > 1"), "sizes")
        # the deeper nodes of a small node hold no further pairs
        done = sizes if d == p.max_depth else sizes.where(F.col("n") <= p.leaf_rows)
        one = done.groupBy("n", "total", "x1", "x2").agg(F.min("leaf").alias("leaf")).select("leaf", "n", "total")
        found = level.join(one, "leaf")
        out = found if out is None else out.unionByName(found)
        hot = sizes.where(F.col("n") > p.leaf_rows).select(F.col("leaf").alias("hot"))
        if d == p.max_depth or not hot.limit(1).count():
            return out


def compared_by(leaves: DataFrame, p: Params) -> DataFrame:
    """(leaf, i, j, key): what is compared together. Large leaves are cut by
    size steps of the similarity (a set goes to its own and the next step,
    so similar sets meet), and the steps into pairs of blocks."""
    large = (F.col("n") > p.block_rows) | (F.col("total") * 8 > p.block_bytes)
    small = leaves.where(~large).select("leaf", F.lit(0).alias("i"), F.lit(0).alias("j"), "key")
    step = F.floor(F.log("size") / F.lit(-math.log(p.similarity) * (1 + 1e-9)))
    cut = leaves.where(large).select("key", "size", F.explode(F.array(F.xxhash64("leaf", step), F.xxhash64("leaf", step + 1))).alias("leaf"))
    counts = cut.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1")
    nb = F.greatest(F.ceil(F.col("n") / p.block_rows), F.ceil(F.col("total") * 8 / p.block_bytes)).cast("int")
    each = cut.join(counts.select("leaf", nb.alias("nb")), "leaf").withColumn("block", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return small.unionByName(each.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key"))


@dataclass
class Classes:
    """``rows``: doc, sha, key of the input's rows (key null: links to
    nothing); ``links``: key, n_links; ``roots``: key, root (least key of the
    class, for keys above it); ``reps``: key, rep (least doc_id of the text)."""

    rows: DataFrame
    links: DataFrame
    roots: DataFrame
    reps: DataFrame


def sha(text: str = "text"):
    return F.unhex(F.sha2(text, 256))


def classes(docs: DataFrame, p: Params) -> Classes:
    spark = docs.sparkSession
    scratch = Scratch(spark, "chosen-path")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    texts = docs.where(F.col("text").rlike(HAS_WORD) & F.col("doc").isNotNull())
    ids = scratch.table(texts.select("doc", sha().alias("sha")), "ids")
    least = ids.groupBy("sha").agg(F.min("doc").alias("rep"))
    # a doc_id that names several texts: one of them keeps it as its key
    first = least.groupBy("rep").agg(F.min("sha").alias("first"))
    hashed = -1 - F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long")
    reps = scratch.table(least.join(first, "rep").select("sha", "rep", F.when(F.col("sha") == F.col("first"), F.col("rep")).otherwise(hashed).alias("key")), "reps")

    schema = "doc long, sha binary, size long, sketch binary, " + ", ".join(LEVELS.split(", ")[: 2 * p.max_depth])
    sets = texts.mapInArrow(lambda it: paths(it, p), schema).join(reps.withColumnRenamed("rep", "doc").hint("merge"), ["doc", "sha"]).dropDuplicates(["key"]).drop("doc", "sha")
    sets = scratch.table(sets, "sets")
    groups = compared_by(scratch.table(leaves_of(sets, p, scratch), "leaves"), p)
    groups = groups.join(sets.select("key", "size", "sketch").hint("merge"), "key")
    parts = parts_for(spark, 0)
    found = groups.repartition(parts, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(lambda it: cells(it, p.similarity), "cell long, key long")
    by_key = scratch.table(found.groupBy("key").agg(F.sort_array(F.collect_set("cell")).alias("cells")), "cells")
    scratch.drop(sets)

    wanted = by_key.join(reps, "key").withColumnRenamed("rep", "doc")
    full = texts.withColumn("sha", sha()).join(wanted.hint("merge"), ["doc", "sha"]).dropDuplicates(["key"]).select("key", "cells", "text")
    full = full.mapInArrow(lambda it: with_shingles(it, p.width), "key long, cells array<long>, set binary")
    full = full.select("key", "set", "cells", F.explode("cells").alias("cell")).repartition(parts, "cell").sortWithinPartitions("cell", "key")
    links = scratch.table(full.mapInArrow(lambda it: brute_force(it, p.similarity), "key long, links long, root long"), "found")
    roots = components(links.select(F.col("key").alias("u"), F.col("root").alias("v")), scratch).withColumnRenamed("u", "key")
    rows = docs.select("doc", F.when(F.col("text").rlike(HAS_WORD) & F.col("doc").isNotNull(), sha()).alias("sha")).join(reps.drop("rep"), "sha", "left")
    return Classes(rows, links.groupBy("key").agg(F.sum("links").alias("n_links")), roots, reps.select("key", "rep"))


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, class_id, copy_of, n_links for every row of ``docs`` (doc_id, text).

    ``copy_of``: least doc_id with the same text. ``n_links``: number of
    different texts whose similarity to this one reaches the threshold.
    ``class_id``: least doc_id of the connected component. Texts without a
    word, and rows without a doc_id, link to nothing; a text without a word
    is its own class. Repeated rows repeat their result; a doc_id with
    several texts has the result of each.
    """
    c = classes(docs, params)
    # a class is named by its least key, unless that is negative (a hash)
    odd = c.roots.where("root < 0")
    members = odd.unionByName(odd.select(F.col("root").alias("key"), "root").distinct()).join(c.reps, "key")
    least = members.groupBy("root").agg(F.min("rep").alias("least"))
    out = c.rows.join(c.links, "key", "left").join(c.roots, "key", "left").join(c.reps, "key", "left")
    out = out.withColumn("root", F.coalesce("root", "key")).join(least, "root", "left")
    name = F.coalesce("least", F.when(F.col("root") >= 0, F.col("root")), "rep", "doc")
    return out.select(F.col("doc").alias("doc_id"), name.alias("class_id"), F.coalesce("rep", "doc").alias("copy_of"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, sha): the text that stands for each class, of those with a
    word and a doc_id: that of the least key, under its least doc_id."""
    c = classes(docs, params)
    kept = c.rows.where("key is not null").join(c.reps, "key").where("doc = rep").join(c.roots.select("key"), "key", "left_anti")
    return kept.select(F.col("doc").alias("doc_id"), "sha").distinct()
