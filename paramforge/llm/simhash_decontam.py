"""Benchmark decontamination by SimHash windows (DataFrame functions only).

A document window of as many words as a benchmark item gets a 64-bit SimHash
of its weighted five-word shingles; so does the item. The fingerprint is cut
into ``radius + 1`` blocks: two fingerprints within ``radius`` bits agree in
at least one block, so joining on (item size, block number, block value)
finds all of them. Candidates within the radius are then verified by the
exact weighted Jaccard similarity of the shingles.

Windows are laid wherever they can reach the similarity at all. That takes
shingles in common of at least ``similarity`` times the item's weight, so a
document and an item are paired if the whole document holds as much, and of
the windows that hold a common shingle, at any place in it, those are laid
that do. This is an equi-join of all shingles of all documents, exact and
without a limit. A document with fewer words than an item is one window.

Weights are ``1 + round(4 * ln(items / items with the shingle))``: shingles
that many items share count little; a shingle in no item counts like one in
a single item. Words are lower-cased.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramforge.llm.common import Scratch, nested


@dataclass(frozen=True)
class Params:
    width: int = 5
    similarity: float = 0.8
    radius: int = 20  # of 64 bits; at similarity 0.8 the distance is 9.7 +- 2.9
    broadcast_bytes: int = 64 << 20  # item shingles up to this size are broadcast


def words(text: str) -> Column:
    """Lower-case words; null or empty text: none."""
    w = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t-\r]+")
    return F.filter(w, lambda x: x != "")


def shingle(w: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.slice(w, at + 1, width))


def shingles(w: Column, width: int) -> Column:
    """Hashes of all shingles in order; of fewer words, one of all of them."""
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: shingle(w, i, width))
    return F.when(n > 0, many).otherwise(F.array().cast("array<bigint>"))


def fingerprints(rows: DataFrame, keys: list[str], weights: DataFrame, unseen: int) -> DataFrame:
    """``keys``, ``simhash``, ``total``: of (keys, h, n) with multiplicity n.
    Two 32-bit counters share a long, so 32 sums give the 64 bits."""
    lane = F.lit(0x0000000100000001)
    weighted = rows.join(weights, "h", "left").withColumn("w", F.coalesce("weight", F.lit(unseen)).cast("long") * F.col("n"))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(lane) * F.col("w")).alias(f"c{k}") for k in range(32)]
    grouped = weighted.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)
    bits = F.lit(0).cast("long")
    for k in range(32):
        for shift, count in ((k, F.col(f"c{k}").bitwiseAND(F.lit(0xFFFFFFFF))), (k + 32, F.shiftrightunsigned(f"c{k}", 32))):
            bits = bits.bitwiseOR(F.when(2 * count > F.col("total"), F.shiftleft(F.lit(1).cast("long"), shift)).otherwise(F.lit(0).cast("long")))
    return grouped.select(*keys, "total", bits.alias("simhash"))


def blocks(simhash: Column, radius: int) -> Column:
    """(number, value) of the radius + 1 blocks that cover the 64 bits."""
    n, out, at = radius + 1, [], 0
    for k in range(n):
        size = 64 // n + (k < 64 % n)
        out.append(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(simhash, at).bitwiseAND(F.lit((1 << size) - 1)).alias("value")))
        at += size
    return F.explode(F.array(*out))


def item_shingles(items: DataFrame, p: Params, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(item, n_words, q, h) of every item with a word; (h, weight)."""
    w = items.select(F.col("item_id").alias("item"), words("text").alias("w")).where("size(w) > 0 and item is not null").dropDuplicates(["item"])
    rows = scratch.table(w.select("item", F.size("w").alias("n_words"), F.posexplode(shingles(F.col("w"), p.width)).alias("q", "h")), "items")
    count = rows.select("item").distinct().count()
    df = rows.groupBy("h").agg(F.countDistinct("item").alias("df"))
    weights = df.select("h", (F.lit(1) + F.round(4 * F.log(F.lit(float(max(1, count))) / F.col("df")))).cast("int").alias("weight"))
    return rows, scratch.table(weights, "weights")


def matches(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: the best
    window (most similar, then first) of each document and item that reaches
    the similarity. ``n_words`` are the item's; a window ends with its text.

    Documents (doc_id, text) and items (item_id, text) without an id or a
    word match nothing; an item of fewer than five words is one shingle of
    all of them. Repeated item ids count once, repeated documents too.
    """
    p, scratch = params, Scratch(docs.sparkSession, "simhash")
    item_rows, weights = item_shingles(items, p, scratch)
    n_items = item_rows.select("item").distinct().count()
    unseen = 1 + round(4 * math.log(max(1, n_items)))
    texts = docs.select(F.col("doc_id").alias("doc"), "text").where("doc is not null and text is not null")

    # windows: one word count per shingle width, so short items get their own
    widths = [r[0] for r in item_rows.select(F.least("n_words", F.lit(p.width)).alias("k")).distinct().collect()]  # at most `width` values
    hits = None
    w = texts.select("doc", words("text").alias("w"))
    for k in sorted(widths):
        of_width = item_rows.where(F.least("n_words", F.lit(p.width)) == k)
        keys = of_width.select("h").distinct()
        size = keys.count() * 16
        found = w.where(F.size("w") >= k).select("doc", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), k)).alias("at", "h"))
        found = found.join(F.broadcast(keys) if size <= p.broadcast_bytes else keys, "h", "left_semi")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word int, n_words int, hamming int, similarity double")
    hits = scratch.table(hits, "hits")
    item_grams = item_rows.groupBy("item", "n_words", "h").agg(F.count(F.lit(1)).alias("n"))
    known = item_grams.withColumnRenamed("n", "m").join(weights, "h")
    least = known.groupBy("item").agg((F.lit(p.similarity) * F.sum(F.col("weight") * F.col("m")) - F.lit(1e-6)).alias("need"))
    known = scratch.table(known.join(least, "item"), "known")
    common = F.sum(F.col("weight") * F.least("n", "m"))

    # pairs of document and item, then their windows, that share enough weight
    in_doc = hits.groupBy("doc", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    pairs = in_doc.join(known, "h").groupBy("doc", "size", "item", "need").agg(common.alias("common")).where("common >= need")
    pairs = scratch.table(pairs.select("doc", "size", "item"), "pairs")
    length = F.least("n_words", "size")  # of the window
    first = F.greatest(F.lit(0), F.col("at") - length + F.least("n_words", F.lit(p.width)))
    starts = F.sequence(first, F.least(F.col("at"), F.col("size") - length))
    placed = hits.join(known, "h").join(pairs, ["doc", "size", "item"]).withColumn("start", F.explode(starts))
    placed = placed.groupBy("doc", "start", "n_words", "item", "need", "h", "weight", "m").agg(F.count(F.lit(1)).alias("n"))
    laid = placed.groupBy("doc", "start", "n_words", "item", "need").agg(common.alias("common")).where("common >= need")
    windows = scratch.table(laid.select("doc", "start", "n_words").distinct(), "windows")

    # shingles of the windows, cut out of the texts again
    by_doc = windows.groupBy("doc").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    cut = texts.dropDuplicates(["doc"]).join(by_doc, "doc").select("doc", words("text").alias("w"), "spans")
    cut = cut.select("doc", F.explode(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["n_words"].alias("n_words"), F.slice(F.col("w"), s["start"] + 1, s["n_words"]).alias("w")))).alias("s")).select("doc", "s.*")
    grams = cut.select("doc", "start", "n_words", F.explode(shingles(F.col("w"), p.width)).alias("h")).groupBy("doc", "start", "n_words", "h").agg(F.count(F.lit(1)).alias("n"))
    grams = scratch.table(grams, "grams")

    left = fingerprints(grams, ["doc", "start", "n_words"], weights, unseen)
    right = fingerprints(item_grams, ["item", "n_words"], weights, unseen).withColumnsRenamed({"simhash": "item_hash", "total": "item_total"})
    left = left.select("*", blocks(F.col("simhash"), p.radius).alias("b")).select("doc", "start", "n_words", "simhash", "total", "b.*")
    right = right.select("*", blocks(F.col("item_hash"), p.radius).alias("b")).select("item", "n_words", "item_hash", "item_total", "b.*")
    near = left.join(right, ["n_words", "block", "value"]).withColumn("hamming", F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_hash")))).where(F.col("hamming") <= p.radius)
    near = near.select("doc", "start", "n_words", "item", "hamming", "total", "item_total").distinct()

    weight = F.coalesce("weight", F.lit(unseen))
    both = near.join(grams, ["doc", "start", "n_words"]).join(item_grams.select("item", "h", F.col("n").alias("m")), ["item", "h"]).join(weights, "h", "left")
    sums = both.groupBy("doc", "start", "n_words", "item", "hamming", "total", "item_total").agg(F.sum(weight * F.least("n", "m")).alias("common"))
    similarity = F.col("common") / (F.col("total") + F.col("item_total") - F.col("common"))
    exact = sums.withColumn("similarity", similarity).where(F.col("similarity") >= p.similarity)
    best = exact.groupBy("doc", "item").agg(F.max_by(F.struct("start", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("b.start").alias("start_word"), "b.n_words", "b.hamming", F.round("b.similarity", 6).alias("similarity"))


def without_leaks(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no match (null ids stay)."""
    leaked = matches(docs, items, params).select(F.col("doc_id").alias("_leak")).distinct()
    rows = nested(docs, "doc_id")
    return rows.join(leaked, F.col("doc_id") == F.col("_leak"), "left_anti").select("_doc.*")
