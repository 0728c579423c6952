"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the
last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramforge.llm import chosen_path, piece_viterbi, robust_quality, simhash_decontam, suffix_dedup
from paramforge.llm.common import Scratch, nested
from paramforge.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return robust_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least
    doc_id, once. Rows without a doc_id or a word stay. A doc_id that names
    several texts is several documents."""
    keep = chosen_path.representatives(docs).withColumnsRenamed({"doc_id": "_keep", "sha": "_sha"})
    rows = nested(docs, "doc_id", "text").withColumn("sha", chosen_path.sha())
    linked = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").rlike(chosen_path.HAS_WORD), F.lit(False))
    kept = rows.where(linked).join(keep, (F.col("doc_id") == F.col("_keep")) & (F.col("sha") == F.col("_sha")), "left_semi").dropDuplicates(["doc_id", "sha"])
    return kept.unionByName(rows.where(~linked)).select("_doc.*")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document holds are cut out."""
    return suffix_dedup.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return simhash_decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the check that they decode to it."""
    return piece_viterbi.pieces_of(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", pieces),
]

#: None: the robust quality rules and the search for pieces are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``, whole."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage{k + 1}")
    return docs
