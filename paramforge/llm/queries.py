"""The registered queries of this subpackage: one per operator over its
whole table with production parameters, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramforge.llm import chosen_path, conversation_repair, interpolated_lm, license_alignment, packing, piece_viterbi, robust_quality, rule_classifier, simhash_decontam, suffix_dedup, temporal_urls, token_store, tokenizer_alignment


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = robust_quality.quality_report(_table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 6).alias("distance2"), F.round("distance_limit", 6).alias("distance_limit"))


def op2_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_alignment.licences(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_report(_table(spark, sf_dir, "documents"))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_viterbi.pieces_of(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_simhash_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_classifier.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_temporal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched over a year (day ``37 * page_id mod 365``) against lists
    derived from their hosts: hosts of spam come, go and come again, some
    hosts and some first path steps are listed for a while."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int").alias("at"))
    hosts = pages.select(temporal_urls.host(F.col("url")).alias("h"), F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^/?#]+)", 1).alias("step")).where("h <> ''")
    spam = hosts.select("h").distinct().where("h like '%spam%' or h like '%pills%' or h like '%casino%'").selectExpr("'spam' as list", "'domain' as kind", "h as key", "explode(array(struct('add' as action, 30 as at), struct('remove' as action, 200 as at), struct('add' as action, 260 as at))) as e")
    ads = hosts.select("h").distinct().where("length(h) % 5 = 0").selectExpr("'ads' as list", "'domain' as kind", "substring_index(h, '.', -3) as key", "explode(array(struct('add' as action, length(h) * 7 % 200 as at), struct('remove' as action, length(h) * 7 % 200 + 60 as at))) as e")
    paths = hosts.where("step <> '' and length(h) % 3 = 0").distinct().selectExpr("'paths' as list", "'prefix' as kind", "concat(h, '/', step) as key", "explode(array(struct('add' as action, 100 as at), struct('remove' as action, 160 + length(step) as at))) as e")
    entries = spam.union(ads).union(paths).select("list", "kind", "key", "e.action", "e.at")
    return temporal_urls.judge(pages, entries).withColumnRenamed("at", "fetch_day")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url, CAST((page_id * 37) % 365 AS INT) AS d,
    lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h,
    regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1) AS step,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS steps
  FROM pages),
e AS (
  SELECT 'spam' AS list, 'domain' AS kind, h AS key, a.action, a.d FROM (SELECT DISTINCT h FROM p WHERE h LIKE '%spam%' OR h LIKE '%pills%' OR h LIKE '%casino%'),
    (VALUES ('add', 30), ('remove', 200), ('add', 260)) AS a(action, d)
  UNION ALL
  SELECT 'ads', 'domain', array_to_string(string_split(h, '.')[-3:], '.'), a.action, length(h) * 7 % 200 + a.more FROM (SELECT DISTINCT h FROM p WHERE h <> '' AND length(h) % 5 = 0),
    (VALUES ('add', 0), ('remove', 60)) AS a(action, more)
  UNION ALL
  SELECT 'paths', 'prefix', h || '/' || step, a.action, CASE a.action WHEN 'add' THEN 100 ELSE 160 + length(step) END FROM (SELECT DISTINCT h, step FROM p WHERE h <> '' AND step <> '' AND length(h) % 3 = 0),
    (VALUES ('add'), ('remove')) AS a(action)),
one AS (SELECT list, kind, key, d, bool_or(action = 'remove') AS removed FROM e GROUP BY ALL),
iv AS (SELECT *, lead(d) OVER (PARTITION BY list, kind, key ORDER BY d) AS until FROM one),
k AS (
  SELECT page_id, d, 'domain' AS kind, array_to_string(string_split(h, '.')[i:], '.') AS key FROM p, range(1, 50) AS r(i) WHERE h <> '' AND i <= len(string_split(h, '.'))
  UNION
  SELECT page_id, d, 'prefix', h || '/' || array_to_string(steps[1:i], '/') FROM p, range(1, 200) AS r(i) WHERE h <> '' AND i <= len(steps)),
f AS (SELECT k.page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n FROM k JOIN iv ON k.kind = iv.kind AND k.key = iv.key AND NOT removed AND k.d >= iv.d AND (until IS NULL OR k.d < until) GROUP BY 1)
SELECT p.page_id, p.d AS fetch_day, lists IS NOT NULL AS blocked, coalesce(lists, '') AS lists, coalesce(n, 0) AS n_active FROM p LEFT JOIN f USING (page_id)
"""


def op9_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.scores(_table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_report(_table(spark, sf_dir, "documents"), token_store.Params(tokenizer_path("byte_bpe_50k.json")))


def op11_tokenizer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment.alignment_report(_table(spark, sf_dir, "documents"), tokenizer_alignment.Params(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")))


def op12_suffix_dawg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_report(_table(spark, sf_dir, "conversations"))


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), packing.Params(tokenizer_path("word_bpe_49k.json")))
    length = (F.octet_length("ids") / 4).cast("long")
    return pieces.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padding")


QUERIES = {
    "op1_robust_quality": op1_robust_quality,
    "op2_license_alignment": op2_license_alignment,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_chosen_path": op4_chosen_path,
    "op5_piece_viterbi": op5_piece_viterbi,
    "op6_simhash_decontam": op6_simhash_decontam,
    "op7_rule_classifier": op7_rule_classifier,
    "op8_temporal_urls": op8_temporal_urls,
    "op9_interpolated_lm": op9_interpolated_lm,
    "op10_token_store": op10_token_store,
    "op11_tokenizer_spans": op11_tokenizer_spans,
    "op12_suffix_dawg": op12_suffix_dawg,
    "op13_window_packing": op13_window_packing,
}

ORACLE: dict[str, str] = {"op8_temporal_urls": OP8_SQL}
