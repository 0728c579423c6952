"""The stages of the original scripts, chained over files.

``structure_stage``  TEI folder -> structured papers + table cells + status
                     report + the extraction request table.
``clean_stage``      extraction-file folder -> clean table -> method-filtered
                     table (parquet, and CSV like the original hand-off) +
                     the filter report.
``collection_stage`` final table -> collection (one item per paper id, with
                     a vector), written once.
``dashboard``        final table + alias table -> consensus, substrate
                     table and family histograms (all families at once).

Every stage is one or a few Spark jobs writing parquet; nothing passes
through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.vectors import letter_profile
from ..operators import clean as C
from ..operators import extract as X
from ..operators import stats as S
from ..operators import tei as TEI
from ..sources import files as FS


def structure_stage(spark: SparkSession, xml_dir: str, out_dir: str) -> dict[str, DataFrame]:
    """Stage 1 (+ the request side of stage 2)."""
    parsed = TEI.structure_tei(FS.read_xml_dir(spark, xml_dir))
    parsed.write.mode("overwrite").parquet(os.path.join(out_dir, "parsed"))
    parsed = spark.read.parquet(os.path.join(out_dir, "parsed"))  # parse once
    ok = parsed.filter("ok")
    FS.write_structured(ok, os.path.join(out_dir, "structured"))
    TEI.tei_cells(parsed).write.mode("overwrite").parquet(os.path.join(out_dir, "tables"))
    requests = ok.select("paper_id", X.combined_text(ok).alias("combined_text")).filter(
        X.length_gate("combined_text")).select("paper_id", X.request_text("combined_text").alias("request"))
    requests.write.mode("overwrite").parquet(os.path.join(out_dir, "requests"))
    return {"report": TEI.tei_report(parsed), "requests": spark.read.parquet(os.path.join(out_dir, "requests"))}


def clean_stage(spark: SparkSession, extraction_dir: str, out_dir: str,
                keywords: list[str] = K.METHOD_KEYWORDS) -> dict[str, DataFrame]:
    """Stages 3 and 4."""
    raw = FS.read_extraction_files(spark, extraction_dir)
    C.papers_clean(raw).write.mode("overwrite").parquet(os.path.join(out_dir, "papers_clean"))
    clean = spark.read.parquet(os.path.join(out_dir, "papers_clean"))
    final = C.method_filter(clean, keywords)
    final.write.mode("overwrite").parquet(os.path.join(out_dir, "papers_final"))
    FS.write_csv(final, os.path.join(out_dir, "papers_final_csv"))
    return {
        "files": FS.extraction_file_report(spark, extraction_dir),
        "filter": C.filter_report(clean, keywords),
        "final": spark.read.parquet(os.path.join(out_dir, "papers_final")),
    }


def collection_stage(spark: SparkSession, final: DataFrame, out_dir: str) -> DataFrame:
    """Stage 5: the collection with one item per paper id and its vector."""
    items = C.collection_dedup(C.collection_rows(final)).withColumn("vec", letter_profile("document"))
    path = os.path.join(out_dir, "collection")
    FS.write_collection(items, path)
    return FS.open_collection(spark, path)


def dashboard(spark: SparkSession, final: DataFrame, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """Stage 6, macro view: every family's statistics in one pass each."""
    aliases = aliases if aliases is not None else S.alias_table(spark)
    fam = S.family_rows(C.scalar_view(final), aliases)
    return {
        "consensus": S.consensus(fam),
        "display": S.consensus_display(S.consensus(fam)),
        "substrates": S.substrate_table(S.substrate_counts(fam)),
        "histograms": S.family_histogram(fam),
        "quartiles": S.box_quartiles(fam),
        "counts": S.family_count(fam, final),
    }


def family_filter_by_name(final: DataFrame, spark: SparkSession, family: str, names: list[str]) -> DataFrame:
    """A single family from an explicit name list (a parsed model reply)."""
    aliases = spark.createDataFrame([(family, n) for n in names], "family string, material string")
    return S.family_filter(final, aliases).withColumn("family", F.lit(family))


def main(argv: list[str] | None = None) -> None:
    """Command line: run the stages over folders with the cluster's session.

    python -m paramforge.plans.stages --tei DIR --extracted DIR --out DIR
    """
    import argparse

    ap = argparse.ArgumentParser(description="Run the structuring, cleaning, collection and dashboard stages.")
    ap.add_argument("--tei", help="folder of TEI *.xml files (stage 1)")
    ap.add_argument("--extracted", help="folder of *_extracted.json files (stages 3-6)")
    ap.add_argument("--out", required=True, help="output folder (parquet / CSV)")
    ap.add_argument("--corrected-keywords", action="store_true",
                    help="method filter with the comma restored (keeps plain 'magnetron')")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("paramforge-stages").getOrCreate()
    if args.tei:
        s1 = structure_stage(spark, args.tei, args.out)
        s1["report"].show()
    if args.extracted:
        kw = K.METHOD_KEYWORDS_CORRECTED if args.corrected_keywords else K.METHOD_KEYWORDS
        s2 = clean_stage(spark, args.extracted, args.out, kw)
        s2["files"].show()
        s2["filter"].show()
        collection_stage(spark, s2["final"], args.out)
        for name, df in dashboard(spark, s2["final"]).items():
            df.write.mode("overwrite").parquet(os.path.join(args.out, "dashboard", name))


if __name__ == "__main__":
    main()
