"""File sources and sinks.

All readers use explicit schemas (no inference pass over the data) and
all writers are plain DataFrame writes, so file listing, splitting and
retries are Spark's. Per-file Python loops of the original become one
scan of a directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import strip_suffixes
from ..operators.extract import RAW_SCHEMA, is_json_object

SECTION = T.StructType([T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())])
STRUCTURED_SCHEMA = T.StructType([
    T.StructField("paper_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("sections", T.ArrayType(SECTION)),
])
CLEAN_CSV_SCHEMA = T.StructType([
    T.StructField("paper_id", T.StringType()),
    T.StructField("material", T.StringType()),
    T.StructField("substrate", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("gas_mixture_std", T.StringType()),
    *[T.StructField(m, T.StringType()) for m in
      ["power_w", "working_pressure_pa", "base_pressure_pa", "temperature_c", "thickness_nm"]],
])


def file_name(path_col: str = "path"):
    return F.regexp_extract(F.col(path_col), r"[^/]+$", 0)


def paper_id_from_path(path_col: str = "path", suffixes: list[str] = K.PAPER_FILE_SUFFIXES):
    """A2: file name without every occurrence of each suffix, in order:
    '.grobid.tei.xml' then '.xml' for TEI files, '_extracted.json' for
    extraction files."""
    return strip_suffixes(file_name(path_col), suffixes)


def extraction_id_from_path(path_col: str = "path"):
    return paper_id_from_path(path_col, [K.EXTRACTION_FILE_SUFFIX])


def read_xml_dir(spark: SparkSession, directory: str) -> DataFrame:
    """A1: every ``*.xml`` file of a directory as (path, paper_id, content)
    decoded as UTF-8; one row per file, split across tasks by Spark."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(directory)
    return df.select("path", paper_id_from_path().alias("paper_id"), F.decode("content", "UTF-8").alias("content"))


def write_structured(papers: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A3: structured papers (nested schema) as parquet or JSON lines."""
    papers.select(*[f.name for f in STRUCTURED_SCHEMA.fields]).write.mode("overwrite").format(fmt).save(path)


def _json_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record): a file is one JSON object over many lines, or JSON
    lines (its first line is an object of its own)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    files = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    is_lines = is_json_object(F.try_element_at(lines, F.lit(1)))
    return files.select("path", F.explode(F.when(is_lines, lines).when(F.size(lines) > 0, F.array("text"))).alias("record"))


def read_structured(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A5: structured papers with a fixed schema, from parquet or from JSON
    files below ``path`` (indented objects or JSON lines). Records that are
    no object are left out and counted by ``structured_report``; a missing
    folder reads as empty."""
    try:
        if fmt != "json":
            return spark.read.schema(STRUCTURED_SCHEMA).format(fmt).load(path)
        records = _json_records(spark, path)
    except Exception as e:  # noqa: BLE001 - only a missing path is tolerated
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], STRUCTURED_SCHEMA)
        raise
    return records.filter(is_json_object("record")).select(F.from_json("record", STRUCTURED_SCHEMA).alias("j")).select("j.*")


def structured_report(spark: SparkSession, path: str) -> DataFrame:
    """Records found, loaded and skipped by ``read_structured``."""
    ok = is_json_object("record")
    return _json_records(spark, path).agg(F.count(F.lit(1)).alias("records"), F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("skipped"))


def write_tables(cells: DataFrame, path: str) -> None:
    """A4: paper tables in long form (paper_id, table_idx, row_idx, cells),
    sorted by paper within each file (row-group statistics prune on it)."""
    cells.sortWithinPartitions("paper_id", "table_idx", "row_idx").write.mode("overwrite").parquet(path)


def write_raw_extractions(responses: DataFrame, path: str) -> None:
    """Stored responses (paper_id, text) appended to the raw store."""
    responses.select("paper_id", "text").write.mode("append").parquet(path)


def read_extraction_files(spark: SparkSession, directory: str) -> DataFrame:
    """Every ``*_extracted.json`` file -> (paper_id, 10 raw fields).
    Files that are not a JSON object (broken, truncated, an array) are
    skipped; see ``extraction_file_report`` for the counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*" + K.EXTRACTION_FILE_SUFFIX).load(directory)
    texts = files.select(extraction_id_from_path().alias("paper_id"), F.decode("content", "UTF-8").alias("text"))
    ok = texts.filter(is_json_object("text"))
    parsed = ok.select("paper_id", F.from_json("text", RAW_SCHEMA).alias("j")).select("paper_id", "j.*")
    return parsed.select("paper_id", *[F.col(k).alias(k.lower()) for k in K.RAW_KEYS])


def extraction_file_report(spark: SparkSession, directory: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*" + K.EXTRACTION_FILE_SUFFIX).load(directory)
    ok = is_json_object(F.decode("content", "UTF-8"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("skipped"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. In an array column one value is written as a
    plain number, more as list text, none as an empty field."""
    def cell(f: T.StructField):
        if not isinstance(f.dataType, T.ArrayType):
            return F.col(f.name)
        one = F.try_element_at(f.name, F.lit(1)).cast("string")
        return F.when(F.size(f.name) == 1, one).when(F.size(f.name) > 1, F.to_json(f.name)).alias(f.name)

    cols = [cell(f) for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = CLEAN_CSV_SCHEMA,
             na_values: list[str] | None = None) -> DataFrame:
    """A10: CSV with a header and an explicit schema (ids stay text).
    ``na_values`` lists texts that read as null. A missing file raises
    FileNotFoundError with the path."""
    try:
        df = spark.read.schema(schema).option("header", True).csv(path)
        df.schema  # noqa: B018 - resolve the path now
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"could not find {path}") from e
        raise
    for v in na_values or []:
        df = df.select(*[F.nullif(F.col(c), F.lit(v)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    return df


def write_collection(items: DataFrame, path: str) -> None:
    """A11 sink: the collection (id, document, metadata, vector) as one
    parquet write; partitions replace the original's batches of 100."""
    items.write.mode("overwrite").parquet(path)


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """Open a collection by its location."""
    return spark.read.parquet(path)
