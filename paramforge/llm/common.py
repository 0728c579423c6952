"""Helpers shared by the operators: stage tables in the shared folder and
row plumbing that keeps foreign column names out of the way."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramforge.session import ensure_checkpoint_dir

#: Characters that separate words, as bytes: blank and \t \n \v \f \r.
WORD_SPACE = b" \t\n\x0b\x0c\r"


class Scratch:
    """Tables written once into the folder named by ``spark.checkpoint.dir``.

    Reading them back cuts the lineage: a lost executor costs a re-read, not
    a re-run. ``drop`` removes tables that no later plan reads, and lets
    Spark's cleaner remove the shuffle files behind them.
    """

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/paramforge-{owner}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release_shuffles(self) -> None:
        """Unreferenced shuffle files go when the driver collects garbage:
        once for what Python still held, and again for what that held."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)


def nested(docs: DataFrame, *names: str) -> DataFrame:
    """The columns an operator reads beside the whole row as struct ``_doc``:
    extra columns of any name pass through untouched."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[F.col(f"`{c}`").alias(c) for c in names])


def unnested(df: DataFrame) -> DataFrame:
    return df.select("_doc.*")


def parts_for(spark: SparkSession, nbytes: int, target: int = 32 << 20) -> int:
    """Number of partitions that keeps each near ``target`` bytes, and no
    fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(nbytes) // target))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (one aggregate over the input)."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
