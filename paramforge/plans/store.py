"""Stage tables written once and read by the later stages.

The pipeline hands over between stages through tables (the raw
extraction store, clean papers, the collection, the structured
documents), as the original hands over through files. Building a stage table is a normal Spark write into the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``:
tasks are retried on executor loss and the commit is atomic, and the
read back cuts the lineage, so no later query re-runs the regex parsing.

The table path includes a fingerprint of the input files (name, size,
modification time) and of this package's code, so neither new input nor
a changed parser ever reads an old table.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_PKG_DIR = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@lru_cache(maxsize=1)
def code_fingerprint() -> str:
    h = hashlib.sha1()
    for root, _, files in sorted(os.walk(_PKG_DIR)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(root, f), "rb") as fh:
                    h.update(f.encode())
                    h.update(fh.read())
    return h.hexdigest()[:12]


def input_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Path, size and modification time of every file below the input folder,
    partition folders included (metadata only; no data is read)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    h = hashlib.sha1(str(fs.makeQualified(p).toString()).encode())
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        st = files.next()
        found.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}")
    for line in sorted(found):
        h.update(line.encode())
    return h.hexdigest()[:16]


def table_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    ensure_checkpoint_dir(spark)
    # the shared folder itself (not Spark's per-application subfolder), so a
    # later run over unchanged input and code reuses the table
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    key = hashlib.sha1(f"{input_fingerprint(spark, sf_dir)}|{code_fingerprint()}".encode()).hexdigest()[:16]
    return f"{root}/paramforge-tables/{key}/{name}"


def _complete_versions(spark: SparkSession, base: str) -> list[str]:
    """Version folders under ``base`` whose write committed (``_SUCCESS``),
    in name order."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v-") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(st.getPath().toString())
    return sorted(out)


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage table ``name`` for ``sf_dir``: written by ``build()`` on
    first use, then read from storage.

    Each build writes its own version folder (no overwrite, no rename), and
    readers take the first committed version, so two jobs building the same
    table at once never disturb each other; their versions are identical
    because input and code are part of the key."""
    base = table_path(spark, sf_dir, name)
    versions = _complete_versions(spark, base)
    if not versions:
        build().write.mode("errorifexists").parquet(f"{base}/v-{uuid.uuid4().hex}")
        versions = _complete_versions(spark, base)
    return spark.read.parquet(versions[0])
