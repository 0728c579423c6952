"""Incremental ingest: a second run picks up only new files."""
import json
import os

from paramforge.streaming.incremental import ingest_available


def test_incremental_ingest(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    os.makedirs(src)

    def put(pid, obj):
        with open(os.path.join(src, f"{pid}_extracted.json"), "w") as f:
            f.write(obj if isinstance(obj, str) else json.dumps(obj))

    put("a", {"Material": "ZnO"})
    put("b", {"Material": "TiN"})
    put("bad", "[1, 2]")
    r1 = ingest_available(spark, src, out, ckpt)
    assert r1["stored"] == 2
    put("c", {"Material": "YBCO"})
    r2 = ingest_available(spark, src, out, ckpt)
    assert r2["stored"] == 3 and r2["read"] == 1
    ids = sorted(r.paper_id for r in spark.read.parquet(out).collect())
    assert ids == ["a", "b", "c"]
