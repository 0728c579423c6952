"""A hot key holding a third of the rows: results stay exact and the
plans combine map-side before the shuffle (no whole group in one task)."""
from pyspark.sql import functions as F

from paramforge.operators import clean as C
from paramforge.operators import retrieval as R
from paramforge.operators import stats as S


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_hot_id(spark):
    n = 3000
    items = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("paper_id"),
        F.format_string("doc %05d", (F.lit(n) - F.col("id"))).alias("document"),
        F.lit("ZnO").alias("material"), F.lit("Si").alias("substrate"),
    ).repartition(8)
    out = C.collection_dedup(items)
    assert "partial_min" in _plan(out)
    rows = {r.paper_id: r.document for r in out.collect()}
    assert len(rows) == 1 + (n - n // 3) and rows["hot"] == "doc 00003"  # smallest document of the hot id


def test_consensus_hot_family(spark):
    n = 3000
    fam = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("ZnO")).otherwise(F.concat(F.lit("F"), (F.col("id") % 40).cast("string"))).alias("family"),
        F.col("id").cast("string").alias("paper_id"),
        (F.col("id") % 7).cast("double").alias("power_w"),
        F.lit(None).cast("double").alias("temperature_c"),
        F.lit(1.0).alias("working_pressure_pa"),
        F.lit("Glass").alias("substrate"),
    ).repartition(8)
    cons = S.consensus(fam)
    plan = _plan(cons)
    assert "partial_avg" in plan and "partial_count" in plan
    assert "percentile(" not in plan and "mode(" not in plan  # no map of all values of a family
    z = cons.filter("family = 'ZnO'").collect()[0]
    vals = sorted(float(i % 7) for i in range(0, n, 3))
    assert z.n_papers == n // 3 and z.power_w_min == vals[0] and z.power_w_max == vals[-1]
    assert abs(z.power_w_mean - sum(vals) / len(vals)) < 1e-9


def test_topk_limits_before_shuffle(spark):
    items = spark.range(2000).select(F.col("id"), F.array(F.col("id").cast("double") % 17, F.lit(0.0)).alias("vec"))
    queries = spark.createDataFrame([("q", [3.0, 0.0])], "query string, qvec array<double>")
    for engine in ("arrow", "jvm"):
        top = R.knn(items, queries, 5, engine=engine)
        assert _plan(top).count("WindowGroupLimit") >= 2, engine  # partial + final
        assert [r.distance for r in top.orderBy("rank").collect()] == [0.0] * 5
