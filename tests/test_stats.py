"""Statistics: properties and edge cases of histograms and the dashboard."""
import pytest
from pyspark.sql import functions as F

from paramforge.operators import clean as C
from paramforge.operators import stats as S
from paramforge.plans import catalog


@pytest.fixture(scope="module")
def clean(spark):
    return catalog.clean_table(spark, "/root/testdata/sf0.001")


def test_weighted_histogram_equals_cross_explode(spark, clean):
    """The histogram without the cross product gives the counts of the
    four chained explodes followed by the all-null drop."""
    for col in C.EXPLODED:
        fast = {r.bin: r["count"] for r in S.eda_histogram(clean, col).collect()}
        plain = C.drop_all_null(C.explode_cross(clean.select("paper_id", *C.EXPLODED)))
        if col == "thickness_nm":
            plain = C.thickness_filter(plain)
        vals = plain.select(F.col(col).alias("value")).filter("value IS NOT NULL")
        slow = {r.bin: r["count"] for r in S.histogram(vals, len(fast)).collect()}
        assert fast == slow, col
        assert sum(fast.values()) == vals.count()


def test_histogram_edges(spark):
    one = spark.createDataFrame([(5.0,), (5.0,)], "value double")
    h = S.histogram(one, 40).collect()
    assert len(h) == 40 and sum(r["count"] for r in h) == 2
    assert [r.bin for r in h if r["count"]] == [21]  # lo = hi: widened by 0.5 each side
    empty = spark.createDataFrame([], "value double")
    assert S.histogram(empty, 10).count() == 0
    top = spark.createDataFrame([(0.0,), (10.0,)], "value double")
    assert {r.bin: r["count"] for r in S.histogram(top, 10).collect() if r["count"]} == {1: 1, 10: 1}


def test_consensus_mode_lowest_and_empty(spark):
    fam = spark.createDataFrame(
        [("F", "p1", 2.0, None, 1.0, "Glass"), ("F", "p2", 1.0, None, 1.0, "Si"), ("F", "p3", 2.0, None, None, None),
         ("F", "p4", 1.0, None, None, "Si"), ("G", "q1", None, None, None, None)],
        "family string, paper_id string, power_w double, temperature_c double, working_pressure_pa double, substrate string")
    rows = {r.family: r for r in S.consensus(fam).collect()}
    f = rows["F"]
    assert f.n_papers == 4 and f.power_w_mode == 1.0 and f.power_w_median == 1.5 and f.power_w_mean == 1.5
    assert f.temperature_c_mean is None and f.top_substrate == "Si"
    assert rows["G"].top_substrate == "No Data" and rows["G"].power_w_mode is None
    disp = {r.family: r for r in S.consensus_display(S.consensus(fam)).collect()}
    assert disp["F"].temperature_c_status == "No Data" and disp["F"].power_w_status == "OK"


def test_box_and_fence(spark):
    fam = spark.createDataFrame([("F", f"p{i}", float(v), None, None, None) for i, v in enumerate([1, 2, 3, 4, 100])],
                                "family string, paper_id string, power_w double, temperature_c double, "
                                "working_pressure_pa double, substrate string")
    b = S.box_quartiles(fam).collect()[0]
    assert (b.q1, b.median, b.q3) == (2.0, 3.0, 4.0)
    kept = sorted(r.value for r in S.outlier_fence(fam).collect())
    assert kept == [1.0, 2.0, 3.0, 4.0]


def test_family_filter_and_counts(spark):
    papers = spark.createDataFrame([("a", "ZnO"), ("b", "Zinc oxide"), ("c", "TiN"), ("d", "Cu")],
                                   "paper_id string, material string")
    fam = S.family_filter(papers, S.alias_table(spark))
    assert sorted((r.family, r.paper_id) for r in fam.collect()) == [("TiN", "c"), ("ZnO", "a"), ("ZnO", "b")]


def test_collection_dedup_keeps_smallest(spark):
    items = spark.createDataFrame([("x", "b doc", "M", "S"), ("x", "a doc", "M2", "S2"), ("y", "c", "M", "S")],
                                  "paper_id string, document string, material string, substrate string")
    out = {r.paper_id: r for r in C.collection_dedup(items).collect()}
    assert out["x"].document == "a doc" and out["x"].material == "M2" and len(out) == 2


def test_consensus_approximate_path(spark):
    fam = spark.createDataFrame([("F", f"p{i}", float(v), 20.0, 1.0, "Si") for i, v in enumerate([1, 2, 2, 3, 9])],
                                "family string, paper_id string, power_w double, temperature_c double, "
                                "working_pressure_pa double, substrate string")
    r = S.consensus(fam, exact=False).collect()[0]
    assert r.power_w_mode == 2.0 and r.power_w_median == 2.0 and r.power_w_min == 1.0 and r.power_w_max == 9.0


def test_quartiles_and_fences_approximate_path(spark):
    fam = spark.createDataFrame([("F", f"p{i}", float(v), None, None, None) for i, v in enumerate([1, 2, 3, 4, 100])],
                                "family string, paper_id string, power_w double, temperature_c double, "
                                "working_pressure_pa double, substrate string")
    b = S.box_quartiles(fam, exact=False).collect()[0]
    assert b.n == 5 and b.q1 <= b.median <= b.q3 and b.median == 3.0
    kept = sorted(r.value for r in S.outlier_fence(fam, exact=False).collect())
    assert 100.0 not in kept and 3.0 in kept


def test_number_text_keeps_small_values(spark):
    from pyspark.sql import functions as F

    from paramforge.operators.clean import number_text

    vals = [200.0, 0.133322, 1.33322e-07, 1e-10, 0.0, -25.5, 0.0001, 123456.789, 2e15]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = [r.t for r in df.select("i", number_text(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == ["200.0", "0.133322", "1.33322e-07", "1e-10", "0.0", "-25.5", "0.0001", "123456.789", "2e+15"]


def test_collection_dedup_of_single_ids_sorts_no_document(spark, monkeypatch):
    rows = [("a", "d2"), ("a", "d1"), (None, "n2"), (None, "n1"), ("b", "x"), ("c", "y")]
    items = spark.createDataFrame(rows, "paper_id string, document string")
    built = lambda df: df.select("paper_id", F.upper("document").alias("document"))
    want = {("a", "D1"), (None, "N1"), ("b", "X"), ("c", "Y")}
    few = C.collection_dedup(items, build=built)
    assert set(map(tuple, few.collect())) == want and few.count() == 4
    assert "LeftAnti" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "MAX_REPEATED_KEYS", 1)
    assert set(map(tuple, C.collection_dedup(items, build=built).collect())) == want
