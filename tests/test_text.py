"""Text helpers, structuring and extraction hand-off on hand-written inputs."""
from column_values import values
from paramforge import constants as K
from paramforge.functions.text import clean_text, contains_any, py_strip, py_title
from paramforge.operators import clean as C
from paramforge.operators import extract as X
from paramforge.operators import stats as S


def test_clean_text(spark):
    got = values(spark, clean_text, ["A [1] b [2, 3] c [2-4]", "  x   y\n\tz  ", "[12]", None])
    assert got == ["A b c [2-4]", "x y z", "", None]


def test_py_strip_and_title(spark):
    assert values(spark, py_strip, ["  a b \n"]) == ["a b"]
    assert values(spark, py_title, ["soda-lime sio2/si3n4 GLASS", "sapphire "]) == ["Soda-Lime Sio2/Si3N4 Glass", "Sapphire "]


def test_keyword_tests(spark):
    texts = ["RF Sputtering at 5 W", "nothing here", "HEATER on", "Å/s only", None]
    assert values(spark, lambda c: contains_any(c, K.PARAGRAPH_KEYWORDS), texts) == [True, False, True, False, False]


def test_method_filter_goldens(spark):
    df = spark.createDataFrame([(m,) for m in ["RF magnetron sputtering", "HiPIMS", "Ion Beam deposition",
                                               "Magnetron", "Sol-gel", None]], "method string")
    kept = [r.method for r in C.method_filter(df).collect()]
    assert kept == ["RF magnetron sputtering", "HiPIMS", "Ion Beam deposition"]
    assert "Magnetron" in [r.method for r in C.method_filter(df, K.METHOD_KEYWORDS_CORRECTED).collect()]
    rep = C.filter_report(df).collect()[0]
    assert (rep.total, rep.dropped, rep.kept) == (6, 3, 3)


def test_required_column_message(spark):
    import pytest

    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="available columns"):
        C.method_filter(df)


def test_substrate_class_goldens(spark):
    cases = [("soda-lime glass", "Glass"), ("ITO glass", "ITO"), ("PET/ITO", "Polymers (PET/PEN)"),
             ("SiO2/Si", "SiO2 / Si"), ("Si (100)", "Silicon (Si)"), ("Al2O3", "Sapphire"),
             ("single crystal MgO", "Silicon (Si)"), ("fused silica", "Silicon (Si)"), ("MgO", "Other / Complex"),
             (None, "Other / Complex")]
    got = values(spark, lambda c: S.substrate_class(S.substrate_normalize(c)), [c[0] for c in cases])
    assert got == [c[1] for c in cases]
    assert values(spark, S.substrate_normalize, ["not specified", "nan", " sapphire ", None]) == [None, None, "Sapphire", None]


def test_fence_strip(spark):
    cases = ['```json\n{"a": 1}\n```', '```\n{"a": 1}\n```', '{"a": 1}', '```json\n{"a": 1}', "", "   ", "```json```"]
    got = values(spark, X.fence_strip, cases)
    assert got == ['{"a": 1}', '{"a": 1}', '{"a": 1}', '{"a":', None, None, None]


def test_json_ingest_robust(spark):
    texts = ['{"Material": "ZnO", "Power": 100}', '{"Material": null, "Power": ["1 W", "2 W"]}', '[1, 2]',
             '{"Material": "TiN"', "not json", '{"Substrate": "Si"}']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "paper_id string, text string")
    out = {r.paper_id: r for r in X.json_ingest(df, "text").collect()}
    assert sorted(out) == ["0", "1", "5"]
    assert out["0"].Material == "ZnO" and out["0"].Power == "100"
    assert out["1"].Material is None and "1 W" in out["1"].Power
    assert out["5"].Material is None and out["5"].Substrate == "Si"


def test_length_gate_and_request(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a" * 51,), ("  " + "b" * 50 + "\n\n",)], "t string")
    assert [r.g for r in df.select(X.length_gate("t").alias("g")).collect()] == [True, False]
    req = df.select(X.request_text(F.col("t")).alias("r")).collect()[0].r
    assert req.endswith("a" * 51 + "\n    ") and '"Film_Thickness"' in req


def test_structured_pages_on_real_pages(spark):
    from pyspark.sql import functions as F

    from paramforge.operators import structure as B
    from paramforge.sources.tables import read_table

    pages = read_table(spark, "/root/testdata/sf0.001", "pages")
    sp = B.structured_pages(pages)
    rows = sp.collect()
    assert len(rows) == pages.count()
    assert all(r.title and "<" not in r.title and "&amp;" not in r.title for r in rows)
    # every kept section text is made of relevant paragraphs only
    for r in rows:
        for s in r.sections:
            assert s.text and s.heading
    assert sp.select(F.size("sections").alias("n")).agg(F.sum("n")).collect()[0][0] >= 0


def test_task_functions_run_without_the_package(tmp_path):
    """Task-side functions are closures over plain values: unpickled in a
    Python process without this package on its path (an executor that does
    not have it), they still run."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from paramforge.operators import retrieval as R
    from paramforge.operators import tei as TEI

    _, batches = TEI._make_parser(("sputter",), "Unknown Section", "Table Caption:")
    kernel = R._partial_topk([[0.0, 1.0]], 1, "id", "vec")
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((batches, kernel)))
    code = (
        "import pandas as pd; from pyspark import cloudpickle\n"
        "batches, kernel = cloudpickle.loads(open('f.pkl','rb').read())\n"
        "doc = '<TEI><text><body><div><head>H</head><p>RF sputter</p></div></body></text></TEI>'\n"
        "out = next(batches(iter([pd.DataFrame({'paper_id': ['a'], 'content': [doc]})])))\n"
        "assert out.ok[0] and out.sections[0][0]['heading'] == 'H'\n"
        "top = next(kernel(iter([pd.DataFrame({'id': [1, 2], 'vec': [[0.0, 1.0], [5.0, 5.0]]})])))\n"
        "assert list(top['id']) == [1]\n"
        "import importlib.util; assert importlib.util.find_spec('paramforge') is None\n"
        "print('ok')\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert res.returncode == 0 and "ok" in res.stdout, res.stderr[-2000:]
