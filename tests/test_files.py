"""Sources and sinks with hand-written files in a temp dir."""
import json
import os

import pytest

from paramforge.operators import tei as TEI
from paramforge.sources import files as FS

GOOD_TEI = """<?xml version="1.0" encoding="UTF-8"?>
<TEI xmlns="http://www.tei-c.org/ns/1.0">
 <teiHeader><fileDesc><titleStmt><title level="a">ZnO  films [1] by sputtering</title></titleStmt></fileDesc>
  <profileDesc><abstract><div><p>We deposit <ref>[2, 3]</ref> ZnO films.</p></div></abstract></profileDesc></teiHeader>
 <text><body>
  <div><head>2. Experimental</head>
   <p>Films were grown by RF sputtering [4] at 100 W and 5 mTorr.</p>
   <p>Unrelated sentence.</p>
   <div><p>The substrate temperature was 300 K [2-4].</p></div>
  </div>
  <div><p>Argon flow rate of 20 sccm.</p></div>
  <div><head>3. Results</head><p>Nothing relevant here.</p></div>
  <figure type="table"><head>Table 1: Parameters</head>
   <table><row><cell>Power</cell><cell>100 W</cell></row><row><cell>Gas</cell><cell>Ar</cell></row></table></figure>
  <figure type="table"><table><row><cell>a</cell></row></table></figure>
 </body></text>
</TEI>"""


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def test_tei_structure(spark, tmp):
    d = os.path.join(tmp, "xml")
    os.makedirs(d)
    with open(os.path.join(d, "p1.grobid.tei.xml"), "w") as f:
        f.write(GOOD_TEI)
    with open(os.path.join(d, "cut.xml"), "w") as f:  # truncated: read up to the cut
        f.write("<TEI><text><body><div><head>Methods</head><p>RF sputtering at 5 W.</p><p>cut")
    with open(os.path.join(d, "bad.xml"), "w") as f:  # no element at all
        f.write("not xml")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("ignored")
    files = FS.read_xml_dir(spark, d)
    assert sorted(r.paper_id for r in files.collect()) == ["bad", "cut", "p1"]
    st = TEI.structure_tei(files)
    rows = {r.paper_id: r for r in st.collect()}
    p = rows["p1"]
    assert p.ok and p.title == "ZnO films by sputtering" and p.abstract == "We deposit ZnO films."
    assert [s.heading for s in p.sections] == ["2. Experimental", "Unknown Section"]
    assert p.sections[0].text == ("Films were grown by RF sputtering at 100 W and 5 mTorr. "
                                  "The substrate temperature was 300 K [2-4].")
    assert not rows["bad"].ok and rows["bad"].error
    cut = rows["cut"]
    assert cut.ok and cut.error.startswith("recovered") and cut.sections[0].heading == "Methods"
    assert cut.sections[0].text == "RF sputtering at 5 W."
    rep = TEI.tei_report(st).collect()[0]
    assert (rep.total, rep.succeeded, rep.failed) == (3, 2, 1)
    cells = TEI.tei_cells(st).orderBy("table_idx", "row_idx", "cell_idx").collect()
    assert [(c.table_idx, c.row_idx, c.cell) for c in cells][:3] == [(1, 0, "Table Caption:"), (1, 0, "Table 1: Parameters"), (1, 1, "Power")]
    assert (cells[-1].table_idx, cells[-1].row_idx, cells[-1].cell) == (2, 1, "a")
    # A3 / A5 round trip of the structured papers
    out = os.path.join(tmp, "structured")
    FS.write_structured(st.filter("ok"), out, fmt="json")
    back = FS.read_structured(spark, out).collect()
    assert back[0].sections[1].heading == "Unknown Section"
    assert FS.read_structured(spark, os.path.join(tmp, "missing")).count() == 0
    # one indented object per file, in a folder per paper, and a broken file
    for name, body in (("p1", json.dumps({"paper_id": "p1", "title": "T", "abstract": "A", "sections": [{"heading": "H", "text": "x"}]}, indent=4)), ("p2", "{broken")):
        os.makedirs(os.path.join(tmp, "indented", name))
        with open(os.path.join(tmp, "indented", name, "structured_data.json"), "w") as f:
            f.write(body)
    one = FS.read_structured(spark, os.path.join(tmp, "indented")).collect()
    assert [(r.title, r.sections[0].text) for r in one] == [("T", "x")]
    assert tuple(FS.structured_report(spark, os.path.join(tmp, "indented")).first()) == (2, 1, 1)


def test_extraction_files(spark, tmp):
    d = os.path.join(tmp, "ext")
    os.makedirs(d)
    docs = {
        "a": json.dumps({"Material": "ZnO", "Substrate": "Si", "Deposition_Method": "RF sputtering", "Target": "Zn",
                         "Power": "100 W", "Gas_Mixture": "Ar", "Working_Pressure": "5 mTorr",
                         "Base_Pressure": "Not specified", "Temperature": "RT", "Film_Thickness": "200 nm"}),
        "b": json.dumps({"Material": None, "Power": 150}),
        "c": json.dumps({"Material": "TiN", "Power": ["100 W", "200 W"]}),
        "d": json.dumps([{"Material": "x"}]),
        "e": '{"Material": "ZnO", "Power": "10',
        "f": '{"Material": "A", "Material": "B", "Power": NaN}',
    }
    for k, v in docs.items():
        with open(os.path.join(d, f"{k}_extracted.json"), "w") as f:
            f.write(v)
    raw = FS.read_extraction_files(spark, d)
    got = {r.paper_id: r for r in raw.collect()}
    assert sorted(got) == ["a", "b", "c", "f"] and got["f"].material == "B"
    assert got["b"].power == "150" and got["b"].material is None and got["c"].power.startswith("[")
    rep = FS.extraction_file_report(spark, d).collect()[0]
    assert (rep.files, rep.loaded, rep.skipped) == (6, 4, 2)
    from paramforge.operators import clean as C
    clean = {r.paper_id: r for r in C.papers_clean(raw).collect()}
    assert clean["a"].power_w == [100.0] and clean["a"].base_pressure_pa is None
    assert clean["b"].power_w is None and clean["c"].power_w == [100.0, 200.0]
    assert clean["b"].gas_mixture_std == "Unknown"


def test_csv_round_trip_and_missing(spark, tmp):
    from paramforge.operators import clean as C
    df = spark.createDataFrame([("p1", "ZnO", None, "RF sputtering", "Ar", [1.0, 2.0], [1.33322e-08], None, [25.0], [100.0])],
                               "paper_id string, material string, substrate string, method string, "
                               "gas_mixture_std string, power_w array<double>, working_pressure_pa array<double>, "
                               "base_pressure_pa array<double>, temperature_c array<double>, thickness_nm array<double>")
    out = os.path.join(tmp, "csv")
    FS.write_csv(df, out)
    back = FS.read_csv(spark, out, na_values=["NA"])
    r = back.collect()[0]
    assert r.paper_id == "p1" and r.substrate is None and r.power_w == "[1.0,2.0]"
    assert (r.working_pressure_pa, r.base_pressure_pa, r.temperature_c, r.thickness_nm) == ("1.33322E-8", None, "25.0", "100.0")
    coerced = C.numeric_coerce(back, C.MEASUREMENTS).collect()[0]
    assert coerced.power_w is None  # lists do not survive the text round trip
    assert (coerced.working_pressure_pa, coerced.base_pressure_pa, coerced.temperature_c, coerced.thickness_nm) == (1.33322e-08, None, 25.0, 100.0)
    with pytest.raises(FileNotFoundError):
        FS.read_csv(spark, os.path.join(tmp, "nope.csv"))


def test_collection_store(spark, tmp):
    items = spark.createDataFrame([("p1", "doc", "ZnO", "Si", [0.1, 0.2])],
                                  "paper_id string, document string, material string, substrate string, vec array<double>")
    path = os.path.join(tmp, "collection")
    FS.write_collection(items, path)
    assert FS.open_collection(spark, path).collect()[0].vec == [0.1, 0.2]
    cells = spark.createDataFrame([("p1", 1, 0, ["Table Caption:", "T"])], "paper_id string, table_idx int, row_idx int, cells array<string>")
    FS.write_tables(cells, os.path.join(tmp, "tables"))
    assert spark.read.parquet(os.path.join(tmp, "tables")).count() == 1
    FS.write_raw_extractions(spark.createDataFrame([("p1", "{}")], "paper_id string, text string"), os.path.join(tmp, "raw"))
    FS.write_raw_extractions(spark.createDataFrame([("p2", "{}")], "paper_id string, text string"), os.path.join(tmp, "raw"))
    assert spark.read.parquet(os.path.join(tmp, "raw")).count() == 2
