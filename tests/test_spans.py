"""B15 with positions: hand-made texts with expected fields."""
import random
import re

import pytest
from pyspark.sql import functions as F

from paramforge.operators import spans as SP

NS = "Not specified"
TEXTS = {
    "before": "ZnO films on a glass substrate from a TiN target. The base pressure was 2 x 10^-6 Torr and the working pressure 5 mTorr in argon.",
    "after": "Pumped to 3e-4 Pa base pressure, later 0.5 Pa working pressure; 200 W, 300 °C, 150 nm, HiPIMS.",
    "far": "The base pressure is told here, " + "then much is said of other things " * 3 + "and 7 mTorr.",
    "tie": "base pressure 1 Pa working pressure",
    "several": "working pressure 1 Pa, 2 Pa; once it was cold the base pressure 3 Pa",
    "none": "Nothing of this kind is said.",
    "empty": "",
    "null": None,
    "marks": "working pressure\x01 4 Pa\x02",
}


@pytest.fixture(scope="module")
def fields(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "paper_id string, combined_text string")
    return {r.paper_id: r.asDict() for r in SP.extract_fields(df).collect()}


def test_every_paper_keeps_its_row(fields):
    assert set(fields) == set(TEXTS)
    for name in ("none", "empty", "null"):
        assert all(fields[name][f] == NS for f in SP.FIELDS)


def test_nearest_cue(fields):
    b, a = fields["before"], fields["after"]
    assert (b["material"], b["substrate"], b["target"], b["gas_mixture"]) == ("ZnO", "glass", "TiN", "argon")
    assert (b["base_pressure"], b["working_pressure"]) == ("2 x 10^-6 Torr", "5 mTorr")
    assert (a["base_pressure"], a["working_pressure"]) == ("3e-4 Pa", "0.5 Pa")
    assert (a["power"], a["temperature"], a["film_thickness"], a["deposition_method"]) == ("200 W", "300 °C", "150 nm", "HiPIMS")
    assert fields["several"]["working_pressure"] == "1 Pa, 2 Pa" and fields["several"]["base_pressure"] == "3 Pa"
    assert fields["marks"]["working_pressure"] == "4 Pa"


def test_out_of_reach_and_ties(fields):
    assert fields["far"]["working_pressure"] == "7 mTorr" and fields["far"]["base_pressure"] == NS
    assert fields["tie"]["base_pressure"] == "1 Pa" and fields["tie"]["working_pressure"] == NS


def test_places_point_at_the_text(spark):
    df = spark.createDataFrame([(k, v) for k, v in TEXTS.items() if v], "paper_id string, combined_text string")
    rows = SP.spans(df).collect()
    assert rows
    for r in rows:
        text = TEXTS[r.paper_id].replace("\x01", " ").replace("\x02", " ")
        assert text[r.start : r.end] == r.span and r.quantity


def test_empty_table(spark):
    assert SP.extract_fields(spark.createDataFrame([], "paper_id string, combined_text string")).count() == 0


def test_repeated_rows_and_two_texts_of_one_id(spark):
    rows = [("p", "working pressure 1 Pa"), ("p", "working pressure 1 Pa"), ("p", "base pressure 2 Pa"), (None, "working pressure 3 Pa")]
    out = SP.extract_fields(spark.createDataFrame(rows, "paper_id string, combined_text string").selectExpr("*", "1 as span", "2 as start")).collect()
    assert sorted((r.paper_id or "", r.working_pressure, r.base_pressure) for r in out) == [("", "3 Pa", NS), ("p", "1 Pa", NS), ("p", "1 Pa", NS), ("p", NS, "2 Pa")]


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "paper_id string, combined_text string")
    assert "Exchange" not in SP.extract_fields(df)._jdf.queryExecution().executedPlan().toString()


def test_nearest_cue_of_long_texts(spark):
    """Against a plain scan: cues beyond many other spans, and long texts."""
    rng = random.Random(3)
    words = ["base pressure", "working pressure", "1 Pa", "2 mTorr", "films", "substrate", "ZnO", "TiN", "5 W", "argon", "x" * 30, "y", "target"]
    texts = [(str(i), " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([5, 20, 60, 400] * 5)]
    df = spark.createDataFrame(texts, "paper_id string, combined_text string")
    for reach in (1, 12, SP.REACH):
        rows = df.select("paper_id", SP.found_in(F.col("combined_text")).alias("f")).select("*", SP.assigned(F.col("f"), reach).alias("a")).collect()
        for r in rows:
            want = []
            for v in (x for x in r.f if x.cue is None):
                cues = [(v.start - c.end, 0, c.cue) if c.start < v.start else (c.start - v.end, 1, c.cue) for c in r.f if c.cue and c.quantity == v.quantity]
                best = min(cues, default=(1 << 30, 0, None))
                hit = best[0] <= reach
                want.append((v.start, v.span, best[2] if hit else SP.DEFAULT_FIELD[v.quantity], best[0] if hit else None))
            assert [tuple(x) for x in r.a] == want


def test_boundary_is_looked_for_once(spark):
    """No branch looks for its own word boundary, and the spans are those of
    the patterns tested in their order at every place."""
    assert not re.search(r"[(|](?:\?-i:)?\\b", SP.GROUPS.removeprefix(r"(?i)\b"))
    rng = random.Random(11)
    words = ["-196 °C", "5-10 K", "a-3 K", "1e-4 Pa", "5", "-", "rt", "art", "RF magnetron sputtering", "pulsed dc sputter", "rf", "1.5x10^-3 Torr", "2.5 kW", "Base Pressure", "base vacuums",
             "room temperatures", "TiO2:Nb", "ZnO/Al", "zno", "O2", "12Å", "3 μm", "°", "ito glass", "soda-lime glass", "films.", "filmsX", "_film", "éfilm", "x", ","]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "-"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", SP.found_in(F.col("t")).alias("f"), F.regexp_extract_all("t", F.lit(SP.ANY), F.lit(1)).alias("plain")).collect():
        assert [s.span for s in r.f] == r.plain
        for s in r.f:
            assert r.t[s.start : s.end] == s.span
            first = next(p for p in SP.PATTERNS if re.fullmatch(p[2].replace("(?-i:", "(?:") if p[1] or p[0] != "substance" else r"(?s).*", s.span, re.I))
            assert (s.quantity, s.cue or "") == first[:2]
