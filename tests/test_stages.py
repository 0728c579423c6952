"""The chained stages over hand-written files."""
import json
import os

from paramforge.plans import stages as P
from test_files import GOOD_TEI


def test_pipeline_end_to_end(spark, tmp_path):
    xml_dir, ext_dir, out = (str(tmp_path / n) for n in ("xml", "ext", "out"))
    os.makedirs(xml_dir)
    os.makedirs(ext_dir)
    with open(os.path.join(xml_dir, "p1.grobid.tei.xml"), "w") as f:
        f.write(GOOD_TEI)
    with open(os.path.join(xml_dir, "broken.xml"), "w") as f:
        f.write("no markup here")
    s1 = P.structure_stage(spark, xml_dir, out)
    rep = s1["report"].collect()[0]
    assert (rep.total, rep.succeeded, rep.failed) == (2, 1, 1)
    req = s1["requests"].collect()
    assert len(req) == 1 and "RF sputtering at 100 W" in req[0].request

    papers = [
        ("a", "ZnO", "soda-lime glass", "RF magnetron sputtering", "100 W", "5 mTorr", "RT", "200 nm"),
        ("b", "Zinc oxide", "Si (100)", "HiPIMS", "200 W", "0.5 Pa", "300 K", "1.5 um"),
        ("c", "TiN", "sapphire ", "Magnetron", "50 W", "1 Pa", "-196 °C", "100 nm"),
        ("d", "ZnO:Al", "not specified", "DC Sputter", "100 W, 200 W", "2 Pa", "RT", "2 mm"),
    ]
    for pid, mat, sub, meth, pw, wp, t, th in papers:
        with open(os.path.join(ext_dir, f"{pid}_extracted.json"), "w") as f:
            json.dump({"Material": mat, "Substrate": sub, "Deposition_Method": meth, "Target": "Not specified",
                       "Power": pw, "Gas_Mixture": "Ar", "Working_Pressure": wp, "Base_Pressure": "Not specified",
                       "Temperature": t, "Film_Thickness": th}, f)
    with open(os.path.join(ext_dir, "e_extracted.json"), "w") as f:
        f.write("[1]")
    s2 = P.clean_stage(spark, ext_dir, out)
    fr = s2["filter"].collect()[0]
    assert (fr.total, fr.dropped, fr.kept) == (4, 1, 3)  # 'Magnetron' alone is dropped
    assert s2["files"].collect()[0].skipped == 1
    coll = P.collection_stage(spark, s2["final"], out)
    assert coll.count() == 3 and len(coll.first().vec) == 26
    dash = P.dashboard(spark, s2["final"])
    cons = {r.family: r for r in dash["consensus"].collect()}
    z = cons["ZnO"]
    assert z.n_papers == 3 and z.power_w_mean == 150.0  # the list of paper d is not a scalar
    assert z.temperature_c_mode == 25.0 and z.top_substrate in ("Not Specified", "Si (100)", "Soda-Lime Glass")
    assert "TiN" not in cons
    assert sum(r["count"] for r in dash["histograms"].filter("family = 'ZnO' AND metric = 'power_w'").collect()) == 2


def test_command_line(spark, tmp_path):
    xml_dir, ext_dir, out = (str(tmp_path / n) for n in ("xml", "ext", "out"))
    os.makedirs(xml_dir)
    os.makedirs(ext_dir)
    with open(os.path.join(xml_dir, "p1.grobid.tei.xml"), "w") as f:
        f.write(GOOD_TEI)
    with open(os.path.join(ext_dir, "p1_extracted.json"), "w") as f:
        json.dump({"Material": "ZnO", "Deposition_Method": "Magnetron", "Power": "100 W"}, f)
    P.main(["--tei", xml_dir, "--extracted", ext_dir, "--out", out, "--corrected-keywords"])
    cons = spark.read.parquet(os.path.join(out, "dashboard", "consensus")).collect()
    assert [(r.family, r.n_papers, r.power_w_mean) for r in cons] == [("ZnO", 1, 100.0)]
    assert spark.read.parquet(os.path.join(out, "requests")).count() == 1
