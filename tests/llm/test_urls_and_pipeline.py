"""Dated URL lists against a loop, the SQL of the query, and the pipeline."""
import duckdb

import __spark_entry__ as E
import corpus_pipeline
from paramforge.llm import queries as Q
from paramforge.llm import temporal_urls

SF = "/root/testdata/sf0.001"


def test_intervals_and_judgement(spark):
    entries = [("spam", "domain", "bad.org", "add", 10), ("spam", "domain", "bad.org", "remove", 20), ("spam", "domain", "bad.org", "add", 30), ("p", "prefix", "ok.org/a/b", "add", 5), ("p", "prefix", "ok.org/a/b", "add", 50),
               ("p", "prefix", "ok.org/a/b", "remove", 50), (None, "domain", None, "add", 1), ("x", "domain", "z.org", "add", None), (None, "domain", "n.org", "add", 0)]
    e = spark.createDataFrame(entries, "list string, kind string, key string, action string, at int")
    rows = [(1, "http://WWW.bad.org/x", 10, "c"), (2, "http://www.bad.org/x", 20, "c"), (3, "http://bad.org", 99, "c"), (4, "https://ok.org/a/b/c?q", 5, "c"), (5, "https://ok.org/a/bc", 6, "c"), (6, "https://ok.org/a/b", 50, "c"),
            (7, None, 5, "c"), (8, "no url", 5, "c"), (9, "http://bad.org", None, "c"), (3, "http://bad.org", 99, "c"), (None, "http://notbad.org", 12, "c"), (11, "http://user@bad.org:80/x", 11, None)]
    got = temporal_urls.judge(spark.createDataFrame(rows, "page_id long, url string, at int, lists string"), e).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r.page_id: r.lists for r in got if r.blocked} == {1: "spam", 3: "spam", 4: "p", 11: "spam"}
    assert temporal_urls.judge(spark.createDataFrame([], "page_id long, url string, at int"), e).count() == 0


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    sdf = Q.QUERIES["op8_temporal_urls"](spark, SF)
    want = con.execute(f"SELECT {', '.join(sdf.columns)} FROM ({Q.ORACLE['op8_temporal_urls']})").fetchall()
    assert sorted(tuple(r) for r in sdf.collect()) == sorted(want)


def test_every_operator_and_the_pipeline_are_registered():
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_the_columns(spark, docs, empty):
    df = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:  # the first has its own test
        df = stage(spark, df, SF)
        assert df.columns == docs.columns, name
        assert stage(spark, empty, SF).count() == 0
    ids = [r.doc_id for r in df.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and len(ids) < docs.count()
