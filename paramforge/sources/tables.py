"""Table sources: the driver's parquet tables and the derived raw
extraction table (MV) that lets the measurement operators run on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a lazy parquet scan (column pruning and filter pushdown
    reach the scan). A session may set ``paramforge.scan.partitions`` where
    its files have fewer row groups than it has cores."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get("paramforge.scan.partitions", None)
    return df.repartition(int(parts)) if parts else df


# Raw extraction rows derived from lineitem. The same SQL text runs in
# Spark and in DuckDB; {src} is the lineitem relation. It covers nulls,
# the sentinel and its lower-case look-alike, ranges, lists, unit
# variants, bad numbers and the thousands comma.
RAW_EXTRACTION_SQL = """
SELECT concat('10.1016/', l_orderkey, '.', l_linenumber, '.', l_partkey) AS paper_id,
  CASE WHEN l_partkey % 97 = 0 THEN 'Not specified'
       ELSE CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'ZnO' WHEN 1 THEN 'Zinc oxide' WHEN 2 THEN 'ZnO:Al' WHEN 3 THEN 'TiO2' WHEN 4 THEN 'YBCO' ELSE 'TiN' END END AS material,
  CASE CAST(l_suppkey % 14 AS INT) WHEN 0 THEN 'soda-lime glass' WHEN 1 THEN 'SiO2/Si' WHEN 2 THEN 'ITO glass' WHEN 3 THEN 'PET/ITO' WHEN 4 THEN 'Si (100)' WHEN 5 THEN 'Al2O3' WHEN 6 THEN 'sapphire ' WHEN 7 THEN 'MgO' WHEN 8 THEN 'Not specified' WHEN 9 THEN NULL WHEN 10 THEN 'quartz' WHEN 11 THEN 'Kapton' WHEN 12 THEN 'not specified' ELSE 'single crystal MgO' END AS substrate,
  CASE CAST(l_linenumber % 7 AS INT) WHEN 0 THEN 'RF magnetron sputtering' WHEN 1 THEN 'Magnetron' WHEN 2 THEN 'HiPIMS' WHEN 3 THEN 'Sol-gel' WHEN 4 THEN NULL WHEN 5 THEN 'Ion Beam deposition' ELSE 'DC Sputter' END AS deposition_method,
  CASE CAST(l_suppkey % 8 AS INT) WHEN 0 THEN 'Ar' WHEN 1 THEN 'Ar + O2 (4:1)' WHEN 2 THEN 'Argon and nitrogen' WHEN 3 THEN 'CO2' WHEN 4 THEN 'Krypton' WHEN 5 THEN 'Not specified' WHEN 6 THEN NULL ELSE 'H2/N2' END AS gas_mixture,
  CASE CAST(l_partkey % 10 AS INT) WHEN 0 THEN concat(q, ' W') WHEN 1 THEN concat(q, '-', q + 50, ' W') WHEN 2 THEN concat(q, ' W, ', q + 10, ' W') WHEN 3 THEN concat('0.', q, ' kW') WHEN 4 THEN concat(q, ' mW') WHEN 5 THEN 'Not specified' WHEN 6 THEN NULL WHEN 7 THEN concat('1,000 W') WHEN 8 THEN concat(q, ' W/cm2; ', q + 5, ' W') ELSE concat('1.2.', q, ' W') END AS power,
  CASE CAST(l_orderkey % 11 AS INT) WHEN 0 THEN concat(q, ' mTorr') WHEN 1 THEN concat('0.', q, ' Pa') WHEN 2 THEN concat(q, ' x 10^-3 Torr') WHEN 3 THEN concat(q, '×10-4 mbar') WHEN 4 THEN concat('1e-', l_linenumber, ' mbar') WHEN 5 THEN concat(q, ' Pa and ', q + 1, ' mTorr') WHEN 6 THEN concat('1-', q, ' mTorr') WHEN 7 THEN '10^-3 Torr' WHEN 8 THEN '1 MPa' WHEN 9 THEN 'Not specified' ELSE NULL END AS working_pressure,
  CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN concat(l_linenumber, ' x 10^-6 Torr') WHEN 1 THEN concat(l_linenumber, 'e-4 Pa') WHEN 2 THEN 'Not specified' ELSE NULL END AS base_pressure,
  CASE CAST(l_partkey % 9 AS INT) WHEN 0 THEN concat(q * 10, ' °C') WHEN 1 THEN concat(q + 300, ' K') WHEN 2 THEN 'RT' WHEN 3 THEN concat('RT and ', q + 200, ' °C') WHEN 4 THEN '25-400 °C' WHEN 5 THEN 'quartz heated to 400 °C' WHEN 6 THEN '-196 °C' WHEN 7 THEN 'Not specified' ELSE NULL END AS temperature,
  CASE CAST(l_orderkey % 9 AS INT) WHEN 0 THEN concat(q * 10, ' nm') WHEN 1 THEN concat('1.', q, ' um') WHEN 2 THEN concat(q, ' Å') WHEN 3 THEN concat(q * 100, ' A') WHEN 4 THEN concat(q, ' nm, ', q * 2, ' nm') WHEN 5 THEN '2 mm' WHEN 6 THEN '100-200 nm' WHEN 7 THEN 'Not specified' ELSE NULL END AS film_thickness
FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM {src}) t
"""


def raw_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw extraction table (one row per paper, 10 text fields) derived
    from ``lineitem``. Map-only: no shuffle."""
    lineitem = read_table(spark, sf_dir, "lineitem")
    return spark.sql(RAW_EXTRACTION_SQL, src=lineitem)


# The raw rows told as text, as a paper would: cues stand before or after
# their values. Valid in Spark and in DuckDB; {src} is the raw table.
PROSE_SQL = """
SELECT paper_id, concat(
  CASE WHEN length(paper_id) % 2 = 0 THEN concat(material, ' films were grown') ELSE concat('Films of ', material, ' were grown') END,
  ' by ', coalesce(deposition_method, 'evaporation'), ' on a ', coalesce(trim(substrate), 'bare'), ' substrate from a target of ', CASE WHEN length(paper_id) % 3 = 0 THEN 'Zn' ELSE 'TiO2' END,
  '. After pumping to ', CASE WHEN length(paper_id) % 2 = 0 THEN concat('a base pressure of ', coalesce(base_pressure, 'high vacuum')) ELSE concat(coalesce(base_pressure, 'high vacuum'), ' base pressure') END,
  ', the gas was ', coalesce(gas_mixture, 'not recorded'), ' at a working pressure of ', coalesce(working_pressure, 'a few units'),
  '. The power was ', coalesce(power, 'not given'), ', the heater stood at ', coalesce(temperature, 'an unknown level'),
  ' and the layer was ', coalesce(film_thickness, 'thin'), ' thick.') AS combined_text
FROM {src} t
"""


def prose(raw: DataFrame) -> DataFrame:
    """(paper_id, combined_text) of every raw row."""
    return raw.sparkSession.sql(PROSE_SQL, src=raw)


# The raw rows as TEI papers: divisions nested in divisions and in notes,
# heads only in an inner division or nowhere, references inside text,
# entities, and figures with ragged rows, some of them no tables. Valid in
# Spark and in DuckDB; {src} is the raw table.
TEI_SQL = """
SELECT paper_id, concat('<?xml version="1.0" encoding="UTF-8"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title level="a" type="main">Films &amp; layers of <hi>',
  material, '</hi> [1, 2]</title></titleStmt><sourceDesc><title>Not this one</title></sourceDesc></fileDesc><profileDesc><abstract><div><p>Abstract: ', coalesce(trim(substrate), 'bare'),
  '.</p></div></abstract></profileDesc></teiHeader><text><body><!-- <div> --><div xmlns="http://www.tei-c.org/ns/1.0"><head n="1">Introduction</head><p>Nothing of interest.</p></div><div>',
  CASE WHEN length(paper_id) % 2 = 0 THEN '<head n="2">Growth</head>' ELSE '' END, '<p>Sputtering at ', coalesce(power, 'some power'), ' <ref type="bibr">[3]</ref>.</p><div><head>Inner ', material,
  '</head><p/><p>Not to keep.</p><div><p>The chamber was at ', coalesce(working_pressure, 'low pressure'), '.</p></div></div><p>Last  of all, sputtering &#176; ended.</p></div>',
  '<note place="foot"><div><head>Stray</head><p>Sputtering in a note.</p></div></note><div/><div><formula xml:id="f">x</formula><p>Sputtering with ', coalesce(gas_mixture, 'no gas'), '.</p></div>',
  '<figure xml:id="fig_0"><head>Figure</head><row><cell>no</cell></row></figure><figure xmlns="http://www.tei-c.org/ns/1.0" type="table" xml:id="tab_0"><head>Table of <hi>', material,
  '</hi></head><table><row role="label"><cell>Power</cell><cell>', coalesce(power, 'none'), '</cell></row><row><cell>Gas</cell><cell/><cell cols="2">', coalesce(gas_mixture, ''), '</cell></row></table></figure>',
  CASE WHEN length(paper_id) % 3 = 0 THEN concat('<figure type="table"><table><row></row><row><cell>', coalesce(film_thickness, 'thin'), '</cell></row></table></figure>') ELSE '' END,
  '</body><back><div><p>Sputtering in the back.</p></div></back></text></TEI>') AS xml
FROM {src} t
"""


def tei_papers(raw: DataFrame) -> DataFrame:
    """(paper_id, xml) of every raw row."""
    return raw.sparkSession.sql(TEI_SQL, src=raw)
