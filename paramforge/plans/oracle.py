"""DuckDB SQL for each registered query (the correctness oracle).

Plain SQL over the pre-registered table views. It shares the fixed
values (constants) and the derived raw extraction table with the Spark
code, so hand-made expected values in ``tests/`` cover those. Shared pieces (the derived raw extraction
table, the clean and final paper tables) are CTEs prepended to each
query; expression builders below produce SQL text.
"""

from __future__ import annotations

from .. import constants as K
from ..operators import spans as SP
from ..sources.tables import PROSE_SQL, RAW_EXTRACTION_SQL

ORACLE: dict[str, str] = {}

NS = "'Not specified'"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r6(x: str, d: int = 6) -> str:
    return f"round({x}, {d})"


def nullsent(c: str) -> str:
    return f"nullif({c}, {NS})"


def _apply(v: str, op: str, operand: float) -> str:
    return f"({v} {op} {operand!r})"


def _values(x: str, split: str, per_part_lists: str) -> str:
    """Wrap a list expression: null input -> null, empty -> null."""
    return (
        f"(CASE WHEN {x} IS NULL THEN NULL ELSE "
        f"(SELECT CASE WHEN len(_l) = 0 THEN NULL ELSE _l END FROM (SELECT list_filter({per_part_lists}, lambda _v: _v IS NOT NULL) AS _l)) END)"
    )


def parts(x: str, pattern: str = K.SPLIT_PATTERN) -> str:
    return f"regexp_split_to_array(lower({x}), {lit(pattern)})"


def std_pressure(x: str) -> str:
    P = lit(K.PRESSURE_PATTERN)
    qs = f"list_transform({parts(x)}, lambda p: replace(replace(p, ' ', ''), '×', 'x'))"
    ms = (
        f"list_transform({qs}, lambda q: {{'q': q, 'b': regexp_extract(q, {P}, 1), "
        f"'e': regexp_extract(q, {P}, 2), 'u': regexp_extract(q, {P}, 3)}})"
    )
    scaled = " OR ".join(f"contains(m.q, {lit(mk)})" for mk in K.PRESSURE_EXPONENT_MARKS)
    vs = (
        f"list_transform({ms}, lambda m: {{'u': m.u, 'ok': m.b <> '' AND TRY_CAST(m.b AS DOUBLE) IS NOT NULL, "
        f"'base': TRY_CAST(m.b AS DOUBLE), 'scaled': ({scaled}), "
        f"'pw': pow(10.0, CASE WHEN m.e = '' THEN 0.0 ELSE coalesce(TRY_CAST(m.e AS DOUBLE), "
        f"TRY_CAST(nullif(regexp_extract(m.e, '(-?[0-9]+)', 1), '') AS DOUBLE), 0.0) END)}})"
    )
    raw = "(CASE WHEN v.scaled THEN v.base * v.pw ELSE v.base END)"
    conv = " ".join(f"WHEN contains(v.u, {lit(u)}) THEN {_apply(raw, op, val)}" for u, op, val in K.PRESSURE_UNITS)
    per = (
        f"list_transform({vs}, lambda v: CASE WHEN NOT v.ok THEN NULL "
        f"WHEN v.scaled AND isinf(v.pw) THEN NULL ELSE (CASE {conv} ELSE NULL END) END)"
    )
    return _values(x, K.SPLIT_PATTERN, per)


def std_temperature(x: str) -> str:
    P = lit(K.TEMPERATURE_PATTERN)
    qs = f"list_transform({parts(x)}, lambda p: replace(p, ' ', ''))"
    room = " OR ".join(f"contains(q, {lit(mk)})" for mk in K.ROOM_TEMPERATURE_MARKS)
    ms = (
        f"list_transform({qs}, lambda q: {{'room': ({room}), "
        f"'n': regexp_extract(replace(q, '°', ''), {P}, 1), 'u': regexp_extract(replace(q, '°', ''), {P}, 2)}})"
    )
    per = (
        f"list_transform({ms}, lambda m: CASE WHEN m.room THEN {K.ROOM_TEMPERATURE_C!r} "
        f"WHEN m.n = '' OR TRY_CAST(m.n AS DOUBLE) IS NULL THEN NULL "
        f"WHEN m.u = 'k' THEN TRY_CAST(m.n AS DOUBLE) - {K.KELVIN_OFFSET!r} ELSE TRY_CAST(m.n AS DOUBLE) END)"
    )
    return _values(x, K.SPLIT_PATTERN, per)


def _simple_unit(x: str, pattern: str, split: str, units, pre: str) -> str:
    P = lit(pattern)
    qs = f"list_transform({parts(x, split)}, lambda p: {pre})"
    ms = f"list_transform({qs}, lambda q: {{'n': regexp_extract(q, {P}, 1), 'u': regexp_extract(q, {P}, 2)}})"
    conv = " ".join(f"WHEN m.u = {lit(u)} THEN {_apply('TRY_CAST(m.n AS DOUBLE)', op, val)}" for u, op, val in units)
    per = (
        f"list_transform({ms}, lambda m: CASE WHEN m.n = '' OR TRY_CAST(m.n AS DOUBLE) IS NULL THEN NULL "
        f"{conv} ELSE NULL END)"
    )
    return _values(x, split, per)


def std_thickness(x: str) -> str:
    return _simple_unit(x, K.THICKNESS_PATTERN, K.SPLIT_PATTERN, K.THICKNESS_UNITS,
                        pre="replace(replace(p, ' ', ''), 'Å', 'a')")


def std_power(x: str) -> str:
    return _simple_unit(x, K.POWER_PATTERN, K.POWER_SPLIT_PATTERN, K.POWER_UNITS, pre="replace(p, ' ', '')")


def std_gas(x: str) -> str:
    labels = []
    for label, terms in K.GAS_TERMS:
        cond = " OR ".join(f"contains(lower({x}), {lit(t)})" for t in terms)
        labels.append(f"CASE WHEN {cond} THEN {lit(label)} END")
    joined = f"concat_ws('/', {', '.join(labels)})"
    return f"(CASE WHEN {x} IS NULL THEN {lit(K.UNKNOWN_GAS)} WHEN {joined} = '' THEN {lit(K.OTHER_GAS)} ELSE {joined} END)"


def scalar(a: str) -> str:
    return f"(CASE WHEN len({a}) = 1 THEN {a}[1] END)"


def nvals(a: str) -> str:
    return f"CAST(CASE WHEN {a} IS NULL THEN 0 ELSE len({a}) END AS INTEGER)"


def arr_summary(a: str, prefix: str) -> str:
    return f"{nvals(a)} AS {prefix}_n, array_to_string(list_transform({a}, lambda x: printf('%.9e', x)), ', ') AS {prefix}_values"


def contains_any(x: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {lit(k)})" for k in keywords) + ")"


WS = K.PY_WHITESPACE_CLASS


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def py_title(x: str) -> str:
    runs = f"regexp_extract_all({x}, {lit(r'([^\p{L}]+|\p{L}+)')}, 1)"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || lower(w[2:])), '')"


def substrate_norm(x: str) -> str:
    t = py_strip(py_title(x))
    nulls = ", ".join(lit(s) for s in K.SUBSTRATE_NULL_TEXTS)
    return f"(CASE WHEN {x} IS NULL OR {t} IN ({nulls}) THEN NULL ELSE {t} END)"


def substrate_class(x: str) -> str:
    u = f"upper(coalesce({x}, 'None'))"
    whens = [f"WHEN regexp_matches({u}, {lit(p)}) THEN {lit(lbl)}" for lbl, p in reversed(K.SUBSTRATE_CLASSES)]
    lbl, p = K.SUBSTRATE_SILICON
    whens.append(f"WHEN regexp_matches({u}, {lit(p)}) THEN {lit(lbl)}")
    return f"(CASE {' '.join(whens)} ELSE {lit(K.SUBSTRATE_OTHER)} END)"


def number_text(x: str) -> str:
    sci = f"printf('%.14e', {x})"
    plain = f"regexp_replace(regexp_replace(CAST(TRY_CAST({sci} AS DECIMAL(38,20)) AS VARCHAR), '0+$', ''), '\\.$', '.0')"
    small = f"regexp_replace({sci}, '\\.?0+e', 'e')"
    return f"(CASE WHEN {x} = 0 THEN '0.0' WHEN abs({x}) >= 1e-4 AND abs({x}) < 1e15 THEN {plain} ELSE {small} END)"


def render_number(a: str) -> str:
    one = number_text(f"{a}[1]")
    many = f"'[' || array_to_string(list_transform({a}, lambda x: {number_text('x')}), ', ') || ']'"
    return f"(CASE WHEN {a} IS NULL THEN {NS} WHEN len({a}) = 1 THEN {one} ELSE {many} END)"


def render_document() -> str:
    pieces = {
        "material": f"coalesce(material, {NS})",
        "substrate": f"coalesce(substrate, {NS})",
        "method": f"coalesce(method, {NS})",
        "gas": f"coalesce(gas_mixture_std, {NS})",
        "power": render_number("power_w"),
        "working_pressure": render_number("working_pressure_pa"),
        "base_pressure": render_number("base_pressure_pa"),
        "temperature": render_number("temperature_c"),
        "thickness": render_number("thickness_nm"),
    }
    out, rest = [], K.DOCUMENT_TEMPLATE
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            out.append(lit(head))
        out.append(pieces[name])
    if rest:
        out.append(lit(rest))
    return "(" + " || ".join(out) + ")"


MEAS = ["power_w", "working_pressure_pa", "base_pressure_pa", "temperature_c", "thickness_nm"]
EXPLODED = ["power_w", "working_pressure_pa", "temperature_c", "thickness_nm"]
ALIASES = " UNION ALL ".join(f"SELECT {lit(f)} AS family, {lit(m)} AS material" for f, m in K.FAMILY_ALIASES)

BASE_CTES = f"""
raw AS ({RAW_EXTRACTION_SQL.format(src='lineitem')}),
clean AS (
  SELECT paper_id, {nullsent('material')} AS material, {nullsent('substrate')} AS substrate,
         {nullsent('deposition_method')} AS method,
         {std_gas(nullsent('gas_mixture'))} AS gas_mixture_std,
         {std_power(nullsent('power'))} AS power_w,
         {std_pressure(nullsent('working_pressure'))} AS working_pressure_pa,
         {std_pressure(nullsent('base_pressure'))} AS base_pressure_pa,
         {std_temperature(nullsent('temperature'))} AS temperature_c,
         {std_thickness(nullsent('film_thickness'))} AS thickness_nm
  FROM raw),
final AS (SELECT * FROM clean WHERE {contains_any("coalesce(method, '')", K.METHOD_KEYWORDS)}),
aliases AS ({ALIASES}),
fam AS (
  SELECT a.family, f.paper_id, f.material, {substrate_norm('f.substrate')} AS substrate, f.method,
         {', '.join(f'{scalar(f"f.{m}")} AS {m}' for m in MEAS)}
  FROM final f JOIN aliases a ON f.material = a.material),
fam_long AS (
  SELECT family, paper_id, metric, value FROM fam
  UNPIVOT (value FOR metric IN (power_w, temperature_c, working_pressure_pa))
  WHERE value IS NOT NULL)
"""


def with_base(body: str) -> str:
    return f"WITH {BASE_CTES.strip()}\n{body}"


def reg(name: str, body: str, base: bool = True) -> None:
    ORACLE[name] = with_base(body) if base else body


# --- C ----------------------------------------------------------------------
reg("multi_value_split", f"""
SELECT paper_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS part
FROM (SELECT paper_id, {parts('working_pressure')} AS l FROM raw)""")

reg("std_power", f"""
SELECT paper_id, power, {arr_summary(std_power(nullsent('power')), 'power_w')} FROM raw""")

reg("std_pressure", f"""
SELECT paper_id, working_pressure, base_pressure,
  {arr_summary(std_pressure(nullsent('working_pressure')), 'working_pressure_pa')},
  {arr_summary(std_pressure(nullsent('base_pressure')), 'base_pressure_pa')} FROM raw""")

reg("std_temperature", f"""
SELECT paper_id, temperature, {arr_summary(std_temperature(nullsent('temperature')), 'temperature_c')} FROM raw""")

reg("std_thickness", f"""
SELECT paper_id, film_thickness, {arr_summary(std_thickness(nullsent('film_thickness')), 'thickness_nm')} FROM raw""")

reg("std_gas", f"""
SELECT paper_id, gas_mixture, {std_gas(nullsent('gas_mixture'))} AS gas_mixture_std FROM raw""")

reg("papers_clean", f"""
SELECT paper_id, material, substrate, method, gas_mixture_std,
  {', '.join(arr_summary(m, m) for m in MEAS)} FROM clean""")

reg("scalar_view", f"""
SELECT paper_id, {', '.join(f'{r6(scalar(m))} AS {m}' for m in MEAS)} FROM clean""")

reg("numeric_coerce", f"""
SELECT paper_id, {', '.join(f'{r6(f"TRY_CAST({render_number(m)} AS DOUBLE)")} AS {m}' for m in MEAS)} FROM clean""")

EXPLODE_SQL = """
exploded AS (
  SELECT paper_id, p.power_w, w.working_pressure_pa, t.temperature_c, h.thickness_nm
  FROM clean
  LEFT JOIN LATERAL (SELECT unnest(CASE WHEN clean.power_w IS NULL THEN [NULL::DOUBLE] ELSE clean.power_w END) AS power_w) p ON TRUE
  LEFT JOIN LATERAL (SELECT unnest(CASE WHEN clean.working_pressure_pa IS NULL THEN [NULL::DOUBLE] ELSE clean.working_pressure_pa END) AS working_pressure_pa) w ON TRUE
  LEFT JOIN LATERAL (SELECT unnest(CASE WHEN clean.temperature_c IS NULL THEN [NULL::DOUBLE] ELSE clean.temperature_c END) AS temperature_c) t ON TRUE
  LEFT JOIN LATERAL (SELECT unnest(CASE WHEN clean.thickness_nm IS NULL THEN [NULL::DOUBLE] ELSE clean.thickness_nm END) AS thickness_nm) h ON TRUE)
"""
EXPL_COLS = ", ".join(f"{r6(m)} AS {m}" for m in EXPLODED)
NOT_ALL_NULL = "(power_w IS NOT NULL OR working_pressure_pa IS NOT NULL OR thickness_nm IS NOT NULL)"

reg("explode_cross", f", {EXPLODE_SQL.strip()}\nSELECT paper_id, {EXPL_COLS} FROM exploded")
reg("drop_all_null", f", {EXPLODE_SQL.strip()}\nSELECT paper_id, {EXPL_COLS} FROM exploded WHERE {NOT_ALL_NULL}")
reg("thickness_filter", f", {EXPLODE_SQL.strip()}\nSELECT paper_id, {r6('thickness_nm')} AS thickness_nm FROM exploded "
    f"WHERE {NOT_ALL_NULL} AND thickness_nm < {K.THICKNESS_PLOT_LIMIT_NM!r}")

reg("method_filter", "SELECT paper_id, method FROM final")

keep = contains_any("coalesce(method, '')", K.METHOD_KEYWORDS)
reg("filter_report", f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE NOT {keep}) AS BIGINT) AS dropped,
       CAST(count(*) FILTER (WHERE {keep}) AS BIGINT) AS kept FROM clean""")

reg("fill_sentinel", f"""
SELECT coalesce(paper_id, {NS}) AS paper_id, coalesce(material, {NS}) AS material,
       coalesce(substrate, {NS}) AS substrate, coalesce(method, {NS}) AS method FROM final""")

reg("render_document", f"SELECT paper_id, {render_document()} AS document FROM final")

COLLECTION_ROWS = f"""
SELECT CAST(paper_id AS VARCHAR) AS paper_id, {render_document()} AS document,
       coalesce(CAST(material AS VARCHAR), {NS}) AS material, coalesce(CAST(substrate AS VARCHAR), {NS}) AS substrate
FROM final"""
reg("collection_rows", COLLECTION_ROWS)

COLLECTION_CTE = f"""
, crows AS ({COLLECTION_ROWS}),
collection AS (
  SELECT paper_id, document, material, substrate FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY document, material, substrate) AS rn FROM crows)
  WHERE rn = 1)
"""
reg("collection_dedup", COLLECTION_CTE + "SELECT * FROM collection")

# --- D ----------------------------------------------------------------------
reg("family_filter", "SELECT a.family, f.paper_id, f.material FROM final f JOIN aliases a ON f.material = a.material")


def mode_sql(rel: str, col: str, key: str = "family") -> str:
    """Smallest of the most frequent non-null values per key."""
    return f"""(SELECT {key}, {col} AS v FROM (
      SELECT {key}, {col}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {col} ASC) AS rn
      FROM {rel} WHERE {col} IS NOT NULL GROUP BY {key}, {col}) WHERE rn = 1)"""


METRICS = ["power_w", "temperature_c", "working_pressure_pa"]


def consensus_sql(rounded: bool) -> str:
    sel = ["g.family", "g.n_papers"]
    for m in METRICS:
        for stat in ["mean", "median", "mode", "min", "max"]:
            c = f"{m}_{stat}"
            src = f"{m}_mode.v" if stat == "mode" else f"g.{c}"
            sel.append(f"{r6(src) if rounded else src} AS {c}")
    sel.append(f"coalesce(sub_mode.v, {lit(K.NO_DATA)}) AS top_substrate")
    aggs = ["CAST(count(*) AS BIGINT) AS n_papers"]
    for m in METRICS:
        aggs += [f"avg({m}) AS {m}_mean", f"quantile_cont({m}, 0.5) AS {m}_median", f"min({m}) AS {m}_min",
                 f"max({m}) AS {m}_max"]
    joins = " ".join(f"LEFT JOIN {mode_sql('fam', m)} {m}_mode ON {m}_mode.family = g.family" for m in METRICS)
    joins += f" LEFT JOIN {mode_sql('fam', 'substrate')} sub_mode ON sub_mode.family = g.family"
    return f"SELECT {', '.join(sel)} FROM (SELECT family, {', '.join(aggs)} FROM fam GROUP BY family) g {joins}"


reg("consensus", consensus_sql(True))

_disp = []
for m, (d, rd) in {"power_w": (1, 0), "temperature_c": (1, 0), "working_pressure_pa": (4, 4)}.items():
    _disp += [f"CASE WHEN {m}_mean IS NULL THEN {lit(K.NO_DATA)} ELSE 'OK' END AS {m}_status",
              f"round({m}_mean, {d}) AS {m}_mean", f"round({m}_median, {d}) AS {m}_median",
              f"round({m}_mode, {d}) AS {m}_mode", f"round({m}_min, {rd}) AS {m}_min", f"round({m}_max, {rd}) AS {m}_max"]
reg("consensus_display", f"SELECT family, {', '.join(_disp)}, top_substrate FROM ({consensus_sql(False)})")

reg("top_substrate", f"""
SELECT g.family, coalesce(s.v, {lit(K.NO_DATA)}) AS top_substrate
FROM (SELECT DISTINCT family FROM fam) g LEFT JOIN {mode_sql('fam', 'substrate')} s ON s.family = g.family""")

reg("substrate_normalize", f"SELECT paper_id, substrate, {substrate_norm('substrate')} AS substrate_norm FROM final")

reg("substrate_class", f"""
SELECT paper_id, substrate_norm, {substrate_class('substrate_norm')} AS clean_substrate
FROM (SELECT paper_id, {substrate_norm('substrate')} AS substrate_norm FROM final)""")

SUB_COUNTS = f"""
SELECT family, {substrate_class('substrate')} AS clean_substrate, substrate, CAST(count(*) AS BIGINT) AS count
FROM fam WHERE substrate IS NOT NULL GROUP BY ALL"""
reg("substrate_counts", SUB_COUNTS)
reg("substrate_table", f"""
SELECT family, clean_substrate AS category, substrate AS original_name, count AS total_papers
FROM ({SUB_COUNTS}) ORDER BY family, category ASC, total_papers DESC, original_name""")

reg("family_count", """
SELECT family, CAST(count(*) AS BIGINT) AS n_papers, (SELECT CAST(count(*) AS BIGINT) FROM final) AS total_papers
FROM fam GROUP BY family""")


def hist_sql(values_rel: str, n: int, keys: list[str], weight: str = "1") -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    on = " AND ".join(f"v.{c} = r.{c}" for c in keys) or "TRUE"
    on2 = " AND ".join(f"b.{c} = c.{c}" for c in keys + ["bin"])
    kb = ", ".join(f"b.{c}" for c in keys) + (", " if keys else "")
    return f"""
rng0 AS (SELECT {kc}min(value) AS lo, max(value) AS hi FROM {values_rel} WHERE value IS NOT NULL {'GROUP BY ' + k if keys else ''}),
rng AS (SELECT {kc}CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
        FROM rng0 WHERE lo IS NOT NULL),
cnt AS (SELECT {', '.join('v.' + c for c in keys) + (', ' if keys else '')}
          least(CAST(floor((v.value - r.lo) * {n} / (r.hi - r.lo)) AS INTEGER) + 1, {n}) AS bin,
          CAST(sum({weight}) AS BIGINT) AS count
        FROM {values_rel} v JOIN rng r ON {on} WHERE v.value IS NOT NULL GROUP BY ALL),
bins AS (SELECT {kc}lo, hi, CAST(unnest(range(1, {n} + 1)) AS INTEGER) AS bin FROM rng)
SELECT {kb}b.bin, round(b.lo + (b.bin - 1) * ((b.hi - b.lo) / {n}), 6) AS bin_lo,
       round(b.lo + b.bin * ((b.hi - b.lo) / {n}), 6) AS bin_hi, CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM bins b LEFT JOIN cnt c ON {on2}"""


def eda_values_sql(col: str) -> str:
    others = [c for c in EXPLODED if c != col]
    weight = " * ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE len({c}) END)" for c in others)
    cond = "(power_w IS NOT NULL OR working_pressure_pa IS NOT NULL OR thickness_nm IS NOT NULL)"
    extra = f" WHERE value < {K.THICKNESS_PLOT_LIMIT_NM!r}" if col == "thickness_nm" else ""
    return (f"vals AS (SELECT * FROM (SELECT unnest({col}) AS value, CAST({weight} AS BIGINT) AS weight "
            f"FROM clean WHERE {cond} AND {col} IS NOT NULL){extra})")


for key, col in [("hist_power", "power_w"), ("hist_pressure", "working_pressure_pa"),
                 ("hist_temperature", "temperature_c"), ("hist_thickness", "thickness_nm")]:
    reg(key, f", {eda_values_sql(col)},\n{hist_sql('vals', K.EDA_BINS[col], [], 'v.weight').lstrip()}")

reg("hist_family", f", {hist_sql('fam_long', K.DASHBOARD_BINS, ['family', 'metric']).lstrip()}")

QUART = """
SELECT family, metric, CAST(count(*) AS BIGINT) AS n, quantile_cont(value, 0.25) AS q1,
       quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
FROM fam_long GROUP BY family, metric"""
reg("box_quartiles", f"SELECT family, metric, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM ({QUART})")
reg("outlier_fence", f"""
SELECT l.family, l.metric, l.paper_id, round(l.value, 6) AS value
FROM fam_long l JOIN ({QUART}) q ON l.family = q.family AND l.metric = q.metric
WHERE l.value >= q.q1 - 1.5 * (q.q3 - q.q1) AND l.value <= q.q3 + 1.5 * (q.q3 - q.q1)""")


# --- A / B ------------------------------------------------------------------
CITE = K.CITATION_PATTERN


def clean_text(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, {lit(CITE)}, '', 'g'), {lit(WS + '+')}, ' ', 'g'), ' ')"


def strip_tags(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    return out


def relevant(x: str) -> str:
    return contains_any(x, K.PARAGRAPH_KEYWORDS)


def para_texts(fragment: str) -> str:
    pieces = f"regexp_split_to_array({fragment}, '<p(?:\\s[^>]*)?>')[2:]"
    cut = "regexp_replace(s, '(?s)</p>.*$', '')"
    return f"list_transform({pieces}, lambda s: {clean_text(strip_tags(cut))})"


def section_text(t: str) -> str:
    kept = f"list_filter(list_transform(string_split({t}, chr(10)), lambda p: {clean_text('p')}), lambda p: {relevant('p')})"
    return f"(CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') END)"


def strip_suffixes(x: str, suffixes: list[str]) -> str:
    for s in suffixes:
        x = f"replace({x}, {lit(s)}, '')"
    return x


reg("paper_id_from_path", f"""
SELECT page_id, {strip_suffixes(strip_suffixes("regexp_extract(url, '[^/]+$', 0)", K.PAPER_FILE_SUFFIXES), [K.EXTRACTION_FILE_SUFFIX])} AS paper_id
FROM pages""", base=False)

reg("incremental_anti_join", """
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""", base=False)

reg("incremental_report", """
SELECT CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS BIGINT) AS skipped,
       CAST(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS BIGINT) AS new
FROM documents d""", base=False)

reg("json_ingest", """
SELECT event_id, props->>'k' AS k FROM events
WHERE json_valid(props) AND json_type(props::JSON) = 'OBJECT'""", base=False)

reg("clean_text", f"SELECT doc_id, {clean_text('text')} AS text_clean FROM documents", base=False)
reg("keyword_filter", f"SELECT doc_id FROM documents WHERE {relevant('text')}", base=False)
reg("page_title", f"""
SELECT page_id, {clean_text(strip_tags("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"))} AS title FROM pages""",
    base=False)

ARTICLE = "regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"
reg("page_abstract", f"SELECT page_id, coalesce({para_texts(ARTICLE)}[1], '') AS abstract FROM pages", base=False)

BODY = "regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1)"
HEAD = "regexp_extract(b, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)"
reg("section_split", f"""
SELECT page_id, CAST(idx - 1 AS INTEGER) AS section_idx,
       CASE WHEN {HEAD} = '' THEN {lit(K.UNKNOWN_SECTION)} ELSE {clean_text(strip_tags(HEAD))} END AS heading,
       CAST(len({para_texts('b')}) AS INTEGER) AS n_paragraphs
FROM (SELECT page_id, unnest(bl) AS b, unnest(range(1, len(bl) + 1)) AS idx
      FROM (SELECT page_id, regexp_extract_all({BODY}, '(?s)(<(?:div|article)[^>]*>.*?</(?:div|article)>)', 1) AS bl FROM pages))""",
    base=False)

reg("relevant_paragraphs", f"""
SELECT doc_id, pos, paragraph FROM (
  SELECT doc_id, pos, {clean_text('raw')} AS paragraph FROM (
    SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS raw
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
WHERE {relevant('paragraph')}""", base=False)

reg("section_assemble", f"""
SELECT doc_id, source AS heading, {section_text('text')} AS text FROM documents WHERE {section_text('text')} IS NOT NULL""",
    base=False)

reg("list_cells", f"""
SELECT page_id, table_idx, CAST(r AS INTEGER) AS row_idx, 1 AS cell_idx, {clean_text(strip_tags('li'))} AS cell FROM (
  SELECT page_id, table_idx, unnest(lis) AS li, unnest(range(1, len(lis) + 1)) AS r FROM (
    SELECT page_id, CAST(t AS INTEGER) AS table_idx, regexp_extract_all(ul, '(?s)<li[^>]*>(.*?)</li>', 1) AS lis FROM (
      SELECT page_id, unnest(uls) AS ul, unnest(range(1, len(uls) + 1)) AS t
      FROM (SELECT page_id, regexp_extract_all(html, '(?s)<ul[^>]*>(.*?)</ul>', 1) AS uls FROM pages))))""", base=False)

OKP = "coalesce(regexp_matches(html, '(?s)<body[^>]*>.*</body>'), false)"
reg("parse_report", f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE {OKP}) AS BIGINT) AS succeeded,
       CAST(count(*) FILTER (WHERE NOT {OKP}) AS BIGINT) AS failed FROM pages""", base=False)

COMBINED = f"""
combined AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id,
  '' || chr(10) || chr(10) || coalesce({section_text('text')} || chr(10), '') AS combined_text FROM documents),
gated AS (SELECT * FROM combined WHERE length({py_strip('combined_text')}) > 50)
"""
reg("combined_text", f"WITH {COMBINED} SELECT paper_id, combined_text FROM combined", base=False)
reg("length_gate", f"WITH {COMBINED} SELECT paper_id FROM gated", base=False)
_pre, _post = K.EXTRACTION_REQUEST_TEMPLATE.split("{text}")
reg("request_text", f"WITH {COMBINED} SELECT paper_id, {lit(_pre)} || combined_text || {lit(_post)} AS request FROM gated",
    base=False)

FENCED = """
fenced AS (SELECT conv_id, turn, CASE ((conv_id + turn) % 4)
    WHEN 0 THEN '```json' || chr(10) || text || chr(10) || '```'
    WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```'
    WHEN 2 THEN text
    ELSE '```json' || chr(10) || text END AS response
  FROM conversations WHERE role = 'assistant')
"""
_S = py_strip("response")
_body = (f"CASE WHEN starts_with({_S}, '```json') THEN substring({_S}, 8, length({_S}) - 10) "
         f"WHEN starts_with({_S}, '```') THEN substring({_S}, 4, length({_S}) - 6) ELSE {_S} END")
reg("fence_strip", f"WITH {FENCED} SELECT conv_id, turn, nullif({py_strip(_body)}, '') AS cleaned FROM fenced", base=False)

END = r"(?:[^\p{L}\p{N}_]|$)"
RULES = {
    "power": r"([0-9][0-9.]* ?(?:kw|mw|w))" + END,
    "working_pressure": r"([0-9][0-9.]* ?(?:x ?10\^?-?[0-9]+ ?)?(?:mtorr|torr|mbar|pa))" + END,
    "temperature": r"(-?[0-9][0-9.]* ?°? ?(?:c|k)|room temperature)" + END,
    "film_thickness": r"([0-9][0-9.]* ?(?:nm|um|μm|mm))" + END,
    "gas_mixture": r"(?:^|[^\p{L}\p{N}_])(argon|oxygen|nitrogen|hydrogen|ar|o2|n2|h2)" + END,
}


def rule_field(t: str, pattern: str) -> str:
    hits = f"regexp_extract_all(lower({t}), {lit(pattern)}, 1)"
    return f"(CASE WHEN len({hits}) > 0 THEN array_to_string({hits}, ', ') ELSE {NS} END)"


reg("rule_extract", f"WITH {COMBINED} SELECT paper_id, "
    + ", ".join(f"{rule_field('combined_text', p)} AS {n}" for n, p in RULES.items()) + " FROM combined", base=False)


# --- E ----------------------------------------------------------------------

def letter_profile(x: str) -> str:
    counts = f"list_transform(range(26), lambda i: length(lower({x})) - length(replace(lower({x}), chr(97 + CAST(i AS INTEGER)), '')))"
    return (f"(SELECT list_transform(c, lambda n: n / greatest(list_reduce(c, lambda a, b: a + b), 1)) "
            f"FROM (SELECT {counts} AS c))")


def sq_l2(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda s, t: s + t)"


FAMILIES = " UNION ".join(f"SELECT {lit(f)} AS query" for f in dict.fromkeys(f for f, _ in K.FAMILY_ALIASES))


def family_hits_cte(k: int) -> str:
    return f"""{COLLECTION_CTE},
cvec AS (SELECT paper_id, document, material, {letter_profile('document')} AS vec FROM collection),
fq AS (SELECT query, {letter_profile('query')} AS qvec FROM ({FAMILIES})),
scored AS (SELECT fq.query, c.paper_id, c.document, c.material, {sq_l2('fq.qvec', 'c.vec')} AS distance
           FROM cvec c, fq),
hits AS (SELECT * FROM (
   SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, paper_id) AS rank FROM scored)
   WHERE rank <= {k})
"""


HITS_OUT = "SELECT query, CAST(rank AS INTEGER) AS rank, paper_id, material, round(distance, 6) AS distance FROM hits"
reg("knn_top10", family_hits_cte(K.MICRO_K) + HITS_OUT)
reg("knn_top50", family_hits_cte(K.MACRO_K) + HITS_OUT)

reg("knn_batch", f"""
WITH cent AS (
  SELECT label, list(m ORDER BY pos) AS qvec FROM (
    SELECT label, pos, avg(x) AS m FROM (
      SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    GROUP BY label, pos)
  GROUP BY label),
items AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
scored AS (SELECT c.label, i.vec_id, {sq_l2('c.qvec', 'i.vec')} AS distance FROM items i, cent c)
SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM scored)
WHERE rank <= {K.MICRO_K}""", base=False)

reg("retrieved_materials", family_hits_cte(K.MACRO_K) + "SELECT DISTINCT query, material FROM hits")
_request = K.FAMILY_REQUEST_TEMPLATE.replace("{names}", "\0names\0").replace("{family}", "\0family\0").split("\0")
_names = "'[' || string_agg(DISTINCT chr(39) || material || chr(39), ', ' ORDER BY chr(39) || material || chr(39)) || ']'"
reg("family_request", family_hits_cte(K.MACRO_K) + f"SELECT query, {' || '.join({'family': 'query', 'names': 'names'}.get(x, lit(x)) for x in _request)} AS request FROM (SELECT query, {_names} AS names FROM hits GROUP BY query)")
NORM = lambda x: f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
reg("family_alias", family_hits_cte(K.MACRO_K) + f"""
SELECT query AS family, material FROM (SELECT DISTINCT query, material FROM hits)
WHERE {NORM('material')} = {NORM('query')} OR starts_with({NORM('material')}, {NORM('query')})""")

reg("alias_parse", f"""
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, {py_strip('n')} AS name FROM (
  SELECT conv_id, turn, unnest(range(len(l))) AS pos, unnest(l) AS n
  FROM (SELECT conv_id, turn, string_split(text, ',') AS l FROM conversations))""", base=False)

CTX = "SELECT query, CAST(count(*) AS INTEGER) AS n_docs, string_agg(document, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query"
reg("rag_context", family_hits_cte(K.MICRO_K) + CTX)
_a_pre, _a_rest = K.ANSWER_REQUEST_TEMPLATE.split("{context}")
_a_mid, _a_post = _a_rest.split("{question}")
reg("answer_request", family_hits_cte(K.MICRO_K) +
    f"SELECT query, {lit(_a_pre)} || context || {lit(_a_mid)} || query || {lit(_a_post)} AS request FROM ({CTX})")
_s_pre, _s_rest = K.SOURCE_LINE.split("{paper_id}")
_s_mid, _s_post = _s_rest.split("{material}")
reg("rag_sources", family_hits_cte(K.MICRO_K) +
    f"SELECT query, {lit(K.SOURCES_HEADER)} || string_agg({lit(_s_pre)} || paper_id || {lit(_s_mid)} || material || "
    f"{lit(_s_post)}, '' ORDER BY rank) AS sources FROM hits GROUP BY query")


_RULE_RAW = ", ".join(f"{rule_field('combined_text', p)} AS {n}" for n, p in RULES.items())
_RULE_CLEAN = (
    f"SELECT paper_id, {std_gas(nullsent('gas_mixture'))} AS gas_mixture_std, "
    f"{std_power(nullsent('power'))} AS power_w, "
    f"{std_pressure(nullsent('working_pressure'))} AS working_pressure_pa, "
    f"CAST(NULL AS DOUBLE[]) AS base_pressure_pa, "
    f"{std_temperature(nullsent('temperature'))} AS temperature_c, "
    f"{std_thickness(nullsent('film_thickness'))} AS thickness_nm "
    f"FROM (SELECT paper_id, {_RULE_RAW} FROM combined)"
)
reg("rule_papers_clean", f"WITH {COMBINED}, rclean AS ({_RULE_CLEAN}) SELECT paper_id, gas_mixture_std, "
    + ", ".join(arr_summary(m, m) for m in MEAS) + " FROM rclean", base=False)


# --- B15 with positions -----------------------------------------------------
def _span_kind(which: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match(span, {lit('(?i)' + e[2])}) THEN {lit(e[which])}" for e in SP.PATTERNS) + " END"


_MARKED = f"regexp_replace(combined_text, {lit(SP.ANY)}, chr(1) || '\\1' || chr(2), 'g')"
SPAN_CTES = f"""
prose AS (SELECT row_number() OVER () AS k, * FROM ({PROSE_SQL.format(src='raw')})),
pieces AS (SELECT k, string_split({_MARKED}, chr(1)) AS l FROM prose),
piece AS (SELECT k, unnest(l) AS piece, unnest(range(len(l))) AS pos FROM pieces),
place AS (
  SELECT *, CAST(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT) AS s,
    string_split(piece, chr(2))[1] AS span FROM piece),
spans AS (SELECT k, s, s + length(span) AS e, span, {_span_kind(0)} AS quantity, {_span_kind(1)} AS cue FROM place WHERE pos > 0),
near AS (
  SELECT v.k, v.s, v.span, v.quantity, arg_min(c.cue, struct_pack(d := CASE WHEN c.s < v.s THEN v.s - c.e ELSE c.s - v.e END, after := c.s > v.s)) AS cue
  FROM spans v LEFT JOIN spans c ON c.cue <> '' AND c.k = v.k AND c.quantity = v.quantity
    AND CASE WHEN c.s < v.s THEN v.s - c.e ELSE c.s - v.e END <= {SP.REACH}
  WHERE v.cue = '' GROUP BY ALL),
valued AS (SELECT *, coalesce(cue, CASE quantity {' '.join(f"WHEN {lit(q)} THEN {lit(f)}" for q, f in SP.DEFAULT_FIELD.items())} END) AS field FROM near),
told AS (
  SELECT p.paper_id, {', '.join(f"coalesce(string_agg(v.span, ', ' ORDER BY v.s) FILTER (WHERE v.field = '{f}'), {NS}) AS {f}" for f in SP.FIELDS)}
  FROM prose p LEFT JOIN valued v ON p.k = v.k GROUP BY p.k, p.paper_id)"""
reg("span_extract", f"WITH raw AS ({RAW_EXTRACTION_SQL.format(src='lineitem')}), {SPAN_CTES} SELECT * FROM told", base=False)
reg("span_method_papers", f"""
WITH raw AS ({RAW_EXTRACTION_SQL.format(src='lineitem')}), {SPAN_CTES},
tclean AS (SELECT paper_id, {nullsent('material')} AS material, {nullsent('substrate')} AS substrate, {nullsent('deposition_method')} AS method,
  {std_pressure(nullsent('base_pressure'))} AS base_pressure_pa, {std_pressure(nullsent('working_pressure'))} AS working_pressure_pa FROM told)
SELECT paper_id, material, substrate, method, {arr_summary('base_pressure_pa', 'base_pressure_pa')}, {arr_summary('working_pressure_pa', 'working_pressure_pa')}
FROM tclean WHERE {contains_any("coalesce(method, '')", K.METHOD_KEYWORDS)}""", base=False)

# TEI papers: what TEI_SQL wrote is told from the raw rows, nothing is parsed
TEI_RAW = f"WITH raw AS ({RAW_EXTRACTION_SQL.format(src='lineitem')})"
TEI_TITLE = "concat('Films & layers of ', material)"
TEI_ABSTRACT = "concat('Abstract: ', coalesce(trim(substrate), 'bare'), '.')"
TEI_GROWTH = """concat('Sputtering at ', coalesce(power, 'some power'), ' . The chamber was at ', coalesce(working_pressure, 'low pressure'), '. Last of all, sputtering ° ended.')"""
TEI_GAS = "concat('Sputtering with ', coalesce(gas_mixture, 'no gas'), '.')"
reg("tei_heads", f"""{TEI_RAW}
SELECT paper_id, true AS ok, {TEI_TITLE} AS title, {TEI_ABSTRACT} AS abstract, 2 AS n_sections,
       CASE WHEN length(paper_id) % 3 = 0 THEN 2 ELSE 1 END AS n_tables FROM raw""", base=False)
reg("tei_sections", f"""{TEI_RAW}
SELECT paper_id, 0 AS section_idx, CASE WHEN length(paper_id) % 2 = 0 THEN 'Growth' ELSE concat('Inner ', material) END AS heading, {TEI_GROWTH} AS text FROM raw
UNION ALL SELECT paper_id, 1, {lit(K.UNKNOWN_SECTION)}, {TEI_GAS} FROM raw""", base=False)
reg("tei_cells", f"""{TEI_RAW}, two AS (SELECT * FROM raw WHERE length(paper_id) % 3 = 0)
SELECT paper_id, 1 AS table_idx, 0 AS row_idx, 1 AS cell_idx, {lit(K.CAPTION_MARK)} AS cell FROM raw
UNION ALL SELECT paper_id, 1, 0, 2, concat('Table of ', material) FROM raw
UNION ALL SELECT paper_id, 1, 1, 1, 'Power' FROM raw UNION ALL SELECT paper_id, 1, 1, 2, coalesce(power, 'none') FROM raw
UNION ALL SELECT paper_id, 1, 2, 1, 'Gas' FROM raw UNION ALL SELECT paper_id, 1, 2, 2, '' FROM raw UNION ALL SELECT paper_id, 1, 2, 3, coalesce(gas_mixture, '') FROM raw
UNION ALL SELECT paper_id, 2, 1, 1, NULL FROM two UNION ALL SELECT paper_id, 2, 2, 1, coalesce(film_thickness, 'thin') FROM two""", base=False)
reg("tei_combined_text", f"""{TEI_RAW}
SELECT paper_id, concat({TEI_ABSTRACT}, chr(10), chr(10), {TEI_GROWTH}, chr(10), {TEI_GAS}, chr(10)) AS combined_text FROM raw""", base=False)


# --- E: text search -----------------------------------------------------------

def weights_cte(src: str, key: str, text: str) -> str:
    """tc, ts, tw: token counts, statistics and weights of ``src``."""
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    return f"""
tc AS (SELECT {key}, token, length(bin(count(*))) AS bits FROM (SELECT {key}, unnest({words}) AS token FROM {src}) GROUP BY ALL),
ts AS (SELECT token, count(*) AS df, CAST(round(1000 * ln(((SELECT count(*) FROM {src}) + 1) / (count(*) + 1))) AS BIGINT) AS idf FROM tc GROUP BY token),
tx AS (SELECT {key}, token, bits * idf AS x FROM tc JOIN ts USING (token) WHERE idf > 0),
tn AS (SELECT {key}, sqrt(CAST(sum(x * x) AS DOUBLE)) AS norm FROM tx GROUP BY {key}),
tw AS (SELECT {key}, token, CAST(floor(65536 * x / norm) AS BIGINT) AS weight FROM tx JOIN tn USING ({key}))
"""


def hits_cte(key: str, asked: str, k: int) -> str:
    """thits: the k best texts of each row of ``asked`` (query, qtext)."""
    words = "list_filter(regexp_split_to_array(lower(qtext), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
    return f"""
qx AS (SELECT query, token, length(bin(count(*))) * any_value(idf) AS x FROM (SELECT query, unnest({words}) AS token FROM ({asked})) JOIN ts USING (token) WHERE idf > 0 GROUP BY ALL),
qn AS (SELECT query, sqrt(CAST(sum(x * x) AS DOUBLE)) AS norm FROM qx GROUP BY query),
scores AS (SELECT query, {key}, CAST(sum(x * weight) AS BIGINT) AS score FROM qx JOIN tw USING (token) GROUP BY ALL),
thits AS (SELECT query, {key}, score, round(score / (norm * 65536), 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, {key}) AS rank FROM scores) JOIN qn USING (query) WHERE rank <= {k})
"""


_TW = weights_cte("collection", "paper_id", "document")
reg("embed_tokens", COLLECTION_CTE + f", {_TW} SELECT paper_id, token, weight FROM tw")
for _name, _k in (("text_top10", K.MICRO_K), ("text_top50", K.MACRO_K)):
    reg(_name, COLLECTION_CTE + f", {_TW}, {hits_cte('paper_id', f'SELECT query, query AS qtext FROM ({FAMILIES})', _k)}"
        "SELECT query, rank, paper_id, material, score, cosine FROM thits JOIN collection USING (paper_id)")
reg("similar_documents", f"WITH {weights_cte('documents', 'doc_id', 'text')}, "
    + hits_cte("doc_id", "SELECT doc_id AS query, text AS qtext FROM documents WHERE doc_id % 50 = 0", K.MICRO_K)
    + "SELECT query, rank, doc_id, score, cosine FROM thits", base=False)

# the families as they should come out, by hand
_VARIANT = "material"
for _n, _others in K.NAME_VARIANTS:
    for _i, _o in enumerate(_others):
        _VARIANT = f"CASE WHEN material = {lit(_n)} AND CAST(regexp_extract(paper_id, '/([0-9]+)', 1) AS BIGINT) % 12 = {_i} THEN {lit(_o)} ELSE {_VARIANT} END"
_OF = dict(K.FAMILY_ALIASES and [(m, f) for f, m in K.FAMILY_ALIASES]) | {o: dict((m, f) for f, m in K.FAMILY_ALIASES)[n] for n, others in K.NAME_VARIANTS for o in others}
_GROUP = "CASE name " + " ".join(f"WHEN {lit(n)} THEN {lit(f)}" for n, f in _OF.items()) + " ELSE name END"
reg("family_groups", f""", named AS (SELECT {_VARIANT} AS name FROM raw WHERE material IS NOT NULL),
counted AS (SELECT name, {_GROUP} AS g, count(*) AS n FROM named GROUP BY ALL)
SELECT name, n, first_value(name) OVER (PARTITION BY g ORDER BY n DESC, name) AS family FROM counted""")
reg("family_dashboard", consensus_sql(True))
