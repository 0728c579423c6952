"""Standardisation and cleaning operators.

All operators are ``DataFrame -> DataFrame``; all are map-only except the
dedup (a count per id and one partially aggregated ``groupBy``) and the report (one global
aggregate).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import units as U
from ..functions.text import contains_any

MEASUREMENTS = ["power_w", "working_pressure_pa", "base_pressure_pa", "temperature_c", "thickness_nm"]
# The four columns the EDA explodes (base pressure is not one of them).
EXPLODED = ["power_w", "working_pressure_pa", "temperature_c", "thickness_nm"]
# C11: a row is dropped when all three are null (temperature not considered).
DROP_ALL_NULL = ["power_w", "working_pressure_pa", "thickness_nm"]
MAX_REPEATED_KEYS = 100_000  # repeated ids broadcast by the dedup


def null_sentinel(col: str) -> Column:
    """The whole-cell sentinel 'Not specified' is null (exact case only)."""
    return F.nullif(F.col(col), F.lit(K.NOT_SPECIFIED))


def papers_clean(raw: DataFrame, angstrom: bool = False) -> DataFrame:
    """C8 (+C2-C6): raw extraction rows -> clean paper rows.

    Measurements are ``array<double>`` (null = none, one element = a
    scalar, more = a list).
    """
    return raw.select(
        F.col("paper_id"),
        null_sentinel("material").alias("material"),
        null_sentinel("substrate").alias("substrate"),
        null_sentinel("deposition_method").alias("method"),
        U.std_gas(null_sentinel("gas_mixture")).alias("gas_mixture_std"),
        U.std_power(null_sentinel("power")).alias("power_w"),
        U.std_pressure(null_sentinel("working_pressure")).alias("working_pressure_pa"),
        U.std_pressure(null_sentinel("base_pressure")).alias("base_pressure_pa"),
        U.std_temperature(null_sentinel("temperature")).alias("temperature_c"),
        U.std_thickness(null_sentinel("film_thickness"), angstrom=angstrom).alias("thickness_nm"),
    )


def scalar_view(papers: DataFrame) -> DataFrame:
    """The table as the dashboard reads it — each measurement is a
    double when exactly one value was parsed, else null."""
    cols = [U.scalar_of(c).alias(c) if c in MEASUREMENTS else F.col(c) for c in papers.columns]
    return papers.select(*cols)


def numeric_coerce(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text -> double, anything unparsable -> null."""
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def method_mask(df: DataFrame, keywords: list[str] = K.METHOD_KEYWORDS, column: str = "method") -> Column:
    """C14 predicate: lower-cased method (null -> '') contains a keyword."""
    return contains_any(F.coalesce(F.col(column), F.lit("")), keywords)


def method_filter(df: DataFrame, keywords: list[str] = K.METHOD_KEYWORDS, column: str = "method") -> DataFrame:
    """C14: keep rows whose deposition method names a sputtering technique."""
    require_columns(df, [column])
    return df.filter(method_mask(df, keywords, column))


def filter_report(df: DataFrame, keywords: list[str] = K.METHOD_KEYWORDS, column: str = "method") -> DataFrame:
    """Original / dropped / kept counts in one aggregate pass."""
    require_columns(df, [column])
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(method_mask(df, keywords, column)).alias("kept"))
    return counts.select("total", (F.col("total") - F.col("kept")).alias("dropped"), "kept")


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """Schema-only check on the driver; names the available columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; available columns are: {list(df.columns)}")


def fill_sentinel(df: DataFrame, value: str = K.NOT_SPECIFIED, cols: list[str] | None = None) -> DataFrame:
    """C17: nulls of string columns -> a text."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.na.fill(value, subset=cols)


def explode_cross(papers: DataFrame) -> DataFrame:
    """Explode the four list columns one after another (a paper
    contributes the cross product of its lists). Kept as the plain
    operator; the histograms use the weighted form instead. Rows per paper
    are the product of its four list lengths, each bounded by the parts of
    one text field; no rows of different papers are ever paired."""
    out = papers
    for c in EXPLODED:
        out = out.withColumn(c, F.explode_outer(c))
    return out


def drop_all_null(df: DataFrame, cols: list[str] = DROP_ALL_NULL) -> DataFrame:
    """C11: drop rows where all the given columns are null."""
    return df.na.drop(how="all", subset=cols)


def thickness_filter(df: DataFrame, limit: float = K.THICKNESS_PLOT_LIMIT_NM, column: str = "thickness_nm") -> DataFrame:
    """Keep ``thickness < limit`` (nulls fail)."""
    return df.filter(F.col(column) < F.lit(limit))


# --- collection rows (C18, C19, A11) ---------------------------------------

def number_text(x: Column) -> Column:
    """A number with 15 significant digits, no trailing zeros: ``200.0``,
    ``0.133322``, ``1.33322e-07`` (scientific below 1e-4 and from 1e15)."""
    size = F.abs(x)

    def rounded() -> Column:
        sci = F.format_string("%.14e", x)
        plain = F.regexp_replace(F.regexp_replace(sci.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
        return F.when((size >= 1e-4) & (size < 1e15), plain).otherwise(F.regexp_replace(sci, r"\.?0+e", "e"))

    # the shortest text of a double, if it has no more than 15 digits, is the rounded one
    def short(t: Column) -> Column:
        return F.when((size >= 1e-3) & (size < 1e7) & (F.length(t) <= 16), t).when(x == 0, F.lit("0.0")).otherwise(rounded())

    return U.bound(x.cast("string"), short)


def render_number(values: Column | str) -> Column:
    """Numbers inside rendered sentences: a single value, ``[a, b]`` for a
    list, 'Not specified' for none."""
    v = F.col(values) if isinstance(values, str) else values
    texts = F.array_join(F.transform(v, number_text), ", ")
    shown = U.bound(texts, lambda t: F.when(F.size(v) == 1, t).otherwise(F.concat(F.lit("["), t, F.lit("]"))))
    return F.when(v.isNull(), F.lit(K.NOT_SPECIFIED)).otherwise(shown)


def render_document(papers: DataFrame) -> Column:
    """One sentence per paper row with nine of its columns."""
    s = lambda c: F.coalesce(F.col(c), F.lit(K.NOT_SPECIFIED))
    pieces = {
        "material": s("material"),
        "substrate": s("substrate"),
        "method": s("method"),
        "gas": s("gas_mixture_std"),
        "power": render_number("power_w"),
        "working_pressure": render_number("working_pressure_pa"),
        "base_pressure": render_number("base_pressure_pa"),
        "temperature": render_number("temperature_c"),
        "thickness": render_number("thickness_nm"),
    }
    # split the template at its {placeholders} and concatenate in order
    out: list[Column] = []
    rest = K.DOCUMENT_TEMPLATE
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            out.append(F.lit(head))
        out.append(pieces[name])
    if rest:
        out.append(F.lit(rest))
    return F.concat(*out)


def collection_rows(papers: DataFrame) -> DataFrame:
    """C19 (+C17, C18): collection items — id, document, metadata strings."""
    return papers.select(
        F.col("paper_id").cast("string").alias("paper_id"),
        render_document(papers).alias("document"),
        F.coalesce(F.col("material").cast("string"), F.lit(K.NOT_SPECIFIED)).alias("material"),
        F.coalesce(F.col("substrate").cast("string"), F.lit(K.NOT_SPECIFIED)).alias("substrate"),
    )


def collection_dedup(items: DataFrame, key: str = "paper_id", order: list[str] | None = None,
                     build: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One item per id; among duplicates the smallest by ``order``
    (default: the document text, then the metadata) is kept. With ``build``,
    which makes an item of each row or drops it, the rows are told apart
    before they are built.

    Ids are counted first, without the documents. Items whose id comes once
    are passed on as they are; only those of repeated ids are compared, by a
    ``groupBy`` with ``min(struct)``. It is partially aggregated map-side, so
    a hot id never lands whole in one task (a window would sort it there), but
    Spark sorts the rows it reads: where more than ``MAX_REPEATED_KEYS`` ids
    are repeated, all items take this way.
    """
    build = build or (lambda df: df)
    made = build(items)
    order = order or [c for c in made.columns if c != key]

    def smallest(df: DataFrame) -> DataFrame:
        picked = df.groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first"))
        return picked.select(F.col(key), *[F.col(f"_first.{c}").alias(c) for c in order])

    counts = made.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = counts.where(F.col("_n") > 1).select("_key").checkpoint()
    if repeated.count() > MAX_REPEATED_KEYS:
        return smallest(made)
    same = F.col(key).eqNullSafe(F.col("_key"))
    once = build(items.join(F.broadcast(repeated), same, "left_anti")).select(key, *order)
    return once.unionByName(smallest(build(items.join(F.broadcast(repeated), same, "left_semi"))))
