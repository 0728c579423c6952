"""Analytics of the macro view.

Shape of the plans:

* The family filter is a join with the alias table. The alias table is
  tiny and bounded (``MAX_ALIAS_ROWS`` checked), so it is broadcast: no
  shuffle of the paper table.
* All families are treated at once: ``avg/min/max`` by one partially
  aggregated ``groupBy(family)``; medians, quartiles and modes from counts
  per (family, metric, value), so no task holds the values of a family.
  ``exact=False`` uses sketches of a fixed size.
* Histograms: one aggregate gives min/max (a single row, broadcast; per
  group, a small table AQE broadcasts by measured size), a second counts
  per bin. Lists are not cross-exploded: a value of column
  X is weighted by the product of the other exploded list sizes, which
  gives the same counts as the four chained explodes with far fewer rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import py_strip, py_title
from .clean import DROP_ALL_NULL, EXPLODED

MAX_ALIAS_ROWS = 100_000
FAMILY_METRICS = ["power_w", "temperature_c", "working_pressure_pa"]


def alias_table(spark, aliases=K.FAMILY_ALIASES) -> DataFrame:
    """(family, material) pairs as a DataFrame."""
    return spark.createDataFrame(list(aliases), "family string, material string")


def _bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a side only when its size is proven small; otherwise let
    the planner (AQE uses measured sizes) pick the join."""
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


def family_filter(papers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Papers whose material is one of a family's names (exact match)."""
    a = _bounded_broadcast(aliases.select("family", "material").distinct(), MAX_ALIAS_ROWS)
    return papers.join(a, on="material", how="inner")


def substrate_normalize(col: Column | str) -> Column:
    """Python title case, strip; 'Nan' / 'Not Specified' -> null."""
    c = F.col(col) if isinstance(col, str) else col
    t = py_strip(py_title(c))
    return F.when(c.isNull() | t.isin(*K.SUBSTRATE_NULL_TEXTS), F.lit(None).cast("string")).otherwise(t)


def substrate_class(col: Column | str) -> Column:
    """Class of a (normalised) substrate text; later assignments of the
    original overwrite earlier ones, so the CASE runs in reverse order."""
    c = F.col(col) if isinstance(col, str) else col
    u = F.upper(F.coalesce(c, F.lit("None")))
    expr = None
    for label, pattern in reversed(K.SUBSTRATE_CLASSES):
        expr = F.when(u.rlike(pattern), F.lit(label)) if expr is None else expr.when(u.rlike(pattern), F.lit(label))
    label, pattern = K.SUBSTRATE_SILICON
    return expr.when(u.rlike(pattern), F.lit(label)).otherwise(F.lit(K.SUBSTRATE_OTHER))


def family_rows(papers_scalar: DataFrame, aliases: DataFrame) -> DataFrame:
    """Family members with the normalised substrate (the dashboard frame)."""
    return family_filter(papers_scalar, aliases).withColumn("substrate", substrate_normalize("substrate"))


QUANTILE_BINS = 4096


def value_counts(long: DataFrame) -> DataFrame:
    """(family, metric, value, n): shuffled by value, so a frequent family is
    spread and a frequent value is summed before the shuffle."""
    return long.groupBy("family", "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(counts: DataFrame, probs: list[float]) -> DataFrame:
    """(family, metric, p, quantile) with linear interpolation.

    Counts per equal-width bin (at most ``QUANTILE_BINS`` rows a group)
    locate the bins that hold the wanted ranks; only the values of these
    bins are ordered. The ranges are one row per family and metric.
    """
    keys = ["family", "metric"]
    rng = F.broadcast(counts.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total")))
    at = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * QUANTILE_BINS)
    binned = counts.join(rng, keys).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(at, F.lit(QUANTILE_BINS - 1))).otherwise(F.lit(0)))
    by_bin = binned.groupBy(*keys, "bin", "total").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.partitionBy(*keys).orderBy("bin")) - F.col("n")
    want = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), (F.lit(p) * (F.col("total") - 1)).alias("h")) for p in probs]))
    ranks = by_bin.withColumn("before", before).select("*", want.alias("w"))
    ranks = ranks.select(*keys, "bin", "before", "n", F.col("w.p").alias("p"), F.col("w.h").alias("h"), F.explode(F.array(F.floor("w.h"), F.ceil("w.h"))).alias("rank")).distinct()
    ranks = ranks.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).drop("n")
    wanted = F.broadcast(ranks)  # two rows per probability, family and metric
    inside = binned.select(*keys, "bin", "value", "n").join(F.broadcast(ranks.select(*keys, "bin", "before").distinct()), [*keys, "bin"])
    start = F.col("before") + F.sum("n").over(W.partitionBy(*keys, "bin").orderBy("value")) - F.col("n")
    found = inside.withColumn("start", start).drop("before").join(wanted, [*keys, "bin"]).filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n")))
    lo, hi = F.min_by("value", "rank"), F.max_by("value", "rank")
    part = F.first(F.col("h") - F.floor("h"))
    return found.groupBy(*keys, "p").agg((lo + part * (hi - lo)).alias("quantile"))


def exact_modes(counts: DataFrame) -> DataFrame:
    """(family, metric, mode): the smallest of the most frequent values."""
    return counts.groupBy("family", "metric").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m")).select("family", "metric", F.col("m.value").alias("mode"))


def consensus(family: DataFrame, exact: bool = True, metrics: list[str] = FAMILY_METRICS) -> DataFrame:
    """Per family the paper count, mean / median / mode / min /
    max of each metric and the top substrate. ``exact`` false: sketches of a
    fixed size for median and mode."""
    aggs = [F.count(F.lit(1)).alias("n_papers")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
        if not exact:
            aggs += [F.percentile_approx(m, 0.5, 10000).alias(f"{m}_median"), F.expr(f"approx_top_k(`{m}`, 1)")[0]["item"].alias(f"{m}_mode")]
    out = family.groupBy("family").agg(*aggs)
    if exact:
        counts = value_counts(family_long(family, metrics))
        both = exact_quantiles(counts, [0.5]).join(exact_modes(counts), ["family", "metric"])
        wide = both.groupBy("family").pivot("metric", metrics).agg(F.first("quantile").alias("median"), F.first("mode").alias("mode"))
        out = out.join(wide, "family", "left")
    out = out.join(top_substrate(family), "family", "left")
    return out.select("family", "n_papers", *[f"{m}_{s}" for m in metrics for s in ("mean", "median", "mode", "min", "max")], "top_substrate")


def consensus_display(cons: DataFrame) -> DataFrame:
    """Display rounding — power / temperature 1 decimal and range 0,
    pressure 4; status 'No Data' when the mean is missing."""
    digits = {"power_w": (1, 0), "temperature_c": (1, 0), "working_pressure_pa": (4, 4)}
    cols = [F.col("family")]
    for m, (d, rd) in digits.items():
        cols += [
            F.when(F.col(f"{m}_mean").isNull(), F.lit(K.NO_DATA)).otherwise(F.lit("OK")).alias(f"{m}_status"),
            F.round(f"{m}_mean", d).alias(f"{m}_mean"),
            F.round(f"{m}_median", d).alias(f"{m}_median"),
            F.round(f"{m}_mode", d).alias(f"{m}_mode"),
            F.round(f"{m}_min", rd).alias(f"{m}_min"),
            F.round(f"{m}_max", rd).alias(f"{m}_max"),
        ]
    cols.append(F.col("top_substrate"))
    return cons.select(*cols)


def top_substrate(family: DataFrame) -> DataFrame:
    """Most common normalised substrate per family, else 'No Data'."""
    counts = family.groupBy("family", "substrate").agg(F.count("substrate").alias("n"))  # 0 for the null substrate
    first = F.min(F.struct((-F.col("n")).alias("n"), "substrate")).alias("m")
    return counts.groupBy("family").agg(first).select("family", F.coalesce("m.substrate", F.lit(K.NO_DATA)).alias("top_substrate"))


def substrate_counts(family: DataFrame) -> DataFrame:
    """Count per (family, class, original substrate); rows without
    a substrate fall out as in a pandas groupby."""
    return (
        family.filter(F.col("substrate").isNotNull())
        .withColumn("clean_substrate", substrate_class("substrate"))
        .groupBy("family", "clean_substrate", "substrate")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def substrate_table(counts: DataFrame) -> DataFrame:
    """Renamed and sorted: category asc, total desc (substrate breaks ties)."""
    return counts.select(
        "family",
        F.col("clean_substrate").alias("category"),
        F.col("substrate").alias("original_name"),
        F.col("count").alias("total_papers"),
    ).orderBy(F.col("family"), F.col("category").asc(), F.col("total_papers").desc(), F.col("original_name"))


def family_count(family: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers per family next to the whole-table count."""
    total = papers.agg(F.count(F.lit(1)).alias("total_papers"))
    per = family.groupBy("family").agg(F.count(F.lit(1)).alias("n_papers"))
    return per.crossJoin(F.broadcast(total))  # one-row side


# --- histograms -------------------------------------------------------------

def _bin_of(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """1-based equal-width bin; the top edge belongs to the last bin."""
    return F.least(F.floor((x - lo) * F.lit(n) / (hi - lo)).cast("int") + 1, F.lit(n))


def _widen(lo: Column, hi: Column):
    """lo == hi: widen by 0.5 on each side (numpy's rule)."""
    same = lo == hi
    return F.when(same, lo - 0.5).otherwise(lo), F.when(same, hi + 0.5).otherwise(hi)


def histogram(values: DataFrame, n_bins: int, keys: list[str] | None = None,
              value: str = "value", weight: str | None = None) -> DataFrame:
    """Equal-width histogram of ``value`` over its own min..max per key
    group, with every bin present (zero counts included). ``weight``
    counts a row that many times. Empty input -> no rows.
    """
    keys = keys or []
    v = values.filter(F.col(value).isNotNull())
    w = F.col(weight) if weight else F.lit(1)
    rng = v.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = _widen(F.col("lo"), F.col("hi"))
    # a global aggregate of empty input is one all-null row: drop it
    rng = rng.filter(F.col("lo").isNotNull()).select(*keys, lo.alias("lo"), hi.alias("hi"))
    # The ranges are one row per key group (callers group by family and
    # metric: no more rows than the alias table has, times the metrics).
    joined = v.join(F.broadcast(rng), on=keys, how="inner") if keys else v.crossJoin(F.broadcast(rng))
    counts = joined.groupBy(*keys, _bin_of(F.col(value), F.col("lo"), F.col("hi"), n_bins).alias("bin")).agg(
        F.sum(w).cast("bigint").alias("count")
    )
    bins = rng.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(n_bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(n_bins)
    out = bins.join(counts, on=keys + ["bin"], how="left").select(
        *keys,
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
        (F.col("lo") + F.col("bin") * width).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
    )
    return out


def _size1(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit(1)).otherwise(F.size(c))


def eda_values(papers: DataFrame, column: str) -> DataFrame:
    """Values of one measurement as the EDA plot sees them after the four
    chained explodes and the C11 drop, without building the cross product:
    each value carries weight = product of the other exploded list sizes."""
    keep = None
    for c in DROP_ALL_NULL:
        keep = F.col(c).isNotNull() if keep is None else (keep | F.col(c).isNotNull())
    weight = F.lit(1)
    for c in EXPLODED:
        if c != column:
            weight = weight * _size1(c)
    out = papers.filter(keep & F.col(column).isNotNull()).select(
        F.explode(column).alias("value"), weight.cast("bigint").alias("weight")
    )
    if column == "thickness_nm":
        out = out.filter(F.col("value") < F.lit(K.THICKNESS_PLOT_LIMIT_NM))  # C13
    return out


def eda_histogram(papers: DataFrame, column: str) -> DataFrame:
    """EDA histogram of one measurement (40 bins; temperature 30)."""
    return histogram(eda_values(papers, column), K.EDA_BINS[column], weight="weight")


def family_long(family: DataFrame, metrics: list[str] = FAMILY_METRICS) -> DataFrame:
    """(family, paper_id, metric, value) for the non-null scalar metrics."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return family.selectExpr("family", "paper_id", f"stack({len(metrics)}, {pairs}) AS (metric, value)").filter(
        F.col("value").isNotNull()
    )


def family_histogram(family: DataFrame, n_bins: int = K.DASHBOARD_BINS) -> DataFrame:
    """50 equal bins per (family, metric)."""
    return histogram(family_long(family), n_bins, keys=["family", "metric"])


def box_quartiles(family: DataFrame, exact: bool = True) -> DataFrame:
    """D3: quartiles per (family, metric) (linear interpolation)."""
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    long = family_long(family)
    if not exact:
        q = F.percentile_approx(F.col("value"), F.array(*[F.lit(p) for p in names]), 10000).alias("_q")
        return long.groupBy("family", "metric").agg(F.count(F.lit(1)).alias("n"), q).select("family", "metric", "n", *[F.col("_q")[k].alias(x) for k, x in enumerate(names.values())])
    counts = value_counts(long)
    q = exact_quantiles(counts, list(names)).groupBy("family", "metric").agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(x) for p, x in names.items()])
    return counts.groupBy("family", "metric").agg(F.sum("n").alias("n")).join(q, ["family", "metric"]).select("family", "metric", "n", *names.values())


def outlier_fence(family: DataFrame, k: float = 1.5, exact: bool = True) -> DataFrame:
    """D15 (optional, off in the dashboard): values inside the
    ``[q1 - k*IQR, q3 + k*IQR]`` fences per (family, metric)."""
    q = box_quartiles(family, exact).select("family", "metric", "q1", "q3")
    iqr = F.col("q3") - F.col("q1")
    return (
        family_long(family)
        .join(F.broadcast(q), on=["family", "metric"])  # one row per family and metric
        .filter((F.col("value") >= F.col("q1") - k * iqr) & (F.col("value") <= F.col("q3") + k * iqr))
        .select("family", "metric", "paper_id", "value")
    )
