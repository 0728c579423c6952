"""Quality rules by robust multivariate outliers (minimum covariance
determinant).

Every text becomes a vector of transformed statistics. For each language
and source the location and scatter of the clean majority are estimated by
the minimum covariance determinant (MCD): from deterministic robust starts,
concentration steps keep the ``h_share`` of rows with the smallest
Mahalanobis distance and re-estimate, which never raises the determinant;
the start with the least determinant wins. Texts whose distance passes the
chi-square limit are rejected.

All rows take part in every step. A step is two Spark aggregations over a
table of small integers: distances are quantised, so the exact h-quantile
is an aggregate over a bounded number of distinct values, and sums of
integer products are exact, so the result does not depend on how rows are
partitioned. Only one row per group and start is ever inverted.

Groups with fewer than ``min_rows`` rows use their language's estimate, or
that of all rows. Null languages and sources are groups of their own.
Texts without a word take no part in the fit (they fail the base rules).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramforge.llm.common import Scratch, nested
from paramforge.llm.textstats import with_stats

#: Feature values are kept as integers of 1/UNIT.
UNIT = 1000


def features() -> list[tuple[str, Column, float]]:
    """(name, transformed statistic, floor of its standard deviation). The
    added constants keep shares of short texts from jumping."""
    c = F.col
    chars = c("word_chars") + F.lit(100.0)
    return [
        ("symbols", F.log1p(F.lit(100.0) * c("n_symbols") / chars), 0.25),
        ("dup_lines", F.log1p(F.lit(20.0) * c("n_dup_lines") / (c("n_lines") + F.lit(10.0))), 0.45),
        ("repeats", F.log1p(F.lit(20.0) * c("n_repeat_words") / (c("n_words") + F.lit(20.0))), 0.45),
        ("upper", F.log1p(F.lit(20.0) * c("n_upper") / chars), 0.15),
        ("word_length", F.log((c("word_chars") + F.lit(250.0)) / (c("n_words") + F.lit(50.0))), 0.10),
        ("punctuation", F.log1p(F.lit(20.0) * c("n_punct") / chars), 0.15),
    ]


@dataclass(frozen=True)
class Params:
    h_share: float = 0.75  # rows that a concentration step keeps
    tail: float = 1e-6  # chi-square tail beyond which a text is an outlier
    min_rows: int = 120  # a smaller group uses its language's estimate
    max_steps: int = 8  # concentration steps at most; ends when no determinant falls


NAMES = ["symbols", "dup_lines", "repeats", "upper", "word_length", "punctuation"]
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi2_quantile(prob: float, dof: int) -> float:
    """Wilson and Hilferty's approximation."""
    z, k = NormalDist().inv_cdf(prob), 2 / (9 * dof)
    return dof * (1 - k + z * math.sqrt(k)) ** 3


def vectors(stats: DataFrame) -> DataFrame:
    """Statistics with the group keys and integer features ``x0``.."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    return stats.withColumns({"_lang": key("lang"), "_source": key("source")} | {f"x{k}": F.round(e * UNIT).cast("long") for k, (_, e, _) in enumerate(features())})


def solve(batches: Iterator[pd.DataFrame], floors: list[float]) -> Iterator[pd.DataFrame]:
    """Location, inverse scatter and log determinant from the sums of a group.

    Variances below the floor are raised to it, so constant features (no
    symbols at all) leave the scatter invertible.
    """
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            n = float(r.n)
            mu = np.array([getattr(r, f"s{i}") / n for i in range(P)]) / UNIT
            cov = np.zeros((P, P))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = float(getattr(r, f"q{i}_{j}")) / n / UNIT**2 - mu[i] * mu[j]
            cov += np.diag(np.maximum(0.0, np.array(floors) ** 2 - np.diag(cov)))
            vals, vecs = np.linalg.eigh(cov)
            vals = np.maximum(vals, min(floors) ** 2 / 4)
            rows.append((r.grp, int(r.start), mu.tolist(), ((vecs / vals) @ vecs.T).ravel().tolist(), float(np.log(vals).sum())))
        yield pd.DataFrame(rows, columns=["grp", "start", "mu", "inv", "logdet"])


def distance2() -> Column:
    """Squared Mahalanobis distance to the model ``mu``, ``inv`` of the row."""
    d = [F.col(f"x{i}") / F.lit(float(UNIT)) - F.col("mu")[i] for i in range(P)]
    out = F.lit(0.0)
    for i, j in PAIRS:
        out = out + d[i] * d[j] * F.col("inv")[i * P + j] * (1.0 if i == j else 2.0)
    return out


def steps_of(d2: Column) -> Column:
    """Distance in log steps of 1/500: few distinct values at any size."""
    return F.round(F.log1p(F.greatest(d2, F.lit(0.0))) * 500).cast("int")


def moments(members: DataFrame, floors: list[float]) -> DataFrame:
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in PAIRS]
    return members.groupBy("grp", "start").agg(*sums).mapInPandas(lambda it: solve(it, floors), "grp string, start int, mu array<double>, inv array<double>, logdet double")


@dataclass
class Fit:
    assign: DataFrame  # _lang, _source -> use (group whose model judges the row)
    models: DataFrame  # use -> mu, inv, limit


def fit(stats: DataFrame, params: Params, scratch: Scratch) -> Fit:
    """Estimates from all rows of ``stats`` (columns of ``with_stats``)."""
    floors = [f for _, _, f in features()]
    rows = vectors(stats.where("n_words > 0")).select("_lang", "_source", *[f"x{k}" for k in range(P)])
    sizes = scratch.table(rows.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n")), "sizes")
    by_lang = sizes.groupBy("_lang").agg(F.sum("n").alias("n_lang"))
    own, lang = F.concat(F.lit("s"), "_lang", F.lit("\x1f"), "_source"), F.concat(F.lit("l"), "_lang")
    assign = scratch.table(sizes.join(by_lang, "_lang").select("_lang", "_source", F.when(F.col("n") >= params.min_rows, own).when(F.col("n_lang") >= params.min_rows, lang).otherwise(F.lit("*")).alias("use")), "assign")
    used = assign.select("use").distinct()
    fits = assign.select("_lang", "_source", F.explode(F.array(own, lang, F.lit("*"))).alias("grp")).join(used.withColumnRenamed("use", "grp"), "grp", "left_semi")
    members = rows.join(fits, ["_lang", "_source"])

    # starts: coordinatewise median and MAD; spatial signs around the median
    med = members.groupBy("grp").agg(*[F.percentile(F.col(f"x{i}"), F.lit(0.5)).alias(f"m{i}") for i in range(P)])
    med = scratch.table(med, "medians")
    mad = members.join(med, "grp").groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(P)], *[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), F.lit(0.5)).alias(f"d{i}") for i in range(P)])
    scale = [F.greatest(F.col(f"d{i}") * F.lit(1.4826), F.lit(floors[i] * UNIT)) for i in range(P)]
    centre = scratch.table(mad.select("grp", *[F.col(f"m{i}") for i in range(P)], *[scale[i].alias(f"c{i}") for i in range(P)]), "centres")
    mu = F.array(*[F.col(f"m{i}") / F.lit(float(UNIT)) for i in range(P)])
    diag = F.array(*[(F.lit(float(UNIT) ** 2) / (F.col(f"c{i}") * F.col(f"c{i}")) if i == j else F.lit(0.0)) for i in range(P) for j in range(P)])
    start0 = centre.select("grp", F.lit(0).alias("start"), mu.alias("mu"), diag.alias("inv"), F.lit(math.inf).alias("logdet"))
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"c{i}") for i in range(P)]
    norm = F.greatest(F.sqrt(sum((v * v for v in z), F.lit(0.0))), F.lit(1.0))
    signed = members.join(centre, "grp").select("grp", F.lit(1).alias("start"), *[F.round(F.col(f"m{i}") + z[i] / norm * F.col(f"c{i}")).cast("long").alias(f"x{i}") for i in range(P)])
    models = scratch.table(start0.unionByName(moments(signed, floors).withColumn("logdet", F.lit(math.inf))), "starts")

    for _ in range(params.max_steps):
        seen = members.join(models.select("grp", "start", "mu", "inv"), "grp").withColumn("step", steps_of(distance2()))
        h = seen.groupBy("grp", "start").agg(F.percentile(F.col("step"), F.lit(params.h_share)).alias("h"))
        kept = seen.join(h, ["grp", "start"]).where("step <= h")
        new = scratch.table(moments(kept, floors), "models")
        falls = new.alias("a").join(models.alias("b"), ["grp", "start"]).where("a.logdet < b.logdet - 1e-9").limit(1).count()
        models = new
        if not falls:
            break
    best = models.groupBy("grp").agg(F.min_by(F.struct("mu", "inv"), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    # the median distance of clean rows is that of chi-square; never sharpened
    mid = members.join(best, "grp").groupBy("grp").agg(F.percentile(steps_of(distance2()), F.lit(0.5)).alias("mid"))
    factor = F.greatest(F.expm1(F.col("mid") / 500) / F.lit(chi2_quantile(0.5, P)), F.lit(1.0))
    final = best.join(mid, "grp").select(F.col("grp").alias("use"), "mu", "inv", (factor * F.lit(chi2_quantile(1 - params.tail, P))).alias("limit"))
    return Fit(assign, scratch.table(final, "final"))


def judge(stats: DataFrame, fitted: Fit) -> DataFrame:
    """``stats`` with ``base_failed``, ``distance2``, ``distance_limit`` and ``kept``."""
    rows = vectors(stats).join(fitted.assign, ["_lang", "_source"], "left").join(fitted.models, "use", "left")
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    rows = rows.withColumns({"base_failed": base, "distance2": F.when(F.col("n_words") > 0, distance2())})
    return rows.withColumns({"distance_limit": F.col("limit"), "kept": ~F.col("base_failed") & F.coalesce(F.col("distance2") <= F.col("limit"), F.lit(False))}).drop("_lang", "_source", "use", "mu", "inv", "limit", *[f"x{k}" for k in range(P)])


def quality_report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): statistics,
    base_failed, distance and verdict. Repeated rows are judged each."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.table(with_stats(docs.select("doc_id", "text", "lang", "source"), ["doc_id", "lang", "source"]), "stats")
    return judge(stats, fit(stats, params, scratch))


def keep_good(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.table(with_stats(docs.select("doc_id", "text", "lang", "source"), ["lang", "source"]), "stats")
    fitted = fit(stats, params, scratch)
    rows = with_stats(nested(docs, "text", "lang", "source"), ["_doc", "lang", "source"])
    return judge(rows, fitted).where("kept").select("_doc.*")
