"""Quality classifier: a sparse ensemble of rules.

Trees are grown on statistics of the labelled texts; every path from a root
to a node becomes a conjunctive rule (``upper > 0.2 and words <= 300``). A
lasso logistic regression over the rules keeps few of them, and the kept
rules are compiled into one Spark column expression, so scoring is a
projection without a model object or Python.

Statistics cover whole texts of all documents. The classifier alone is
fitted on a bounded sample: at most ``max_train`` labelled rows, those with
the least hash of their doc_id. Language, source, doc_id and labels are
never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramforge.llm.common import Scratch
from paramforge.llm.textstats import with_stats


@dataclass(frozen=True)
class Params:
    folds: int = 5  # documents whose crc32(doc_id) leaves 0 are held out
    max_train: int = 50_000  # bound of the labelled sample
    trees: int = 24
    depth: int = 3
    lasso: float = 0.002
    threshold: float = 0.3  # of the score, for predicted = 1
    seed: int = 7


def inputs() -> dict[str, Column]:
    c = F.col
    chars, words = F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_words"), F.lit(1))
    return {
        "words": F.log1p(c("n_words")), "symbols": c("n_symbols") / chars, "dup_lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), "repeats": c("n_repeat_words") / words,
        "upper": c("n_upper") / chars, "digits": c("n_digits") / chars, "punctuation": c("n_punct") / chars, "word_length": c("word_chars") / words, "distinct": c("n_distinct") / words,
        "words_a_line": F.log1p(c("n_words") / F.greatest(c("n_lines"), F.lit(1))), "longest_word": F.log1p(c("longest_word")),
    }


Condition = tuple[str, bool, float]  # (input, True for "<=", threshold)


def paths(node, names: list[str], so_far: tuple[Condition, ...] = ()) -> set[tuple[Condition, ...]]:
    """The conjunctions that lead to each node below ``node``; of conditions on
    the same side of an input only the tightest is kept."""
    found = {so_far} if so_far else set()
    if node.subtreeDepth() == 0:
        return found
    split = node.split()
    for left, child in ((True, node.leftChild()), (False, node.rightChild())):
        tight = {(n, le): t for n, le, t in so_far}
        key, t = (names[split.featureIndex()], left), float(split.threshold())
        tight[key] = t if key not in tight else (min if left else max)(t, tight[key])
        found |= paths(child, names, tuple(sorted((n, le, t) for (n, le), t in tight.items())))
    return found


def holds(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, le, t in rule:
        out = out & ((F.col(name) <= t) if le else (F.col(name) > t))
    return out.cast("double")


def fit_rules(rows: DataFrame, p: Params) -> tuple[list[tuple[tuple[Condition, ...], float]], float]:
    """((rule, weight) with weight not 0, intercept) from rows of the inputs
    and ``label`` (0.0 or 1.0). Without both labels no rule is fitted and
    the intercept is the smoothed share of label 1."""
    import math

    names = sorted(inputs())
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    ones, zeros = counts.get(1.0, 0), counts.get(0.0, 0)
    if not ones or not zeros:
        return [], math.log((ones + 1) / (zeros + 1))
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(rows).select("x", "label", *names)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=p.trees, maxDepth=p.depth, featureSubsetStrategy="onethird", subsamplingRate=0.8, seed=p.seed).fit(vectors)
    rules = sorted(set().union(*(paths(t._java_obj.rootNode(), names) for t in forest.trees)))
    if not rules:
        return [], math.log((ones + 1) / (zeros + 1))
    hit = vectors.select("label", *[holds(r).alias(f"r{k}") for k, r in enumerate(rules)])
    hit = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="rules").transform(hit).select("rules", "label")
    model = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=p.lasso, maxIter=60, standardization=False).fit(hit)
    return [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w], float(model.intercept)


def compiled(rules: list[tuple[tuple[Condition, ...], float]], intercept: float) -> Column:
    """The score (0 to 1) as a column expression over the inputs."""
    z = F.lit(intercept)
    for rule, weight in rules:
        z = z + holds(rule) * F.lit(weight)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def scored(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_rules for every row of ``docs``.

    ``labels`` (doc_id, quality): rows without a 0 or 1 are not used; of
    several labels of a doc_id the least counts, as do repeated documents.
    A null text is empty; a null doc_id counts as empty text in the fold.
    """
    p, scratch = params, Scratch(docs.sparkSession, "rules")
    stats = scratch.table(with_stats(docs.select("doc_id", "text"), ["doc_id"]), "stats")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(p.folds)) == 0
    rows = stats.select("doc_id", held.alias("held_out"), *[c.alias(n) for n, c in inputs().items()])
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    train = rows.where("not held_out").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_train)
    train = scratch.table(train.drop("doc_id", "held_out"), "train").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).cache()
    rules, intercept = fit_rules(train, p)
    train.unpersist()
    score = compiled(rules, intercept)
    return rows.select("doc_id", "held_out", score.alias("score"), (score >= p.threshold).cast("int").alias("predicted"), F.lit(len(rules)).alias("n_rules"))
