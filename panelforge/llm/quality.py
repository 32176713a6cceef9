"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark column expressions.

Trees are fitted to the statistics of labelled documents; every path from a root is a rule, a conjunction of
comparisons.  A lasso logistic regression over the rules leaves the few that matter.  It is fitted by Newton steps, each a weighted
lasso by normal equations: one pass over the sample per step and about ten steps, where a gradient method starts hundreds of jobs.  Scoring
evaluates the rules left as column expressions on the statistics: no model object and no Python on the executors.

Statistics come from the text alone.  Trees and weights are fitted on at most ``sample_rows`` labelled documents, those
with the smallest hashes of their ids; every document is scored on its whole text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import filled, word_count

Rule = tuple[tuple[str, str, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Finite numbers for any text, the empty one too."""
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1))
    lines = F.filter(F.split(text, r"\n+"), lambda w: w != "")
    sentences = F.filter(F.split(text, r"[.!?\n]+\s*"), lambda w: w != "")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    return {
        "log_chars": F.log1p(F.length(text)),
        "word_length": F.length(text) / n_words,
        "capitals": share(r"\p{Lu}"),
        "digits": share(r"\p{N}"),
        "marks": share(r"[.,;:!?]"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:!?]"),
        "lines": share(r"\n"),
        "new_words": F.size(F.array_distinct(words)) / n_words,
        "new_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "new_sentences": F.size(F.array_distinct(sentences)) / F.greatest(F.size(sentences), F.lit(1)),
        "sentence_words": word_count(text) / F.greatest(F.size(sentences), F.lit(1)),
    }


#: The statistics in the order of the model's inputs.
NAMES = [
    "log_chars",
    "word_length",
    "capitals",
    "digits",
    "marks",
    "symbols",
    "lines",
    "new_words",
    "new_lines",
    "new_sentences",
    "sentence_words",
]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the crc32 of the id's text leaves 2 modulo 4; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class RuleModel:
    """``bias`` and weighted rules; a rule is a tuple of (statistic, "<=" or ">", bound)."""

    bias: float
    rules: dict[Rule, float]

    def score(self) -> Column:
        """Probability of label 1 from columns named like the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules.items():
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule) -> Column:
    tests = [F.col(name) <= F.lit(bound) if sign == "<=" else F.col(name) > F.lit(bound) for name, sign, bound in rule]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """Every path from a root in Spark ML's printed trees, to inner nodes and leaves alike."""
    path: list[tuple[int, tuple[str, str, float]]] = []
    found: dict[Rule, None] = {}
    for line in description.splitlines():
        test = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if re.match(r"\s*Tree \d", line):
            path = []
        if test:
            depth = len(test[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(test[2])], test[3], float(test[4])))]
            found[tuple(sorted(p[1] for p in path))] = None
    return list(found)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """Statistics and ``label`` of the training rows: at most ``sample_rows``, by hash of the id; the fold is left out.

    An id labelled or present more than once counts once, with the smallest value of each column.
    """
    known = labels.filter(~held_out() & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label).cast("double").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows rows of two numbers.
    rows = docs.select("doc_id", filled("text").alias("_t")).join(F.broadcast(chosen), "doc_id")
    measured = rows.select("doc_id", "_label", *(c.cast("double").alias(n) for n, c in statistics(F.col("_t")).items()))
    return measured.groupBy("doc_id").agg(*(F.min(n).alias(n) for n in ["_label", *NAMES]))


def lasso(rows: DataFrame, penalty: float, steps: int = 50, tol: float = 1e-7) -> tuple[float, np.ndarray]:
    """Intercept and weights of the lasso logistic regression of ``_label`` (both classes occur) on the vectors ``features``.

    Minimises the mean logistic loss plus ``penalty`` times the absolute weights.  A step that does not lower it is halved; it ends when
    a step gains less than ``tol`` of it.
    """
    solver = LinearRegression(
        labelCol="_target", weightCol="_slope", predictionCol="_next", solver="normal", elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-9
    )
    eta, label = F.col("_eta"), F.col("_label")
    chance = F.greatest(F.least(1 / (1 + F.exp(-eta)), F.lit(1 - 1e-5)), F.lit(1e-5))
    lost = F.log1p(F.exp(-F.abs(eta))) + F.greatest(eta, F.lit(0.0)) - label * eta

    def measured(at: DataFrame, weights: np.ndarray) -> tuple[float, float]:
        loss, slope = at.agg(F.mean(lost), F.mean(chance * (1 - chance))).first()
        return loss + penalty * float(np.abs(weights).sum()), slope

    share = rows.agg(F.mean(label)).first()[0]
    bias, weights = math.log(share / (1 - share)), np.zeros(len(rows.first()["features"]))
    at = rows.withColumn("_eta", F.lit(bias))
    best, slope = measured(at, weights)
    for _ in range(steps):
        working = at.withColumns({"_slope": chance * (1 - chance), "_target": eta + (label - chance) / (chance * (1 - chance))})
        model = solver.setRegParam(penalty / slope).fit(working)
        step, gain = 1.0, -math.inf
        while gain < 0 and step > 1e-3:
            tried = weights + step * (model.coefficients.toArray() - weights), bias + step * (model.intercept - bias)
            moved = F.col("_next") if step == 1 else eta + step * (F.col("_next") - eta)
            there = model.transform(at).select("_label", "features", moved.alias("_eta"))
            value, found = measured(there, tried[0])
            gain, step = best - value, step / 2
        if gain < 0:
            break
        at, best, slope, (weights, bias) = there, value, found, tried
        if gain <= tol * best:
            break
    return bias, weights


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    sample_rows: int = 20_000,
    trees: int = 30,
    depth: int = 3,
    min_rows: int = 5,
    penalty: float = 0.001,
    seed: int = 7,
) -> RuleModel:
    """Trees, then lasso weights of their rules.  Without both classes or any rule the score is constant: the share of label 1, or a half.

    ``min_rows`` is the fewest labelled rows that a leaf of a tree may hold, whatever their number.
    """
    spark = docs.sparkSession
    local = labelled_sample(docs, labels, label, sample_rows).toPandas().sort_values("doc_id")
    if local["_label"].nunique() < 2:
        value = float(local["_label"].iloc[0]) if len(local) else 0.5
        return RuleModel({0.5: 0.0}.get(value, 20.0 if value else -20.0), {})
    sample = spark.createDataFrame(local).coalesce(1).cache()
    assembled = VectorAssembler(inputCols=NAMES, outputCol="features").transform(sample)
    forest = RandomForestClassifier(
        labelCol="_label", numTrees=trees, maxDepth=depth, subsamplingRate=0.7, featureSubsetStrategy="onethird",
        minInstancesPerNode=min_rows, maxBins=64, seed=seed,
    ).fit(assembled)
    rules = tree_rules(forest.toDebugString, NAMES)
    if not rules:  # too few rows to split
        sample.unpersist()
        return RuleModel(math.log(local["_label"].mean() / (1 - local["_label"].mean())), {})
    names = [f"r{i}" for i in range(len(rules))]
    fired = sample.select("_label", *(holds(r).cast("double").alias(n) for r, n in zip(rules, names)))
    fired = VectorAssembler(inputCols=names, outputCol="features").transform(fired).select("_label", "features").cache()
    bias, weights = lasso(fired, penalty)
    fired.unpersist()
    sample.unpersist()
    return RuleModel(float(bias), {r: float(w) for r, w in zip(rules, weights) if abs(w) > 1e-9})


def scored(docs: DataFrame, model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """``_all`` (the row of ``docs``), ``score`` and ``predicted``: 1 where the score reaches the threshold."""
    rows = docs.select(F.struct(*docs.columns).alias("_all"), filled("text").alias("_t"))
    measured = rows.select("_all", *(c.cast("double").alias(n) for n, c in statistics(F.col("_t")).items()))
    out = measured.select("_all", model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **settings) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` per row; null texts are empty, an empty table gives none."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, **settings), threshold)
    return out.select("_all.doc_id", "score", "predicted").withColumn("held_out", held_out())


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **settings) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    return scored(docs, fit(docs, labels, **settings), threshold).filter("predicted = 1").select("_all.*")
