"""The lasso of the quality classifier: few jobs, the same optimum as a gradient method's."""

import numpy as np
import pytest
from conftest import SF
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from panelforge.llm import quality


def test_a_fit_starts_few_jobs(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    spark.sparkContext.setJobGroup("quality-fit", "jobs of a fit")
    try:
        model = quality.fit(docs, labels)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.rules
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("quality-fit")) < 80


@pytest.mark.parametrize("rare", [0.5, 0.02])
def test_lasso_finds_the_optimum(spark, rare):
    draw = np.random.default_rng(3)
    x = (draw.random((600, 12)) < 0.4).astype(float)
    x[:, 5] = x[:, 4]  # a rule that repeats another
    chance = 1 / (1 + np.exp(-(np.log(rare / (1 - rare)) + 2 * x[:, 0] - 3 * x[:, 1])))
    y = (draw.random(600) < chance).astype(float)
    y[:2] = 0, 1
    rows = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["_label", "features"]).coalesce(1).cache()

    def loss(bias, weights):
        eta = bias + x @ weights
        return np.mean(np.logaddexp(0, eta) - y * eta) + 0.01 * np.abs(weights).sum()

    other = LogisticRegression(labelCol="_label", elasticNetParam=1.0, regParam=0.01, standardization=False, maxIter=500, tol=1e-10).fit(rows)
    assert loss(*quality.lasso(rows, 0.01)) <= loss(other.intercept, other.coefficients.toArray()) + 1e-6
    rows.unpersist()


def test_separated_classes_have_a_finite_fit(spark):
    rows = spark.createDataFrame([(float(i % 2), Vectors.dense([float(i % 2), 1.0])) for i in range(40)], ["_label", "features"])
    bias, weights = quality.lasso(rows, 0.001)
    assert np.isfinite([bias, *weights]).all() and weights[0] > 3 and bias + weights[0] > 0 > bias


def test_too_few_rows_to_split_score_their_share(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.filter(~quality.held_out()).orderBy("doc_id").limit(4).select("doc_id", (F.col("doc_id") % 4 > 0).cast("int").alias("quality"))
    scores = {round(r.score, 9) for r in quality.quality_report(docs, labels).collect()}
    known = [r.quality for r in labels.collect()]
    assert scores == {round(sum(known) / len(known), 9)}
