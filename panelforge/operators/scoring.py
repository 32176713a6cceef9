"""Baselines, the per-entity guardrail and fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.schema import nan_to_null


def naive_column(df: DataFrame) -> str:
    """Name of the column that holds the naive forecast."""
    for name in ("naive_persistence", "demand_t"):
        if name in df.columns:
            return name
    raise KeyError("neither naive_persistence nor demand_t is present")


def naive_forecast(df: DataFrame, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, F.col(naive_column(df)))


def benchmark_forecast(df: DataFrame, name: str = "prediction") -> DataFrame:
    if "benchmark_forecast" not in df.columns:
        raise KeyError("benchmark_forecast is not present")
    return df.withColumn(name, F.col("benchmark_forecast"))


def guardrail(df: DataFrame, prediction: str, truth: str = "target") -> DataFrame:
    """Validation MAE of model and naive forecast per entity, and ``fallback`` where the model loses.

    Rows count only where truth, prediction and naive value are all present.
    A tie keeps the model.
    """
    y, p, n = (nan_to_null(F.col(c).cast("double")) for c in (truth, prediction, naive_column(df)))
    valid = y.isNotNull() & p.isNotNull() & n.isNotNull()
    return (
        df.filter(valid)
        .groupBy("tier", "respondent")
        .agg(F.avg(F.abs(y - p)).alias("model_mae"), F.avg(F.abs(y - n)).alias("naive_mae"))
        .withColumn("fallback", F.col("model_mae") > F.col("naive_mae"))
    )


def fallback_entities(df: DataFrame, prediction: str, truth: str = "target") -> DataFrame:
    return guardrail(df, prediction, truth).filter("fallback").select("tier", "respondent")


def apply_fallback(df: DataFrame, fallback: DataFrame, prediction: str) -> DataFrame:
    """Replace the prediction of fallback entities by the naive value, even where that is NULL.

    The table grows with the entities, so it carries no broadcast hint.
    """
    marks = fallback.select("respondent").distinct().withColumn("_fallback", F.lit(True))
    replaced = F.when(F.col("_fallback"), F.col(naive_column(df))).otherwise(F.col(prediction))
    return df.join(marks, "respondent", "left").withColumn(prediction, replaced).select(*df.columns)


def stand_in_prediction() -> Column:
    """A fixed formula in place of a fitted model: mean of today and six days ago."""
    return (F.col("demand_t") + F.col("demand_lag_6")) / 2
