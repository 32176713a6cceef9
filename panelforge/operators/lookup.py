"""Lookups as batch joins: entities by tier, recent history, requested rows, scored responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.schema import nan_to_null


def entities_by_tier(tiers: DataFrame) -> DataFrame:
    """One row per entity with the size of its tier and the total number of entities.

    Rows, not one list per tier: a tier may hold most of the entities.
    """
    members = tiers.select("respondent", "tier").distinct()
    sizes = members.groupBy("tier").agg(F.count(F.lit(1)).alias("tier_regions"))
    total = members.agg(F.count(F.lit(1))).scalar()
    return members.join(sizes, "tier").select("tier", "respondent", "tier_regions", total.alias("total_regions"))


def history(features: DataFrame, requested: DataFrame, limit: int = 60) -> DataFrame:
    """The last ``limit`` days of each requested entity, values to one decimal.

    Spark keeps only ``limit`` rows per entity before the shuffle.
    """
    wanted = requested.select(F.upper("respondent").alias("respondent")).distinct()
    newest_first = Window.partitionBy("respondent").orderBy(F.desc("target_date"))
    return (
        features.select("respondent", "tier", "target_date", "target", "benchmark_forecast", "naive_persistence")
        .join(wanted, "respondent", "left_semi")
        .withColumn("_place", F.row_number().over(newest_first))
        .filter(F.col("_place") <= limit)
        .select(
            "respondent",
            "tier",
            "target_date",
            F.round(nan_to_null("target"), 1).alias("actual_demand"),
            F.round(nan_to_null("benchmark_forecast"), 1).alias("benchmark_forecast"),
            F.round(nan_to_null("naive_persistence"), 1).alias("naive_persistence"),
        )
    )


def lookup_rows(features: DataFrame, requests: DataFrame) -> DataFrame:
    """The feature row of each request (respondent, target_date); without a date the latest one.

    Requests that match nothing keep a row with ``found`` false.
    """
    asked = requests.select(
        F.upper("respondent").alias("respondent"), F.col("target_date").cast("date").alias("requested_date")
    ).distinct()
    wanted = features.join(asked.select("respondent").distinct(), "respondent", "left_semi")
    latest = (
        wanted.groupBy("respondent").agg(F.max("target_date").alias("_latest"))
    )
    resolved = asked.join(latest, "respondent", "left").select(
        "respondent", "requested_date", F.coalesce("requested_date", "_latest").alias("target_date")
    )
    rows = wanted.withColumn("found", F.lit(True))
    return resolved.join(rows, ["respondent", "target_date"], "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def scored_response(df: DataFrame, prediction: str) -> DataFrame:
    """Errors and comparisons of a scored row.

    Percentages are NULL when the actual is zero or missing; ``beats_*`` also
    when the baseline is zero or missing.
    """
    pred, actual, naive, bench = (
        nan_to_null(F.col(c).cast("double")) for c in (prediction, "target", "naive_persistence", "benchmark_forecast")
    )
    error = F.abs(actual - pred)
    known = actual.isNotNull() & (actual != 0)

    def pct(e: Column) -> Column:
        return F.round(F.when(known, e / actual * 100.0), 2)

    def beats(baseline: Column) -> Column:
        usable = known & pred.isNotNull() & baseline.isNotNull() & (baseline != 0)
        return F.when(usable, error < F.abs(actual - baseline))

    return df.select(
        "respondent",
        "tier",
        "forecast_date",
        "target_date",
        F.round(pred, 1).alias("predicted_demand"),
        F.round(naive, 1).alias("naive_persistence"),
        F.round(bench, 1).alias("benchmark_forecast"),
        F.round(actual, 1).alias("actual_demand"),
        F.round(error, 1).alias("model_abs_error"),
        pct(error).alias("model_error_pct"),
        pct(F.abs(actual - bench)).alias("benchmark_error_pct"),
        pct(F.abs(actual - naive)).alias("naive_error_pct"),
        beats(naive).alias("beats_naive"),
        beats(bench).alias("beats_benchmark"),
    )
