"""Exploratory aggregates over the wide panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import errors
from panelforge.operators.distribution import ordered_counts, quantile_columns, unpivot_row
from panelforge.schema import SERIES, nan_to_null

VALUES = list(SERIES.values())


def describe(df: DataFrame, columns: list[str] = VALUES, buckets: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max per column."""
    numbers = [nan_to_null(F.col(c).cast("double")) for c in columns]
    wide = df.agg(
        *[F.count(x).alias(f"n_{i}") for i, x in enumerate(numbers)],
        *[F.avg(x).alias(f"mean_{i}") for i, x in enumerate(numbers)],
        *[F.stddev_samp(x).alias(f"std_{i}") for i, x in enumerate(numbers)],
    )
    moments = unpivot_row(wide, columns, {"n": "n", "mean": "mean", "std": "std"})
    shape = (
        ordered_counts(df, columns, {"n": F.lit(1)}, buckets)
        .groupBy("feature")
        .agg(
            F.min("value").alias("min"),
            *quantile_columns({"q25": 0.25, "q50": 0.5, "q75": 0.75}),
            F.max("value").alias("max"),
        )
    )
    return moments.join(shape, "feature", "left")


def missing_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing count and percentage (three decimals) per column."""
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}

    def missing(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()

    wide = df.agg(
        *[F.count_if(missing(c)).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.count(F.lit(1)).alias(f"n_{i}") for i in range(len(columns))],
    )
    rows = unpivot_row(wide, columns, {"n_missing": "m", "_n": "n"})
    return rows.select(
        F.col("feature").alias("column"), "n_missing", F.round(F.try_divide("n_missing", "_n") * 100, 3).alias("pct")
    )


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, entities and date range."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("respondent").alias("respondents"),
        F.min("period").alias("first_day"),
        F.max("period").alias("last_day"),
    )


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def histogram(df: DataFrame, column: str = "demand", bins: int = 80) -> DataFrame:
    """Counts in ``bins`` equal-width bins over the range of the column; the last one includes its right edge."""
    value = nan_to_null(F.col(column).cast("double"))
    low, high = F.min(value), F.max(value)
    half = F.when(low == high, 0.5).otherwise(0.0)
    limits = df.agg(F.struct((low - half).alias("low"), (high + half).alias("high"))).scalar()
    place = F.least(F.width_bucket(value, limits["low"], limits["high"], F.lit(bins)), F.lit(bins)).cast("int")
    counts = df.filter(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("_limits.high") - F.col("_limits.low")) / bins
    all_bins = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (
        all_bins.join(counts, "bin", "left")
        .withColumn("_limits", limits)
        .select(
            "bin",
            (F.col("_limits.low") + (F.col("bin") - 1) * width).alias("left_edge"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def demand_ranking(df: DataFrame) -> DataFrame:
    """Mean demand per entity."""
    return df.groupBy("respondent").agg(F.avg("demand").alias("mean_demand"))


def both_ends(df: DataFrame, measure: str, n: int = 5) -> DataFrame:
    """The ``n`` largest and the ``n`` smallest entities by ``measure``, as two top-k sorts."""
    present = df.filter(F.col(measure).isNotNull())
    top = present.orderBy(F.desc(measure), "respondent").limit(n).withColumn("end", F.lit("largest"))
    low = present.orderBy(measure, "respondent").limit(n).withColumn("end", F.lit("smallest"))
    return top.unionByName(low)


def size_ratio(ranking: DataFrame) -> DataFrame:
    """One row: largest over smallest mean demand."""
    return ranking.agg(F.try_divide(F.max("mean_demand"), F.min("mean_demand")).alias("ratio"))


def focus_series(df: DataFrame, respondents: list[str]) -> DataFrame:
    return df.filter(F.col("respondent").isin(list(respondents))).select("respondent", "period", "demand")


def seasonality(df: DataFrame, part: str) -> DataFrame:
    """Mean demand per month or weekday, relative to the entity's mean of those means.

    ``part`` is ``month`` or ``dayofweek`` (Monday is 0).
    """
    key = {"month": F.month, "dayofweek": F.weekday}[part]("period")
    means = df.groupBy("respondent", key.alias(part)).agg(F.avg("demand").alias("mean_demand"))
    level = F.avg("mean_demand").over(Window.partitionBy("respondent"))
    return means.withColumn("relative", F.try_divide(F.col("mean_demand"), level))


def benchmark_errors(df: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE of the published forecast on rows with both values."""
    return df.agg(
        errors.n_samples("demand", "demand_forecast").alias("rows"),
        errors.mae("demand", "demand_forecast").alias("mae"),
        errors.rmse("demand", "demand_forecast").alias("rmse"),
        errors.mape("demand", "demand_forecast").alias("mape"),
    )


def benchmark_mape_by_entity(df: DataFrame) -> DataFrame:
    """MAPE and number of compared rows per entity."""
    return (
        df.groupBy("respondent")
        .agg(
            errors.mape("demand", "demand_forecast").alias("mape"),
            errors.n_samples("demand", "demand_forecast").alias("n"),
        )
        .filter("n > 0")
    )


def naive_mape_by_row(df: DataFrame) -> DataFrame:
    """MAPE of the previous row's demand, whatever day that row is of."""
    previous = F.lag("demand").over(Window.partitionBy("respondent").orderBy("period"))
    rows = df.select("demand", previous.alias("naive"))
    return rows.agg(errors.n_samples("demand", "naive").alias("rows"), errors.mape("demand", "naive").alias("mape"))


def panel_coverage(df: DataFrame) -> DataFrame:
    """Coverage, interior gaps and missing demand per entity of the wide panel."""
    span = df.agg((F.datediff(F.max("period"), F.min("period")) + 1).alias("days")).scalar()
    demand = nan_to_null(F.col("demand").cast("double"))
    days = df.groupBy("respondent", "period").agg(F.count_if(demand.isNull()).alias("missing"))
    return (
        days.groupBy("respondent")
        .agg(
            F.count("period").alias("days"),
            F.min("period").alias("first_day"),
            F.max("period").alias("last_day"),
            F.sum("missing").alias("missing_demand"),
        )
        .withColumns(
            {
                "coverage_pct": F.round(F.col("days") / span * 100, 2),
                "interior_gaps": F.greatest(
                    F.datediff("last_day", "first_day") + 1 - F.col("days"), F.lit(0)
                ),
            }
        )
    )


def first_rows(df: DataFrame, respondent: str, n: int = 8) -> DataFrame:
    """The first days of one entity."""
    return df.filter(F.col("respondent") == respondent).orderBy("period").limit(n)
