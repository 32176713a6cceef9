"""Leak-free features of day t for the target of day t + 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.functions.dates import (
    calendar_parts,
    cyclical_parts,
    federal_holiday_name,
    holiday_flags,
    is_federal_holiday,
)
from panelforge.operators.panel import reindex_daily, with_missing_series
from panelforge.schema import (
    DEMAND_LAGS,
    EXOGENOUS_LAGS,
    FEATURE_COLUMNS,
    METADATA_COLUMNS,
    ROLLING_MEANS,
    ROLLING_STDS,
    SERIES,
    TIERS,
    TREND_WINDOWS,
    UNKNOWN_TIER,
    check_feature_contract,
)


def _by_day() -> WindowSpec:
    return Window.partitionBy("respondent").orderBy("period")


# ------------------------------------------------------------------ tiers


def assign_tier(df: DataFrame, tiers: dict[str, list[str]] | DataFrame = TIERS) -> DataFrame:
    """Add ``tier``; entities outside the map are ``Unknown``.

    A dictionary is code-sized and becomes a literal lookup.  A table of
    (respondent, tier) is joined without a hint: Spark broadcasts it only when
    its measured size allows.
    """
    if isinstance(tiers, DataFrame):
        joined = df.join(tiers.select("respondent", "tier"), "respondent", "left")
        return joined.withColumn("tier", F.coalesce("tier", F.lit(UNKNOWN_TIER)))
    tier = F.lit(None).cast("string")
    for name, members in tiers.items():
        tier = F.when(F.col("respondent").isin(list(members)), name).otherwise(tier)
    return df.withColumn("tier", F.coalesce(tier, F.lit(UNKNOWN_TIER)))


def tier_by_threshold(panel: DataFrame, large: float = 500_000.0, medium: float = 50_000.0) -> DataFrame:
    """(respondent, mean_demand, tier) by mean daily demand."""
    mean = F.col("mean_demand")
    return (
        panel.groupBy("respondent")
        .agg(F.avg("demand").alias("mean_demand"))
        .withColumn("tier", F.when(mean >= large, "Large").when(mean >= medium, "Medium").when(mean.isNotNull(), "Small")
                    .otherwise(UNKNOWN_TIER))
    )


# ------------------------------------------------------------------ window columns


def next_day_columns() -> dict[str, Column]:
    """Target, published benchmark and naive forecast of day t + 1."""
    return {
        "target": F.lead("demand", 1).over(_by_day()),
        "benchmark_forecast": F.lead("demand_forecast", 1).over(_by_day()),
        "naive_persistence": F.col("demand"),
    }


def demand_lag_columns(lags: list[int] = DEMAND_LAGS) -> dict[str, Column]:
    by_day = _by_day()
    lagged = {f"demand_lag_{k}": F.lag("demand", k).over(by_day) for k in lags}
    return {"demand_t": F.col("demand"), **lagged}


def _over_last(days: int) -> WindowSpec:
    return _by_day().rowsBetween(1 - days, 0)


def _with_enough(days: int, least: int, aggregate: Column) -> Column:
    frame = _over_last(days)
    return F.when(F.count("demand").over(frame) >= least, aggregate.over(frame))


def rolling_columns() -> dict[str, Column]:
    """Means and sample deviations of the last days, t included, once enough are observed."""
    means = {
        f"demand_rolling_mean_{k}": _with_enough(k, least, F.avg("demand")) for k, least in ROLLING_MEANS.items()
    }
    stds = {
        f"demand_rolling_std_{k}": _with_enough(k, least, F.stddev_samp("demand"))
        for k, least in ROLLING_STDS.items()
    }
    return {**means, **stds}


def trend_columns(windows: list[int] = TREND_WINDOWS) -> dict[str, Column]:
    """Least-squares slope per day over complete windows; NULL when a day is missing."""
    day_number = F.unix_date("period").cast("double")
    return {
        f"demand_trend_{k}": _with_enough(k, k, F.regr_slope("demand", day_number)) for k in windows
    }


def exogenous_columns(lags: list[int] = EXOGENOUS_LAGS) -> dict[str, Column]:
    by_day = _by_day()
    columns = {}
    for name in ("net_generation", "interchange"):
        columns[f"{name}_t"] = F.col(name)
        columns |= {f"{name}_lag_{k}": F.lag(name, k).over(by_day) for k in lags}
    return columns


# ------------------------------------------------------------------ holidays


def holiday_calendar(df: DataFrame, column: str) -> DataFrame:
    """Observed holidays from the year before the first date to the year after the last.

    An observed date can fall in the neighbouring year.
    """
    years = df.agg(F.min(F.year(column)).alias("a"), F.max(F.year(column)).alias("b")).filter("a is not null")
    return (
        years.select(
            F.explode(F.sequence(F.make_date("a", F.lit(1), F.lit(1)) - F.expr("interval 1 year"),
                                 F.make_date("b", F.lit(12), F.lit(31)) + F.expr("interval 1 year"))).alias("day")
        )
        .select(F.to_date("day").alias("day"))
        .filter(is_federal_holiday("day"))
        .select("day", federal_holiday_name("day").alias("holiday"))
    )


def with_holiday_flags(df: DataFrame, column: str = "target_date") -> DataFrame:
    return df.withColumns(holiday_flags(column))


def with_calendar(df: DataFrame, column: str = "target_date") -> DataFrame:
    day = F.col(column)
    return df.withColumns({**calendar_parts(day), **cyclical_parts(day)})


# ------------------------------------------------------------------ the feature table


def build_features(
    panel: DataFrame,
    tiers: dict[str, list[str]] | DataFrame = TIERS,
    drop_na_target: bool = True,
    reindexed: bool = False,
) -> DataFrame:
    """Feature matrix of all entities in one plan.

    One shuffle on the entity and one sort serve the gap filling and every
    lag, lead and rolling column.  Calendar and holiday columns are narrow
    expressions.  ``drop_na_target=False`` keeps the rows whose next day is not
    known yet, which are the ones to forecast.
    """
    check_feature_contract(FEATURE_COLUMNS)
    panel = with_missing_series(panel).select("period", "respondent", *SERIES.values())
    daily = panel if reindexed else reindex_daily(panel)
    windows = {
        **next_day_columns(),
        **demand_lag_columns(),
        **rolling_columns(),
        **trend_columns(),
        **exogenous_columns(),
    }
    out = daily.select("period", "respondent", *[c.alias(name) for name, c in windows.items()])
    if drop_na_target:
        out = out.filter("target is not null")
    out = out.withColumns(
        {"forecast_date": F.col("period"), "target_date": F.date_add("period", 1)}
    )
    out = with_holiday_flags(with_calendar(out))
    return assign_tier(out, tiers).select(*METADATA_COLUMNS, *[c for c in FEATURE_COLUMNS if c != "respondent"])
