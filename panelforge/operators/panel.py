"""From long observations to a gap-free daily panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.schema import KEY, SERIES


def filter_window(
    df: DataFrame,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    respondents: list[str] | DataFrame | None = None,
    types: list[str] | None = None,
) -> DataFrame:
    """Rows inside ``[start, end]`` (both ends included) for the given entities and series.

    Lists become pushed-down ``IN`` predicates; an entity table becomes a semi
    join, whatever its size.
    """
    if start is not None:
        df = df.filter(F.col("period") >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.filter(F.col("period") <= F.lit(str(end)).cast("date"))
    if isinstance(respondents, DataFrame):
        df = df.join(respondents.select("respondent").distinct(), "respondent", "left_semi")
    elif respondents is not None:
        df = df.filter(F.col("respondent").isin(list(respondents)))
    if types is not None:
        df = df.filter(F.col("type").isin(list(types)))
    return df


def long_view(df: DataFrame) -> DataFrame:
    """Long rows in key order, for output only."""
    return df.orderBy(*KEY)


def to_wide(df: DataFrame, series: dict[str, str] = SERIES) -> DataFrame:
    """One row per (period, entity), one column per series.

    Every series has its column even when it does not occur.  Days without any
    value are left out.  Keys are unique after ingest; should copies remain,
    the largest value is taken so that reruns agree.

    Conditional aggregates instead of a two-stage pivot: one shuffle, combined
    map-side, on (period, entity), so a heavy entity is spread over its days.
    """
    value = F.col("value").cast("double")
    present = df.filter(F.col("type").isin(list(series))).filter(value.isNotNull() & ~F.isnan(value))
    return present.groupBy("period", "respondent").agg(
        *[F.max(F.when(F.col("type") == code, value)).alias(name) for code, name in series.items()]
    )


def with_missing_series(df: DataFrame, series: dict[str, str] = SERIES) -> DataFrame:
    """Add absent series as all-NULL columns."""
    absent = [name for name in series.values() if name not in df.columns]
    return df.withColumns({name: F.lit(None).cast("double") for name in absent}) if absent else df


def reindex_daily(panel: DataFrame, values: list[str] | None = None) -> DataFrame:
    """Fill each entity's days between its first and last with all-NULL rows.

    Each row is expanded up to the day before the next one, so there is no
    calendar table and no join: one shuffle on the entity, which the feature
    windows reuse.  A partition holds the days of one entity, a number bounded
    by the calendar and not by the data.
    """
    values = values or [c for c in panel.columns if c not in ("period", "respondent")]
    following = F.lead("period").over(Window.partitionBy("respondent").orderBy("period"))
    last = F.greatest(F.col("period"), F.date_sub(F.coalesce("_next", F.col("period")), 1))
    return (
        panel.select("period", "respondent", *values, following.alias("_next"))
        .select(
            F.col("period").alias("_day"),
            "respondent",
            *values,
            F.explode(F.sequence(F.col("period"), last)).alias("period"),
        )
        .select(
            "period",
            "respondent",
            *[F.when(F.col("period") == F.col("_day"), F.col(v)).alias(v) for v in values],
        )
    )
