"""Daily roll-up and quality counters; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.schema import NEGATIVE_ALLOWED, TARGET_TYPE


def _watermarked(df: DataFrame, delay: str | None) -> DataFrame:
    return df.withWatermark("event_ts", delay) if delay and df.isStreaming else df


def daily_rollup(df: DataFrame, delay: str | None = None) -> DataFrame:
    """Row count and value total per entity and UTC day of ``event_ts``.

    On a stream, a day is emitted once it can no longer change: ``delay`` after
    its end.  Later rows are dropped.  Totals are decimal sums, so they do not
    depend on how rows fall into batches.
    """
    return (
        _watermarked(df, delay)
        .groupBy(F.window("event_ts", "1 day").alias("_w"), "respondent")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("value").cast("decimal(18,2)")).alias("total"),
        )
        .select(F.to_date("_w.start").alias("day"), "respondent", "n", "total")
    )


def daily_quality(
    df: DataFrame,
    delay: str | None = None,
    target: str = TARGET_TYPE,
    negative_allowed: list[str] = NEGATIVE_ALLOWED,
) -> DataFrame:
    """Missing, invalid negative and zero-valued rows per day."""
    value = F.col("value")
    missing = value.isNull() | F.isnan(value)
    allowed = F.col("type").isin(list(negative_allowed)) if negative_allowed else F.lit(False)
    return (
        _watermarked(df, delay)
        .groupBy(F.window("event_ts", "1 day").alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(missing).alias("missing"),
            F.count_if(~missing & (value < 0) & ~F.coalesce(allowed, F.lit(False))).alias("negatives"),
            F.count_if((F.col("type") == target) & (value == 0)).alias("zeros"),
        )
        .select(F.to_date("_w.start").alias("day"), "n", "missing", "negatives", "zeros")
    )
