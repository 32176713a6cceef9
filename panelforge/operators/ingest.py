"""Keyed ingest: newest copy per key, resume, incremental start, run status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.schema import KEY


def keep_latest(
    df: DataFrame, key: list[str] = KEY, order: list[str] | str = "_ingested_at"
) -> DataFrame:
    """One row per key: the greatest by ``order``, ties settled by the other columns.

    An aggregate rather than a ranking window: copies of a key are combined
    before the shuffle, so a key with a third of all rows costs one row per
    map task.
    """
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in key and c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("_newest")
    return df.groupBy(*key).agg(newest).select(*key, "_newest.*").select(*df.columns)


def distinct_entities(df: DataFrame, column: str = "respondent") -> DataFrame:
    """Entities that occur in ``df``; only their column is read."""
    return df.select(F.col(column).alias("respondent")).filter("respondent is not null").distinct()


def not_stored(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Resume: requested entities the store does not hold yet."""
    return requested.join(stored.select("respondent"), "respondent", "left_anti")


def incremental_start(df: DataFrame, lookback_days: int = 7, column: str = "period") -> DataFrame:
    """First day to fetch again, as one row ``start``; NULL when nothing is stored."""
    return df.agg(F.date_sub(F.max(F.to_date(column)), lookback_days).alias("start"))


def first_entities(entities: DataFrame, n: int) -> DataFrame:
    """The first ``n`` entities by id, for smoke runs."""
    return entities.select("respondent").distinct().orderBy("respondent").limit(n)


def restrict_to(df: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows of the given entities; Spark broadcasts the list only while it is small."""
    return df.join(entities.select("respondent").distinct(), "respondent", "left_semi")


def pin_timezone(df: DataFrame, timezone: str | None, column: str = "timezone") -> DataFrame:
    """Rows of one time zone.  Other zones repeat the same values, so this removes copies."""
    if not timezone:
        raise ValueError("a time zone must be set")
    return df.filter(F.col(column) == timezone)


def ingest_status(
    requested: DataFrame,
    fetched: DataFrame,
    stored: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """One row per requested entity: ``status``, rows fetched and failure reason.

    ``stored`` names entities to skip.  ``failures`` (respondent, reason) tells
    an outage from an entity without data.
    """
    counts = fetched.groupBy("respondent").agg(F.count(F.lit(1)).alias("rows"))
    out = requested.select("respondent").distinct().join(counts, "respondent", "left")
    if stored is not None:
        known = stored.select("respondent").distinct().withColumn("_stored", F.lit(True))
        out = out.join(known, "respondent", "left")
    else:
        out = out.withColumn("_stored", F.lit(None).cast("boolean"))
    if failures is not None:
        reasons = failures.groupBy("respondent").agg(F.max("reason").alias("reason"))
        out = out.join(reasons, "respondent", "left")
    else:
        out = out.withColumn("reason", F.lit(None).cast("string"))
    status = (
        F.when(F.col("_stored"), "skipped")
        .when(F.col("reason").isNotNull(), "failed")
        .when(F.coalesce("rows", F.lit(0)) == 0, "no_data")
        .otherwise("ok")
    )
    return out.select(
        "respondent",
        status.alias("status"),
        F.when(status == "ok", F.col("rows")).otherwise(F.lit(0)).cast("long").alias("rows"),
        F.when(status == "failed", F.col("reason")).alias("reason"),
    )


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(
        F.count(F.lit(1)).alias("respondents"), F.sum("rows").alias("rows")
    )


def failure_records(status: DataFrame) -> DataFrame:
    """Log rows for entities without data and for failed ones."""
    return status.filter("status in ('failed', 'no_data')").select(
        F.current_timestamp().alias("ts"),
        "respondent",
        F.coalesce("reason", F.lit("no_data")).alias("reason"),
        F.when(F.col("status") == "no_data", "no_data").otherwise("error").alias("category"),
    )
