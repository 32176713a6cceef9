"""A feature store that is kept up to date: only the days behind a revision are computed and replaced.

The features of day ``t`` look 364 days back and one day on.  A revised day ``d`` therefore touches the rows of ``d - 1 ... d + 364`` of its
entity, and to compute these the panel is needed from ``d - 365`` to ``d + 365``.  Nothing else is read.

Rows are kept as snapshots by tier and year, so a reader sees the store before or after a revision and never between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.features import build_features
from panelforge.schema import DEMAND_LAGS, SERIES
from panelforge.session import cut_lineage
from panelforge.sources import snapshots

PARTITIONS = ["tier", "year"]
REACH = max(DEMAND_LAGS)


def _placed(features: DataFrame) -> DataFrame:
    return features.withColumn("year", F.year("target_date"))


def _schema(spark: SparkSession) -> T.StructType:
    """The schema of the store, from the features of an empty panel."""
    empty = spark.createDataFrame([], "period date, respondent string, " + ", ".join(f"{c} double" for c in SERIES.values()))
    return _placed(build_features(empty)).schema


_FIRST_DAYS = T.StructType([T.StructField("respondent", T.StringType()), T.StructField("first_day", T.DateType())])


def _write_first_days(days: DataFrame, root: str) -> None:
    """An entity's first day in the panel, a small table beside the store; to write it again changes nothing."""
    place = f"{root}/first_days"
    version = snapshots.current_version(days.sparkSession, place)
    snapshots.commit_partitions(cut_lineage(days.select("respondent", "first_day")), place, [], [()], version, ["respondent"])


def _read_first_days(spark: SparkSession, root: str) -> DataFrame:
    return snapshots.read_snapshot(spark, f"{root}/first_days", _FIRST_DAYS, [])


def build_store(panel: DataFrame, root: str, tiers: dict | DataFrame) -> int:
    """The whole store from a panel; replaces what is there as a new version."""
    spark = panel.sparkSession
    features = cut_lineage(_placed(build_features(panel, tiers)))
    based_on = snapshots.current_version(spark, root)
    stale = list(snapshots.read_manifest(spark, root, based_on))
    touched = {tuple(r) for r in features.select(*PARTITIONS).distinct().collect()} | set(stale)
    _write_first_days(panel.groupBy("respondent").agg(F.min("period").alias("first_day")), root)
    return snapshots.commit_partitions(features, root, PARTITIONS, sorted(touched), based_on, ["respondent", "target_date"])


def read_store(spark: SparkSession, root: str, tier: str | None = None, version: int | None = None) -> DataFrame:
    """Stored features, of one tier if asked; other tiers' folders are not listed."""
    only = None if tier is None else lambda values: values[0] == tier
    return snapshots.read_snapshot(spark, root, _schema(spark), PARTITIONS, version, only)


def revise_store(
    touched: DataFrame, panel_between: Callable[[str, str], DataFrame], root: str, tiers: dict | DataFrame
) -> int:
    """Recompute what hangs on the ``touched`` days - rows of ``respondent`` and ``period`` - and publish a new version.

    ``panel_between`` gives the revised wide panel between two days, both included; it is asked once, for the days that the
    revisions reach.  An entity's days from its first to its last touched one count as touched.  Days that lost their values
    may be among them; an entity that loses all its days within a year of its first is taken to begin anew.  The result equals a store built anew from the revised panel.
    """
    spark = touched.sparkSession
    based_on = snapshots.current_version(spark, root)
    first_days = _read_first_days(spark, root)
    spans = touched.filter("period is not null and respondent is not null").groupBy("respondent").agg(
        F.date_sub(F.min("period"), 1).alias("replaced_from"), F.date_add(F.max("period"), REACH).alias("replaced_to")
    )
    spans = cut_lineage(spans)
    span = spans.agg(F.min("replaced_from").alias("a"), F.max("replaced_to").alias("b")).first()
    if span["a"] is None:
        return based_on
    reach = spans.withColumns(
        {"read_from": F.date_sub("replaced_from", REACH), "read_to": F.date_add("replaced_to", 1)}
    )
    bounds = reach.agg(F.min("read_from").cast("string").alias("a"), F.max("read_to").cast("string").alias("b")).first()
    values = list(SERIES.values())
    read = panel_between(bounds["a"], bounds["b"]).join(reach, "respondent")
    read = cut_lineage(read.filter("period between read_from and read_to").select("period", "respondent", *values))

    seen = read.groupBy("respondent").agg(F.min("period").alias("seen"))
    moved = first_days.join(spans, "respondent", "full").join(seen, "respondent", "left")
    is_moved = F.col("first_day").isNull() | (F.col("replaced_from") < F.col("first_day"))
    moved = moved.select("respondent", F.when(is_moved, F.col("seen")).otherwise(F.col("first_day")).alias("first_day"))
    _write_first_days(moved, root)

    # Where an entity began before what is read, its days are filled from the first day read on.
    began = first_days.join(reach, "respondent").filter("first_day < read_from")
    began = began.select(F.col("read_from").alias("period"), "respondent").join(read, ["period", "respondent"], "left_anti")
    known = read.unionByName(began.select("*", *[F.lit(None).cast("double").alias(v) for v in values]))
    fresh = _placed(build_features(known, tiers)).join(spans, "respondent")
    fresh = fresh.filter("forecast_date between replaced_from and replaced_to").drop("replaced_from", "replaced_to")
    fresh = cut_lineage(fresh)

    schema = _schema(spark)
    years = range(span["a"].year, span["b"].year + 2)
    manifest = snapshots.read_manifest(spark, root, based_on)
    new = {tuple(r) for r in fresh.select(*PARTITIONS).distinct().collect()}
    in_years = {p for p in manifest if p[1] in years}
    stored = snapshots.read_snapshot(spark, root, schema, PARTITIONS, based_on, lambda p: p in in_years)
    gone = stored.join(spans, "respondent").filter("forecast_date between replaced_from and replaced_to")
    hit = new | {tuple(r) for r in gone.select(*PARTITIONS).distinct().collect()}
    kept = snapshots.read_snapshot(spark, root, schema, PARTITIONS, based_on, lambda p: p in hit)
    kept = kept.join(spans, "respondent", "left").filter(
        "replaced_from is null or not (forecast_date between replaced_from and replaced_to)"
    )
    columns = [f.name for f in schema.fields]
    rows = kept.select(*columns).unionByName(fresh.select(*columns))
    return snapshots.commit_partitions(rows, root, PARTITIONS, sorted(hit), based_on, ["respondent", "target_date"])
