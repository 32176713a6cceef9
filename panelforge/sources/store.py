"""The raw store: Parquet, one row per key, partitioned by calendar year (or year and month)."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.ingest import keep_latest
from panelforge.schema import KEY, RAW_COLUMNS, RAW_SCHEMA, with_nulls_for_nan
from panelforge.session import cut_lineage

GRAINS = {"year": ["year"], "month": ["year", "month"]}


def _partition_value(name: str) -> Column:
    return {"year": F.year, "month": F.month}[name]("period")


def _folder_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(RAW_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def store_exists(spark: SparkSession, path: str) -> bool:
    """Whether the store holds a row; at most one is read."""
    return _folder_exists(spark, path) and not read_store(spark, path).select("year").isEmpty()


def read_store(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """Every partition of the store, or those in ``folders``, with the partition columns."""
    # A month column, where the store has one, is found by partition discovery.
    schema = T.StructType(RAW_SCHEMA.fields + [T.StructField("year", T.IntegerType())])
    try:
        df = spark.read.schema(schema).option("basePath", path).parquet(*(folders or [path]))
    except AnalysisException as error:
        raise FileNotFoundError(f"no raw store at {path}") from error
    return with_nulls_for_nan(df, ["value"])


def year_bounds(start: dt.date | str | None, end: dt.date | str | None) -> list[Column]:
    """Bounds on the partition column that follow from bounds on ``period``."""
    bounds = []
    if start is not None:
        bounds.append(F.col("year") >= F.year(F.lit(str(start)).cast("date")))
    if end is not None:
        bounds.append(F.col("year") <= F.year(F.lit(str(end)).cast("date")))
    return bounds


def scan_store(
    spark: SparkSession,
    path: str,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    require_overlap: bool = True,
) -> DataFrame:
    """The store pruned to the years that overlap ``[start, end]``, then to the days.

    ``require_overlap`` raises when no partition overlaps; the check reads at
    most one row of a pruned scan.
    """
    df = read_store(spark, path)
    bounds = year_bounds(start, end)
    for bound in bounds:
        df = df.filter(bound)
    if bounds and require_overlap and df.select("year").isEmpty():
        raise ValueError(f"no partitions overlap {start} .. {end}")
    if start is not None:
        df = df.filter(F.col("period") >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.filter(F.col("period") <= F.lit(str(end)).cast("date"))
    return df


def _stored_folders(spark: SparkSession, path: str, columns: list[str], touched: list[Row]) -> list[str]:
    """Folders of the touched partitions that the store has; no other folder is listed."""
    folders = ["/".join([path, *[f"{c}={row[c]}" for c in columns]]) for row in touched]
    return [folder for folder in folders if _folder_exists(spark, folder)]


def _replace_partitions(rows: DataFrame, path: str, columns: list[str]) -> None:
    (
        rows.hint("rebalance", *columns)
        .sortWithinPartitions(*columns, "respondent", "type", "period")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*columns)
        .parquet(path)
    )


def _mark(spark: SparkSession, path: str, rows: int) -> None:
    spark.createDataFrame([(rows,)], "rows long").write.mode("overwrite").json(f"{path}.staged_rows")


def _finish_replacement(spark: SparkSession, path: str) -> None:
    """Replace the partitions whose staged rows are complete; also what an interrupted upsert left to do."""
    if not _folder_exists(spark, f"{path}.staged_rows"):
        return
    mark = spark.read.schema("rows long").json(f"{path}.staged_rows").first()
    if mark is None or not mark["rows"]:
        return
    staged = spark.read.parquet(f"{path}.staged")
    if staged.count() != mark["rows"]:
        raise RuntimeError(f"{path}.staged does not hold the {mark['rows']} rows that were staged")
    _replace_partitions(staged, path, [c for c in GRAINS["month"] if c in staged.columns])
    _mark(spark, path, 0)


def upsert(df: DataFrame, path: str, grain: str = "year") -> int:
    """Merge ``df`` into the store; the newest copy of a key wins.

    Only the partitions that ``df`` touches are listed, read and rewritten.
    Their values are collected to prune the read: at most one per calendar year
    (or month).  Rows without a period have no partition and are dropped.  On
    equal ``_ingested_at`` the incoming row wins over the stored one.

    ``df`` is evaluated once, into a table.  The merged rows are staged beside
    the store, counted, and only then replace the old partitions.  An upsert
    that stops between the two is finished by the next one, so no partition is
    lost.  One writer at a time.

    Rows are rebalanced by partition, so that adaptive execution splits a heavy
    year over many tasks, and sorted by key inside each file, so that filters
    on entity and day skip row groups.  Returns the rows in the rewritten
    partitions.
    """
    spark = df.sparkSession
    columns = GRAINS[grain]
    _finish_replacement(spark, path)
    incoming = df.select(*RAW_COLUMNS).filter("period is not null")
    incoming = cut_lineage(incoming.withColumns({name: _partition_value(name) for name in columns}))
    touched = incoming.select(*columns).distinct().collect()
    if not touched:
        return 0

    merged = incoming.withColumn("_incoming", F.lit(1))
    folders = _stored_folders(spark, path, columns, touched)
    if folders:
        stored = read_store(spark, path, folders).withColumns({name: _partition_value(name) for name in columns})
        merged = stored.select(*RAW_COLUMNS, *columns).withColumn("_incoming", F.lit(0)).unionByName(merged)

    written = Observation()
    (
        keep_latest(merged, KEY + columns, order=["_ingested_at", "_incoming"])
        .select(*RAW_COLUMNS, *columns)
        .observe(written, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .parquet(f"{path}.staged")
    )
    rows = int(written.get["rows"])
    _mark(spark, path, rows)
    _finish_replacement(spark, path)
    return rows
