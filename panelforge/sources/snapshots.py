"""Partitioned tables with snapshot isolation: versioned partition folders and a manifest that is written last.

``root/data/<commit>/<partition>`` holds the files of one commit and is never changed.  ``root/manifest/<n>`` lists, for version
``n``, which commit holds each live partition.  A reader takes the newest manifest and sees this version to the end, whatever is
written meanwhile.  A writer puts new folders beside the old ones and then publishes manifest ``n + 1`` by a rename that does not
replace: of two writers that started from version ``n`` the second is refused, and its folders are in no manifest.

A run that stops anywhere before the rename leaves folders that nobody reads; :func:`vacuum` removes them.  Manifests have one line per
partition, so their size hangs on the calendar, not on the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.ingest import keep_latest
from panelforge.schema import KEY, RAW_COLUMNS, RAW_SCHEMA
from panelforge.session import cut_lineage
from panelforge.sources.store import GRAINS


class ConcurrentCommit(RuntimeError):
    """Another writer has published the version this commit was to become."""


Manifest = dict[tuple, str]


def _files(spark: SparkSession, root: str):
    """Hadoop's file system of ``root`` and a maker of its paths."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    return hadoop.fs.Path(root).getFileSystem(conf), hadoop.fs.Path


def current_version(spark: SparkSession, root: str) -> int:
    """The newest published version; 0 where there is none."""
    files, path = _files(spark, root)
    folder = path(f"{root}/manifest")
    if not files.exists(folder):
        return 0
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def read_manifest(spark: SparkSession, root: str, version: int) -> Manifest:
    """Commit folder by partition values."""
    if version == 0:
        return {}
    lines = spark.read.text(f"{root}/manifest/{version}").collect()
    return {tuple(entry["partition"]): entry["commit"] for entry in (json.loads(line["value"]) for line in lines if line["value"])}


def publish(spark: SparkSession, root: str, version: int, manifest: Manifest) -> None:
    """Make ``manifest`` version ``version``; refused when that version is there already."""
    files, path = _files(spark, root)
    draft, final = path(f"{root}/drafts/{uuid.uuid4().hex}"), path(f"{root}/manifest/{version}")
    out = files.create(draft, False)
    lines = [json.dumps({"partition": list(p), "commit": c}) for p, c in sorted(manifest.items(), key=str)]
    out.write(bytearray("\n".join(lines), "utf-8"))
    out.close()
    files.mkdirs(path(f"{root}/manifest"))
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, final, plain)
    except Exception as error:
        if files.exists(final):
            raise ConcurrentCommit(f"{root} has a version {version} already") from error
        raise


def _folder(columns: list[str], values: tuple) -> str:
    return "/".join(f"{c}={v}" for c, v in zip(columns, values, strict=True))


def read_snapshot(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    columns: list[str],
    version: int | None = None,
    only: Callable[[tuple], bool] | None = None,
) -> DataFrame:
    """One version of the table (the newest by default), with its partition columns; ``only`` picks partitions by their values.

    Folders of other partitions and of other commits are not even listed.
    """
    version = current_version(spark, root) if version is None else version
    manifest = read_manifest(spark, root, version)
    names = [f.name for f in schema.fields if f.name not in columns]
    plain = T.StructType([f for f in schema.fields if f.name not in columns])
    by_commit: dict[str, list[str]] = {}
    for partition, commit in manifest.items():
        if only is None or only(partition):
            by_commit.setdefault(commit, []).append(f"{root}/data/{commit}/{_folder(columns, partition)}")
    full = T.StructType([*plain.fields, *[schema[c] for c in columns]])
    out = None
    for commit, folders in sorted(by_commit.items()):
        part = spark.read.schema(full).option("basePath", f"{root}/data/{commit}").parquet(*folders).select(*names, *columns)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], full)


def commit_partitions(
    rows: DataFrame, root: str, columns: list[str], touched: list[tuple], based_on: int, order: list[str] | None = None
) -> int:
    """Replace the ``touched`` partitions by ``rows`` and publish the next version, which is returned.

    A touched partition without rows leaves the table.  ``based_on`` is the version that was read to make ``rows``.
    """
    spark = rows.sparkSession
    if current_version(spark, root) != based_on:
        raise ConcurrentCommit(f"{root} is past version {based_on}")
    commit = uuid.uuid4().hex
    place = f"{root}/data/{commit}"
    (
        rows.hint("rebalance", *columns)
        .sortWithinPartitions(*columns, *(order or []))
        .write.option("compression", "zstd")
        .partitionBy(*columns)
        .parquet(place)
    )
    manifest = read_manifest(spark, root, based_on)
    files, path = _files(spark, root)
    for values in touched:
        if files.exists(path(f"{place}/{_folder(columns, values)}")):
            manifest[values] = commit
        else:
            manifest.pop(values, None)
    publish(spark, root, based_on + 1, manifest)
    return based_on + 1


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove folders that none of the ``keep`` newest versions lists, and older manifests; returns the number of folders.

    To be run when no writer is at work and no reader holds an older version.
    """
    files, path = _files(spark, root)
    newest = current_version(spark, root)
    kept = range(max(1, newest - keep + 1), newest + 1)
    live = {commit for v in kept for commit in read_manifest(spark, root, v).values()}
    removed = 0
    if files.exists(path(f"{root}/data")):
        for status in files.listStatus(path(f"{root}/data")):
            if status.getPath().getName() not in live:
                removed += bool(files.delete(status.getPath(), True))
    for status in files.listStatus(path(f"{root}/manifest")) if newest else []:
        if status.getPath().getName().isdigit() and int(status.getPath().getName()) not in kept:
            files.delete(status.getPath(), True)
    files.delete(path(f"{root}/drafts"), True)
    return removed


# ------------------------------------------------------------------ the raw store as snapshots


def raw_schema(grain: str) -> T.StructType:
    return T.StructType([*RAW_SCHEMA.fields, *[T.StructField(c, T.IntegerType()) for c in GRAINS[grain]]])


def read_raw(spark: SparkSession, root: str, grain: str = "year", years: range | None = None, version: int | None = None) -> DataFrame:
    """The raw store at one version, pruned to ``years``."""
    only = None if years is None else lambda values: values[0] in years
    return read_snapshot(spark, root, raw_schema(grain), GRAINS[grain], version, only)


def upsert_raw(df: DataFrame, root: str, grain: str = "year") -> int:
    """Merge rows into the raw store as a new version; the newest copy of a key wins, the incoming one on equal ingest times.

    Only the partitions that ``df`` touches are read and written.  Rows without a period have no partition and are dropped.
    Returns the version; an empty ``df`` publishes none.
    """
    spark = df.sparkSession
    columns = GRAINS[grain]
    based_on = current_version(spark, root)
    parts = {"year": F.year("period"), "month": F.month("period")}
    incoming = df.select(*RAW_COLUMNS).filter("period is not null").withColumns({c: parts[c] for c in columns})
    incoming = cut_lineage(incoming)
    touched = [tuple(row) for row in incoming.select(*columns).distinct().collect()]
    if not touched:
        return based_on
    wanted = set(touched)
    stored = read_snapshot(spark, root, raw_schema(grain), columns, based_on, lambda values: values in wanted)
    merged = stored.withColumn("_incoming", F.lit(0)).unionByName(incoming.withColumn("_incoming", F.lit(1)))
    newest = keep_latest(merged, KEY + columns, order=["_ingested_at", "_incoming"]).select(*RAW_COLUMNS, *columns)
    return commit_partitions(newest, root, columns, touched, based_on, ["respondent", "type", "period"])

