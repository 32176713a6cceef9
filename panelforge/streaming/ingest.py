"""Streaming ingest: landed files, revisions of recent days, upsert into the raw store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelforge.schema import KEY
from panelforge.sources.pages import PAGE_SCHEMA, checked_pages, normalise_rows, page_rows
from panelforge.sources.store import upsert

LOOKBACK = "7 days"
REVISION = [*KEY, "value", "_ingested_at"]


def stream_pages(
    spark: SparkSession, path: str, route: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Normalised rows of JSON pages as they land in a folder.

    A bad page fails the stream, as it fails the batch read, and is met again after a restart.
    """
    reader = spark.readStream.schema(PAGE_SCHEMA).option("multiLine", True).option(
        "columnNameOfCorruptRecord", "_corrupt_record"
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return normalise_rows(page_rows(checked_pages(reader.json(path), "raise")), route)


def stream_observations(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None
) -> DataFrame:
    """Observation files (Parquet) as they land in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drop_repeats(df: DataFrame, key: list[str] = REVISION, time: str = "period", lookback: str = LOOKBACK) -> DataFrame:
    """First copy of each key among rows no older than ``lookback``.

    The default key holds value and ingest time, so that a revision of a row is no repeat and goes on.
    Event time must be a timestamp with zone, so a day becomes its midnight.
    State is kept for the lookback only.
    """
    stamped = df.withColumn("event_ts", F.col(time).cast("timestamp"))
    return stamped.withWatermark("event_ts", lookback).dropDuplicatesWithinWatermark(key)


_KNOWN = "days array<date>, held array<boolean>, numbers array<double>"


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one entity, type and month, in order of ingest, whose value is not their day's last one.

    The state is the last value of each day of the month; ``held`` tells a missing value from a number.
    """
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values(["period", "_ingested_at", "value"], kind="stable", na_position="first")
    day, value = rows["period"].to_numpy(), rows["value"].to_numpy(dtype=float, na_value=np.nan)
    known = {d: (x if h else np.nan) for d, h, x in zip(*state.get)} if state.exists else {}
    first = np.r_[True, day[1:] != day[:-1]]
    before = np.r_[np.nan, value[:-1]]
    before[first] = [known.get(d, np.nan) for d in day[first]]
    unknown = np.zeros(len(rows), bool)
    unknown[first] = [d not in known for d in day[first]]
    same = (value == before) | (np.isnan(value) & np.isnan(before))
    last = np.r_[first[1:], True]
    known |= dict(zip(day[last], value[last]))
    days = sorted(d for d in known if d is not None)
    if days:
        state.update((days, [not np.isnan(known[d]) for d in days], [0.0 if np.isnan(known[d]) else float(known[d]) for d in days]))
        # Rows of this month are late from then on, so nothing can be compared with the state any more.
        ends = int(pd.Timestamp(days[-1]).timestamp() + 86_400) * 1000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
    rows = rows[unknown | ~same]
    if len(rows):
        yield rows


def revisions(df: DataFrame, lookback: str = LOOKBACK) -> DataFrame:
    """Rows that change what is known of their key ``(period, respondent, type)``, across batches.

    A row seen again, in the same batch or a later one, goes no further, whatever its ingest time; a value that changes and
    changes back is two revisions.  A missing value is a value here.  Rows older than ``lookback`` behind the newest period
    are late and dropped, and so is the state of their days.  Rows without a period are compared within their batch only.

    A group is an entity's month of one type, so a batch of any entity is spread over its months.  Without a stream the same rows
    come from one ordered comparison per key.
    """
    if not df.isStreaming:
        by_key = Window.partitionBy(*KEY).orderBy(F.col("_ingested_at").asc_nulls_first(), F.col("value").asc_nulls_first())
        number, before = F.row_number().over(by_key), F.lag("value").over(by_key)
        changed = df.withColumn("_changed", (number == 1) | ~F.col("value").eqNullSafe(before))
        return changed.filter("_changed").drop("_changed")
    stamped = df.withColumn("event_ts", F.col("period").cast("timestamp")).withWatermark("event_ts", lookback)
    placed = stamped.withColumn("_month", F.trunc("period", "month"))
    changed = placed.groupBy("respondent", "type", "_month").applyInPandasWithState(
        _changes, placed.schema, _KNOWN, "append", GroupStateTimeout.EventTimeTimeout
    )
    return changed.drop("event_ts", "_month")


def upsert_stream(
    df: DataFrame, store: str, checkpoint: str, grain: str = "year", available_now: bool = True
) -> StreamingQuery:
    """Upsert every micro-batch into the raw store; the newest revision of a key wins.

    A batch that is run again after a failure writes the same rows, so the
    store does not change.
    """

    def write(batch: DataFrame, _: int) -> None:
        upsert(batch, store, grain)

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed results to Parquet files."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
