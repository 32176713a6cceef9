"""One ingest run: landed pages to normalised rows, upsert, status and failure log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.ingest import (
    distinct_entities,
    failure_records,
    incremental_start,
    ingest_status,
    not_stored,
    restrict_to,
)
from panelforge.session import cut_lineage
from panelforge.sources.pages import normalise_rows, page_rows, read_pages
from panelforge.sources.sinks import append_log
from panelforge.sources.store import read_store, store_exists, upsert


def ingest_landed(
    spark: SparkSession,
    landing: str | list[str],
    store: str,
    requested: DataFrame,
    route: str,
    *,
    resume: bool = False,
    incremental: bool = False,
    lookback_days: int = 7,
    ingested_at: str | None = None,
    failures: DataFrame | None = None,
    log: str | None = None,
    grain: str = "year",
) -> DataFrame:
    """Ingest the landed pages of the ``requested`` entities; returns one status row per entity.

    ``resume`` skips entities that the store already holds.  ``incremental`` takes rows from the last stored
    day less ``lookback_days`` on, of every entity.  The two exclude each other: an incremental run that
    skipped stored entities would never renew them.  Entities that failed or sent nothing go to ``log``.
    """
    if resume and incremental:
        raise ValueError("an incremental run cannot resume")
    known = store_exists(spark, store)
    # A table, since the upsert below changes the store that these entities are read from.
    stored = cut_lineage(distinct_entities(read_store(spark, store))) if resume and known else None
    asked = requested.select("respondent") if stored is None else not_stored(requested, stored)
    rows = normalise_rows(page_rows(read_pages(spark, landing)), route, ingested_at)
    rows = restrict_to(rows, asked)
    if incremental and known:
        start = incremental_start(read_store(spark, store), lookback_days).first()["start"]
        rows = rows.filter(F.col("period") >= F.lit(start))
    fetched = cut_lineage(rows)
    upsert(fetched, store, grain)
    status = cut_lineage(ingest_status(requested, fetched, stored, failures))
    if log is not None:
        append_log(failure_records(status), log)
    return status
