import datetime as dt
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from panelforge.operators import ingest, panel
from panelforge.schema import RAW_COLUMNS, RAW_SCHEMA
from panelforge.sources import pages, sinks, store

T0 = dt.datetime(2024, 3, 1, 6, 0)


def page_row(period="2024-01-05", respondent="AA", type_="D", value="10", **over):
    row = {
        "period": period, "respondent": respondent, "respondent-name": f"{respondent} name", "type": type_,
        "type-name": type_.lower(), "value": value, "value-units": "MWh", "timezone": "Eastern",
    }
    return {**row, **over}


def write_page(folder, name, rows, total=None, **extra):
    body = {"response": {"total": str(len(rows) if total is None else total), "data": rows, **extra}}
    (folder / name).write_text(json.dumps(body))


def raw(spark, *rows):
    """(period, respondent, type, value, ingested offset in hours)"""
    full = [
        (p and dt.date.fromisoformat(p), e, f"{e} name", t, t.lower(), v, "MWh", "Eastern", T0 + dt.timedelta(hours=h), "route")
        for p, e, t, v, h in rows
    ]
    return spark.createDataFrame(full, RAW_SCHEMA)


def keyed(df):
    return {(str(r["period"]), r["respondent"], r["type"]): r["value"] for r in df.collect()}


# ------------------------------------------------------------------ pages


def test_pages_to_raw_rows(spark, tmp_path):
    write_page(tmp_path, "a.json", [page_row(value="12.5"), page_row(type_="TI", value="-7"), page_row(type_="NG", value=None)])
    write_page(tmp_path, "b.json", [page_row("2024-01-06", value="n/a"), page_row("bad date", "BB", value=3)])
    out = pages.normalise_rows(pages.page_rows(pages.read_pages(spark, str(tmp_path))), "route/x", "2024-03-01 00:00:00")
    assert out.columns == RAW_COLUMNS
    assert [f.dataType for f in out.schema] == [f.dataType for f in RAW_SCHEMA]
    got = keyed(out)
    assert got[("2024-01-05", "AA", "D")] == 12.5
    assert got[("2024-01-05", "AA", "TI")] == -7.0
    assert got[("2024-01-05", "AA", "NG")] is None
    assert got[("2024-01-06", "AA", "D")] is None
    assert got[("None", "BB", "D")] == 3.0
    first = out.first()
    assert first["_source_route"] == "route/x" and first["_ingested_at"] == dt.datetime(2024, 3, 1)


def test_missing_source_columns_and_empty_input(spark):
    rows = spark.createDataFrame([("2024-01-01", "AA")], "period string, respondent string")
    out = pages.normalise_rows(rows, "r").first()
    assert out["type"] is None and out["value"] is None and out["period"] == dt.date(2024, 1, 1)
    assert pages.empty_raw(spark).columns == RAW_COLUMNS


def test_nan_text_is_missing(spark):
    rows = spark.createDataFrame([("2024-01-01", "NaN"), ("2024-01-02", "0")], "period string, value string")
    assert [r["value"] for r in pages.normalise_rows(rows, "r").orderBy("period").collect()] == [None, 0.0]


def test_bad_pages(spark, tmp_path):
    write_page(tmp_path, "good.json", [page_row()])
    (tmp_path / "error.json").write_text(json.dumps({"error": "quota"}))
    (tmp_path / "broken.json").write_text('{"response": {"data": [')
    kept = pages.read_pages(spark, str(tmp_path), on_bad="keep")
    reasons = {os.path.basename(r["page"]): r["bad_reason"] for r in kept.collect()}
    assert reasons == {"good.json": None, "error.json": "no response in payload", "broken.json": "invalid JSON"}
    assert pages.page_rows(kept).count() == 1
    with pytest.raises(PySparkException, match="no response|invalid JSON"):
        pages.page_rows(pages.read_pages(spark, str(tmp_path))).collect()


def test_page_audit_and_facets(spark, tmp_path):
    write_page(tmp_path, "a1.json", [page_row(), page_row("2024-01-06")], total=3)
    write_page(tmp_path, "a2.json", [page_row("2024-01-07")], total=3)
    write_page(tmp_path, "b1.json", [page_row(respondent="BB")], total=5)
    write_page(tmp_path, "f.json", [], facets=[{"id": "BB", "name": "b"}, {"id": "AA", "name": "a"}, {"id": "AA", "name": "a"}])
    df = pages.read_pages(spark, str(tmp_path))
    audit = {r["respondent"]: (r["fetched"], r["reported"], r["complete"]) for r in pages.page_audit(df).collect()}
    assert audit == {"AA": (3, 3, True), "BB": (1, 5, False)}
    write_page(tmp_path, "c1.json", [], total=5)
    df = pages.read_pages(spark, str(tmp_path))
    lost = pages.page_audit(df).filter("respondent is null").collect()
    assert [(os.path.basename(r["page"]), r["fetched"], r["reported"], r["complete"]) for r in lost] == [("c1.json", 0, 5, False)]
    base = df.filter("page like '%c1.json'").first()["page"]
    asked = spark.createDataFrame([(base, "CC"), ("never landed", "DD")], "page string, respondent string")
    audit = {r["respondent"]: (r["fetched"], r["reported"], r["complete"]) for r in pages.page_audit(df, asked).collect()}
    assert audit == {"CC": (0, 5, False), "DD": (0, None, False)}
    assert sorted(r[0] for r in pages.facet_ids(df).collect()) == ["AA", "BB"]


# ------------------------------------------------------------------ store


def test_upsert_is_idempotent_and_revisions_win(spark, tmp_path):
    path = str(tmp_path / "store")
    first = raw(spark, ("2023-12-31", "AA", "D", 1.0, 0), ("2024-01-01", "AA", "D", 2.0, 0), ("2024-01-01", "BB", "D", None, 0))
    assert store.upsert(first, path) == 3
    assert store.upsert(first, path) == 3
    revised = raw(spark, ("2024-01-01", "AA", "D", 5.0, 3), ("2024-01-01", "AA", "D", 4.0, 2), (None, "AA", "D", 9.0, 9))
    assert store.upsert(revised, path) == 2
    got = keyed(store.read_store(spark, path))
    assert got == {("2023-12-31", "AA", "D"): 1.0, ("2024-01-01", "AA", "D"): 5.0, ("2024-01-01", "BB", "D"): None}
    # An older copy does not replace a newer one; at equal times the incoming row does.
    store.upsert(raw(spark, ("2024-01-01", "AA", "D", 0.5, 1), ("2023-12-31", "AA", "D", 0.25, 0)), path)
    got = keyed(store.read_store(spark, path))
    assert got[("2024-01-01", "AA", "D")] == 5.0 and got[("2023-12-31", "AA", "D")] == 0.25


def test_upsert_leaves_other_years_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert(raw(spark, ("2022-05-01", "AA", "D", 1.0, 0), ("2023-05-01", "AA", "D", 2.0, 0)), path)
    before = sorted(os.listdir(f"{path}/year=2022"))
    store.upsert(raw(spark, ("2023-05-02", "AA", "D", 3.0, 1)), path)
    assert sorted(os.listdir(f"{path}/year=2022")) == before
    assert len(keyed(store.read_store(spark, path))) == 3
    assert store.upsert(raw(spark, (None, "AA", "D", 3.0, 1)), path) == 0


def test_interrupted_replacement_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.upsert(raw(spark, ("2023-05-01", "AA", "D", 1.0, 0)), path)

    def stop(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patched:
        patched.setattr(store, "_replace_partitions", stop)
        with pytest.raises(RuntimeError, match="executor lost"):
            store.upsert(raw(spark, ("2023-05-02", "AA", "D", 2.0, 1)), path)
    assert keyed(store.read_store(spark, path)) == {("2023-05-01", "AA", "D"): 1.0}
    store.upsert(raw(spark, ("2023-05-03", "AA", "D", 3.0, 2)), path)
    assert keyed(store.read_store(spark, path)) == {
        ("2023-05-01", "AA", "D"): 1.0, ("2023-05-02", "AA", "D"): 2.0, ("2023-05-03", "AA", "D"): 3.0,
    }


def test_month_grain(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert(raw(spark, ("2023-05-01", "AA", "D", 1.0, 0), ("2023-06-01", "AA", "D", 2.0, 0)), path, grain="month")
    before = os.listdir(f"{path}/year=2023/month=5")
    touched = [Row(year=2023, month=6), Row(year=2023, month=9)]
    folders = store._stored_folders(spark, path, ["year", "month"], touched)
    assert folders == [f"{path}/year=2023/month=6"]
    assert keyed(store.read_store(spark, path, folders)) == {("2023-06-01", "AA", "D"): 2.0}
    store.upsert(raw(spark, ("2023-06-01", "AA", "D", 7.0, 1), ("2023-06-02", "AA", "D", 3.0, 1)), path, grain="month")
    assert os.listdir(f"{path}/year=2023/month=5") == before
    assert keyed(store.read_store(spark, path)) == {
        ("2023-05-01", "AA", "D"): 1.0, ("2023-06-01", "AA", "D"): 7.0, ("2023-06-02", "AA", "D"): 3.0,
    }


def test_scan_prunes_years(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert(raw(spark, *[(f"{y}-03-0{d}", "AA", "D", float(d), 0) for y in (2021, 2022, 2023) for d in (1, 2, 3)]), path)
    df = store.scan_store(spark, path, "2022-03-02", "2023-03-01")
    assert sorted(str(r["period"]) for r in df.collect()) == ["2022-03-02", "2022-03-03", "2023-03-01"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(period)" in plan
    with pytest.raises(ValueError, match="no partitions overlap"):
        store.scan_store(spark, path, "2030-01-01")
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, str(tmp_path / "nothing"))


def test_newest_copy_of_a_hot_key(spark):
    hot = spark.range(20000).select(
        F.lit("k").alias("period"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("respondent"),
        F.lit("D").alias("type"), F.col("id").alias("value"), F.col("id").alias("_ingested_at"),
    )
    out = ingest.keep_latest(hot)
    assert out.filter("respondent = 'hot'").first()["value"] == 19998
    assert out.count() == hot.select("respondent").distinct().count()
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_incremental_resume_and_first_entities(spark):
    df = raw(spark, ("2024-02-10", "AA", "D", 1.0, 0), ("2024-02-12", "BB", "D", 1.0, 0))
    assert ingest.incremental_start(df, 7).first()["start"] == dt.date(2024, 2, 5)
    assert ingest.incremental_start(df.limit(0), 7).first()["start"] is None
    asked = spark.createDataFrame([("AA",), ("CC",), ("DD",)], "respondent string")
    assert sorted(r[0] for r in ingest.not_stored(asked, df).collect()) == ["CC", "DD"]
    assert [r[0] for r in ingest.first_entities(asked, 2).collect()] == ["AA", "CC"]
    assert {r["respondent"] for r in ingest.restrict_to(df, asked).collect()} == {"AA"}
    assert {r[0] for r in ingest.distinct_entities(df).collect()} == {"AA", "BB"}
    with pytest.raises(ValueError):
        ingest.pin_timezone(df, None)
    assert ingest.pin_timezone(df, "Pacific").count() == 0


def test_ingest_status_and_log(spark, tmp_path):
    asked = spark.createDataFrame([(x,) for x in ("AA", "BB", "CC", "DD")], "respondent string")
    fetched = raw(spark, ("2024-02-10", "AA", "D", 1.0, 0), ("2024-02-11", "AA", "D", 1.0, 0))
    failures = spark.createDataFrame([("CC", "timeout")], "respondent string, reason string")
    stored = spark.createDataFrame([("DD",)], "respondent string")
    status = ingest.ingest_status(asked, fetched, stored, failures)
    assert {r["respondent"]: (r["status"], r["rows"]) for r in status.collect()} == {
        "AA": ("ok", 2), "BB": ("no_data", 0), "CC": ("failed", 0), "DD": ("skipped", 0),
    }
    assert {r["status"]: r["respondents"] for r in ingest.status_counts(status).collect()} == {
        "ok": 1, "no_data": 1, "failed": 1, "skipped": 1,
    }
    for _ in range(2):
        sinks.append_log(ingest.failure_records(status), str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 4 and {r["category"] for r in log.collect()} == {"no_data", "error"}


# ------------------------------------------------------------------ views


def test_pivot_keeps_all_series_and_drops_empty_days(spark):
    df = raw(
        spark, ("2024-01-01", "AA", "D", 1.0, 0), ("2024-01-01", "AA", "NG", None, 0), ("2024-01-02", "AA", "D", None, 0),
        ("2024-01-03", "AA", "DF", float("nan"), 0), ("2024-01-04", "AA", "XX", 4.0, 0),
    )
    out = panel.to_wide(df)
    assert out.columns == ["period", "respondent", "demand", "demand_forecast", "net_generation", "interchange"]
    assert [tuple(r)[1:] for r in out.collect()] == [("AA", 1.0, None, None, None)]


def test_window_filter_is_inclusive(spark):
    df = raw(spark, *[(f"2024-01-0{d}", e, "D", 1.0, 0) for d in range(1, 6) for e in ("AA", "BB")])
    out = panel.filter_window(df, "2024-01-02", "2024-01-04", ["AA"], ["D"])
    assert sorted(str(r["period"]) for r in out.collect()) == ["2024-01-02", "2024-01-03", "2024-01-04"]
    semi = panel.filter_window(df, respondents=spark.createDataFrame([("BB",)], "respondent string"))
    assert semi.count() == 5
    assert [r["respondent"] for r in panel.long_view(df).limit(2).collect()] == ["AA", "BB"]
