import datetime as dt
import json

from pyspark.sql import functions as F
from test_ingest import keyed, page_row, raw, write_page

from panelforge.operators import models
from panelforge.schema import RAW_SCHEMA
from panelforge.sources import store
from panelforge.streaming import ingest, rollups
from panelforge.streaming.scoring import score_stream


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_upsert_keeps_the_newest_revision(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    write_page(landing, "p1.json", [page_row("2024-01-05", value="1"), page_row("2023-12-31", value="2")])
    for name, value in (("p2.json", "9"), ("p3.json", None)):
        run(ingest.upsert_stream(ingest.stream_pages(spark, str(landing), "route"), path, str(tmp_path / "cp")))
        if value:
            write_page(landing, name, [page_row("2024-01-05", value=value)])
    got = keyed(store.read_store(spark, path))
    assert got == {("2024-01-05", "AA", "D"): 9.0, ("2023-12-31", "AA", "D"): 2.0}
    # A second run without new files changes nothing.
    run(ingest.upsert_stream(ingest.stream_pages(spark, str(landing), "route"), path, str(tmp_path / "cp")))
    assert keyed(store.read_store(spark, path)) == got


def test_repeats_are_dropped(spark, tmp_path):
    src = str(tmp_path / "src")
    raw(spark, ("2024-01-05", "AA", "D", 1.0, 0), ("2024-01-06", "AA", "D", 2.0, 0)).coalesce(1).write.parquet(src)
    raw(spark, ("2024-01-05", "AA", "D", 1.0, 0), ("2024-01-07", "AA", "D", 3.0, 0)).coalesce(1).write.mode("append").parquet(src)
    stream = ingest.drop_repeats(ingest.stream_observations(spark, src, RAW_SCHEMA, files_per_trigger=1))
    run(ingest.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(str(r["period"]) for r in out.collect()) == ["2024-01-05", "2024-01-06", "2024-01-07"]


EVENTS = "event_ts timestamp, respondent string, type string, value double"


def events(spark):
    start = dt.datetime(2024, 1, 1, 12)
    rows = [
        (start + dt.timedelta(days=d, hours=h), e, "D", [5.0, 0.0, -1.0, None][(d + h) % 4])
        for d in range(12) for h in range(3) for e in ("A", "B")
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_stream_rollup_agrees_with_batch_on_closed_days(spark, tmp_path):
    src = str(tmp_path / "events")
    events(spark).coalesce(1).write.parquet(src)
    for name, fn in (("rollup", rollups.daily_rollup), ("quality", rollups.daily_quality)):
        stream = fn(spark.readStream.schema(EVENTS).parquet(src), "2 days")
        run(ingest.append_stream(stream, str(tmp_path / name), str(tmp_path / f"cp_{name}")))
        got = spark.read.parquet(str(tmp_path / name))
        batch = fn(spark.read.schema(EVENTS).parquet(src))
        last = got.agg(F.max("day")).first()[0]
        assert last == dt.date(2024, 1, 9)  # newest event Jan 12 14:00, less two days
        closed = batch.filter(F.col("day") <= F.lit(last))
        assert got.count() == closed.count() > 0
        assert got.exceptAll(closed.select(*got.columns)).count() == 0


def test_late_rows_are_cut(spark, tmp_path):
    src = str(tmp_path / "events")
    events(spark).coalesce(1).write.parquet(src)
    reader = lambda: spark.readStream.schema(EVENTS).parquet(src)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    run(ingest.append_stream(rollups.daily_rollup(reader(), "2 days"), out, cp))
    late = [(dt.datetime(2024, 1, 1, 1), "A", "D", 100.0), (dt.datetime(2024, 1, 20), "A", "D", 1.0)]
    spark.createDataFrame(late, EVENTS).coalesce(1).write.mode("append").parquet(src)
    run(ingest.append_stream(rollups.daily_rollup(reader(), "2 days"), out, cp))
    got = spark.read.parquet(out)
    assert got.filter("day = date'2024-01-01' and respondent = 'A'").first()["n"] == 3
    assert got.filter("day = date'2024-01-12'").count() == 2


def test_stream_scoring_agrees_with_batch(spark, small_panel, tier_map, tmp_path):
    from panelforge.operators import features, splits

    table = features.build_features(small_panel, tier_map)
    table.coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    parts = splits.split_time_series(rows)
    fast = {"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 2}
    used = ["demand_t", "demand_lag_7"]
    model = models.fit_tier(parts.filter("split = 'train'"), parts.filter("split = 'val'"), "Large", fast, used)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    run(ingest.append_stream(score_stream(stream, {"Large": model}), str(tmp_path / "scored"), str(tmp_path / "cp")))
    columns = ["respondent", "target_date", "model_prediction"]
    got = spark.read.parquet(str(tmp_path / "scored")).select(*columns)
    want = models.predict_with_tier_models(rows, {"Large": model}).select(*columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_page_helper(tmp_path):
    write_page(tmp_path, "x.json", [page_row()])
    assert json.loads((tmp_path / "x.json").read_text())["response"]["total"] == "1"


def test_a_page_that_lands_again_yields_its_rows_once(spark, tmp_path):
    landing, out, state = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "cp")
    landing.mkdir()

    def land(name, *rows):
        write_page(landing, name, [page_row(p, e, t, v) for p, e, t, v in rows])
        run(ingest.append_stream(ingest.revisions(ingest.stream_pages(spark, str(landing), "route")), out, state))

    first = [("2024-01-05", "AA", "D", "1"), ("2024-01-06", "AA", "D", None), ("2024-01-05", "AA", "TI", "1"), ("2024-01-05", "AA", "D", "1")]
    land("p1.json", *first)
    land("p2.json", *first)
    land("p3.json", ("2024-01-05", "AA", "D", "2"), ("2024-01-06", "AA", "D", "5"))
    land("p4.json", ("2024-01-05", "AA", "D", "1"), ("2024-01-06", "AA", "D", None))  # changed back
    land("p5.json", ("2024-01-20", "AA", "D", "7"))  # a later day moves the watermark
    land("p6.json", ("2024-01-05", "AA", "D", "9"), ("2024-01-18", "AA", "D", "3"))  # late, and not late
    got = [(str(r["period"]), r["type"], r["value"]) for r in spark.read.parquet(out).collect()]
    want = [
        ("2024-01-05", "D", 1.0), ("2024-01-05", "D", 1.0), ("2024-01-05", "D", 2.0), ("2024-01-05", "TI", 1.0),
        ("2024-01-06", "D", 5.0), ("2024-01-06", "D", None), ("2024-01-06", "D", None),
        ("2024-01-18", "D", 3.0), ("2024-01-20", "D", 7.0),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_revisions_of_a_batch_agree_with_the_stream(spark, tmp_path):
    rows = raw(spark, *[("2024-01-05", "AA", "D", v, h) for h, v in enumerate([1.0, 1.0, None, None, 2.0, 1.0, 1.0])])
    batch = [(r["value"], r["_ingested_at"].hour) for r in ingest.revisions(rows).orderBy("_ingested_at").collect()]
    assert batch == [(1.0, 6), (None, 8), (2.0, 10), (1.0, 11)]
    rows.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = ingest.revisions(ingest.stream_observations(spark, str(tmp_path / "src"), RAW_SCHEMA))
    run(ingest.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("_ingested_at").collect()
    assert [(r["value"], r["_ingested_at"].hour) for r in got] == batch


def stump(tier, low, high, spark):
    import numpy as np

    from panelforge.operators.boosting import BoostedTrees, Tree

    tree = Tree.of({"feature": [0, -1, -1], "cut": [1, 0, 0], "missing_left": [True, False, False], "left": [1, 0, 0], "right": [2, 0, 0], "value": [0.0, low, high]})
    entities = spark.createDataFrame([("AA", None, False), ("AB", None, True)], "respondent string, _level double, fallback boolean")
    return models.TierModel(tier, BoostedTrees([np.array([10.0]), np.array([])], 0.0, 1.0, [tree]), 1.0, ["demand_t"], entities)


def test_scoring_follows_the_newest_models_and_a_replay_writes_nothing_twice(spark, tmp_path):
    from panelforge.streaming import scoring

    schema = "respondent string, tier string, demand_t double, naive_persistence double"
    src, out, root, cp = (str(tmp_path / n) for n in ("src", "out", "models", "cp"))

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        run(scoring.score_with_newest(stream, root, out, cp))

    assert scoring.publish_models({"Large": stump("Large", 1.0, 2.0, spark)}, root) == 1
    arrive(("AA", "Large", 5.0, 0.5), ("AB", "Large", 50.0, 0.5), ("AA", "Small", 50.0, 0.5))
    assert scoring.publish_models({"Large": stump("Large", 3.0, 4.0, spark), "Small": stump("Small", 5.0, 6.0, spark)}, root) == 2
    arrive(("AA", "Large", 50.0, 0.5), ("AA", "Small", None, 0.5))
    got = [tuple(r) for r in scoring.read_scored(spark, out).select("tier", "demand_t", "model_prediction", "model_version").collect()]
    want = [("Large", 5.0, 1.0, 1), ("Large", 50.0, 0.5, 1), ("Small", 50.0, None, 1), ("Large", 50.0, 4.0, 2), ("Small", None, 5.0, 2)]
    assert sorted(got, key=str) == sorted(want, key=str)
    # The last batch is run again, as after a failure before its commit was noted.
    import shutil

    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    shutil.move(str(last), str(tmp_path / "undone"))
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run(scoring.score_with_newest(spark.readStream.schema(schema).parquet(src), root, out, cp))
    again = [tuple(r) for r in scoring.read_scored(spark, out).select("tier", "demand_t", "model_prediction", "model_version").collect()]
    assert sorted(again, key=str) == sorted(want, key=str)
