import datetime as dt

import pytest
from conftest import PANEL_SCHEMA, panel_rows
from pyspark.sql import functions as F
from test_ingest import keyed, raw

from panelforge.operators.features import build_features
from panelforge.sources import feature_store, snapshots


def test_readers_keep_their_version_and_see_the_newest_next(spark, tmp_path):
    root = str(tmp_path / "store")
    assert snapshots.upsert_raw(raw(spark, ("2024-01-05", "AA", "D", 1.0, 0), ("2023-05-01", "AA", "D", 2.0, 0)), root) == 1
    before = snapshots.read_raw(spark, root)
    assert snapshots.upsert_raw(raw(spark, ("2024-01-05", "AA", "D", 9.0, 1), ("2024-01-06", "AB", "D", 3.0, 1)), root) == 2
    assert keyed(before) == {("2024-01-05", "AA", "D"): 1.0, ("2023-05-01", "AA", "D"): 2.0}
    now = snapshots.read_raw(spark, root)
    assert keyed(now) == {("2024-01-05", "AA", "D"): 9.0, ("2024-01-06", "AB", "D"): 3.0, ("2023-05-01", "AA", "D"): 2.0}
    # An older ingest time does not win, an equal one does; untouched years stay where they are.
    snapshots.upsert_raw(raw(spark, ("2024-01-05", "AA", "D", 7.0, 0), ("2024-01-06", "AB", "D", 4.0, 1)), root)
    assert keyed(snapshots.read_raw(spark, root))[("2024-01-05", "AA", "D")] == 9.0
    assert keyed(snapshots.read_raw(spark, root))[("2024-01-06", "AB", "D")] == 4.0
    first, third = (snapshots.read_manifest(spark, root, v) for v in (1, 3))
    assert first[(2023,)] == third[(2023,)] and first[(2024,)] != third[(2024,)]
    only = snapshots.read_raw(spark, root, years=range(2023, 2024))
    assert {f.split("year=")[1][:4] for f in only.inputFiles()} == {"2023"}


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    root = str(tmp_path / "store")
    snapshots.upsert_raw(raw(spark, ("2024-01-05", "AA", "D", 1.0, 0)), root)
    rows = snapshots.read_raw(spark, root)
    snapshots.commit_partitions(rows.withColumn("value", F.lit(2.0)), root, ["year"], [(2024,)], 1)
    with pytest.raises(snapshots.ConcurrentCommit):
        snapshots.commit_partitions(rows.withColumn("value", F.lit(3.0)), root, ["year"], [(2024,)], 1)
    # Also when the other one publishes at the very last moment.
    with pytest.raises(snapshots.ConcurrentCommit):
        snapshots.publish(spark, root, 2, {})
    assert keyed(snapshots.read_raw(spark, root)) == {("2024-01-05", "AA", "D"): 2.0}


@pytest.mark.parametrize("step", ["data", "draft"])
def test_a_writer_that_stops_before_the_manifest_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "store")
    snapshots.upsert_raw(raw(spark, ("2024-01-05", "AA", "D", 1.0, 0)), root)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "publish" if step == "draft" else "read_manifest", stop)
        with pytest.raises(KeyboardInterrupt):
            rows = raw(spark, ("2024-01-05", "AA", "D", 5.0, 1)).withColumn("year", F.lit(2024))
            snapshots.commit_partitions(rows, root, ["year"], [(2024,)], 1)
    assert keyed(snapshots.read_raw(spark, root)) == {("2024-01-05", "AA", "D"): 1.0}
    assert snapshots.upsert_raw(raw(spark, ("2024-01-05", "AA", "D", 6.0, 1)), root) == 2
    assert keyed(snapshots.read_raw(spark, root)) == {("2024-01-05", "AA", "D"): 6.0}
    assert snapshots.vacuum(spark, root, keep=1) == 2  # the stopped commit and the first version
    assert keyed(snapshots.read_raw(spark, root)) == {("2024-01-05", "AA", "D"): 6.0}


def test_nothing_stored_and_nothing_to_store(spark, tmp_path):
    root = str(tmp_path / "none")
    assert snapshots.read_raw(spark, root).count() == 0
    assert snapshots.upsert_raw(raw(spark, (None, "AA", "D", 1.0, 0)), root) == 0
    snapshots.upsert_raw(raw(spark, ("2024-01-05", "AA", "D", 1.0, 0)), root)
    snapshots.commit_partitions(snapshots.read_raw(spark, root).filter("false"), root, ["year"], [(2024,)], 1)
    assert snapshots.read_raw(spark, root).count() == 0


# ------------------------------------------------------------------ features kept up to date


def same(left, right):
    columns = left.columns
    return left.exceptAll(right.select(*columns)).count() == 0 and right.select(*columns).exceptAll(left).count() == 0


def test_revised_features_equal_a_full_rebuild(spark, tmp_path, tier_map):
    root = str(tmp_path / "features")
    start = dt.date(2023, 11, 1)

    def on(n):
        return start + dt.timedelta(n)

    rows = {(e, d): list(v) for d, e, *v in panel_rows({"AA": 9000.0, "BA": 900.0, "CA": 90.0}, 800, {("BA", n) for n in range(100, 520)})}

    def frame(days=None):
        picked = [(d, e, *v) for (e, d), v in rows.items() if any(x is not None for x in v)]
        df = spark.createDataFrame(picked, PANEL_SCHEMA)
        return df if days is None else df.filter(F.col("period").between(*days))

    feature_store.build_store(frame(), root, tier_map)
    assert same(feature_store.read_store(spark, root).drop("year"), build_features(frame(), tier_map))
    asked = []
    steps = [
        {("AA", 500): [1.0, 2.0, 3.0, 4.0]},
        {("BA", 530): [7.0, None, None, None], ("BA", 300): [5.0, 5.0, 5.0, 5.0]},  # within the gap of a year and more
        {("CA", 0): [None] * 4, ("CA", 1): [None] * 4},  # the first days go
        {("CA", 799): [None] * 4, ("AA", 803): [8000.0, 1.0, 1.0, 1.0], ("NEW", 400): [1.0, 1.0, 1.0, 1.0], ("NEW", 401): [2.0, 1.0, 1.0, 1.0]},
        {("AA", -3): [5.0, 1.0, 1.0, 1.0]},
    ]
    for changed in steps:
        for (e, n), v in changed.items():
            rows[e, on(n)] = v
        touched = spark.createDataFrame([(e, on(n)) for e, n in changed], "respondent string, period date")

        def between(a, b):
            asked.append((a, b))
            return frame((a, b))

        feature_store.revise_store(touched, between, root, tier_map)
        assert same(feature_store.read_store(spark, root).drop("year"), build_features(frame(), tier_map)), changed
    assert asked[0] == (str(on(500 - 365)), str(on(500 + 365)))
    # A revision writes the partitions it touches only.
    first, second = (snapshots.read_manifest(spark, root, v) for v in (1, 2))
    assert {p for p in second if second[p] != first.get(p)} == {("Large", 2025), ("Large", 2026)}


def test_nothing_touched(spark, tmp_path, small_panel, tier_map):
    root = str(tmp_path / "features")
    feature_store.build_store(small_panel, root, tier_map)
    none = spark.createDataFrame([], "respondent string, period date")
    assert feature_store.revise_store(none, lambda a, b: small_panel, root, tier_map) == 1
    medium = feature_store.read_store(spark, root, "Medium")
    assert medium.count() and {f.split("tier=")[1].split("/")[0] for f in medium.inputFiles()} == {"Medium"}
