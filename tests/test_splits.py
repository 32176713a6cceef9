import pytest
from conftest import day
from pyspark.errors import PySparkException

from panelforge.operators import splits


def dated(spark, n, entities=("AA", "BB")):
    return spark.createDataFrame([(day(i), e, float(i)) for i in range(n) for e in entities], "target_date date, respondent string, v double")


def by_split(df):
    return {r["split"]: (r["rows"], r["first_date"], r["last_date"]) for r in splits.split_profile(df).collect()}


@pytest.mark.parametrize("n", [10, 20, 90, 100])
def test_cuts_truncate_doubles(spark, n):
    out = splits.split_time_series(dated(spark, n))
    a, b = int(n * 0.70), int(n * (0.70 + 0.15))
    assert by_split(out) == {
        "train": (2 * a, day(0), day(a - 1)), "val": (2 * (b - a), day(a), day(b - 1)), "test": (2 * (n - b), day(b), day(n - 1)),
    }
    assert splits.split_is_clean(out).first()["clean"]
    assert splits.train_and_validation(out).filter("split = 'test'").count() == 0


def test_too_few_dates(spark):
    # A failure inside a scalar subquery arrives as the JVM error it caused.
    with pytest.raises(Exception, match="not enough dates"):
        splits.split_time_series(dated(spark, 9)).collect()
    with pytest.raises(PySparkException, match="not enough dates"):
        splits.split_dates(dated(spark, 0)).collect()


def test_folds_grow_and_cover_the_rest(spark):
    folds = splits.walk_forward_folds(dated(spark, 23)).orderBy("fold").collect()
    assert [tuple(f) for f in folds] == [
        (0, day(10), day(11), day(14)), (1, day(14), day(15), day(18)), (2, day(18), day(19), day(22)),
    ]
    rows = splits.assign_folds(dated(spark, 23))
    counts = {(r["fold"], r["role"]): r["count"] for r in rows.groupBy("fold", "role").count().collect()}
    assert counts == {(0, "train"): 22, (0, "val"): 8, (1, "train"): 30, (1, "val"): 8, (2, "train"): 38, (2, "val"): 8}
    assert rows.columns == ["target_date", "respondent", "v", "fold", "role"]


@pytest.mark.parametrize("n, k, text", [(0, 3, "empty"), (5, 3, "not enough dates"), (8, 5, "left for folds")])
def test_fold_errors(spark, n, k, text):
    with pytest.raises(PySparkException, match=text):
        splits.walk_forward_folds(dated(spark, n), n_splits=k).collect()


def test_nearest_quantile_cuts(spark):
    out = splits.split_nearest_quantile(dated(spark, 12), column="target_date")
    # places 7.7 and 9.35 round to 8 and 9
    assert {s: v[2] for s, v in by_split(out).items()} == {"train": day(8), "val": day(9), "test": day(11)}


def test_monitoring_windows(spark):
    out = splits.monitoring_windows(dated(spark, 120), 60, 20)
    got = {r["window"]: (r["n"], r["a"], r["b"]) for r in out.groupBy("window").agg(
        {"v": "count"}).withColumnRenamed("count(v)", "n").join(
        out.groupBy("window").agg({"target_date": "min"}).withColumnRenamed("min(target_date)", "a"), "window").join(
        out.groupBy("window").agg({"target_date": "max"}).withColumnRenamed("max(target_date)", "b"), "window").collect()}
    assert got == {"reference": (120, day(39), day(98)), "current": (42, day(99), day(119))}


def test_monitoring_window_errors(spark):
    with pytest.raises(Exception, match="not enough dates"):
        splits.monitoring_windows(dated(spark, 20), 90, 30).collect()
    with pytest.raises(Exception, match="reference window is empty"):
        splits.monitoring_windows(dated(spark, 11), 0, 30).collect()
