import math

import numpy as np
import pytest
from conftest import day

from panelforge.operators import distribution, drift, explore
from panelforge.sources import sinks


def windowed(spark, reference, current, schema="window string, x double"):
    rows = [("reference", None if v is None else float(v)) for v in reference]
    rows += [("current", None if v is None else float(v)) for v in current]
    return spark.createDataFrame(rows, schema)


def slow_ks_and_w1(a, b):
    grid = np.sort(np.unique(np.concatenate([a, b])))
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    return np.max(np.abs(fa - fb)), np.sum(np.abs(fa - fb)[:-1] * np.diff(grid))


@pytest.mark.parametrize("buckets", [1, 2, 7, 256])
def test_statistics_do_not_depend_on_the_buckets(spark, buckets):
    rng = np.random.default_rng(11)
    # A third of all values are equal, and one outlier stretches the range.
    a = np.concatenate([rng.normal(0, 1, 300), np.zeros(200), [1e9]])
    b = np.concatenate([rng.normal(0.4, 2, 250), np.zeros(150), [None] * 5]).astype(object)
    row = drift.numeric_drift(windowed(spark, a, b), ["x"], buckets=buckets).first()
    clean = np.array([v for v in b if v is not None], dtype=float)
    d, w = slow_ks_and_w1(a, clean)
    assert math.isclose(row["ks_statistic"], d, rel_tol=1e-12)
    assert math.isclose(row["wasserstein"], w, rel_tol=1e-9)
    assert (row["n_reference"], row["n_current"], row["method"]) == (501, 400, "ks")


def test_p_values(spark):
    same = drift.numeric_drift(windowed(spark, range(200), range(200)), ["x"]).first()
    assert (same["ks_statistic"], same["p_value"], same["drifted"]) == (0.0, 1.0, False)
    moved = drift.numeric_drift(windowed(spark, range(200), range(150, 350)), ["x"]).first()
    assert moved["p_value"] < 1e-6 and moved["drifted"]
    # Kolmogorov distribution: P(K > 1.3581) = 0.05
    n = 400
    x = 1.3581 / (math.sqrt(n / 2) + 0.12 + 0.11 / math.sqrt(n / 2))
    series = 2 * sum((-1) ** (j - 1) * math.exp(-2 * (j * 1.3581) ** 2) for j in range(1, 20))
    assert math.isclose(series, 0.05, abs_tol=1e-3) and 0 < x < 1


def test_repeated_rows_change_no_method(spark):
    rng = np.random.default_rng(5)
    few, moved = list(rng.normal(0, 10, 150)), list(rng.normal(5, 10, 90))
    for method in ("wasserstein", "ks"):
        once = drift.numeric_drift(windowed(spark, few, moved), ["x"], method=method).first()
        often = drift.numeric_drift(windowed(spark, few * 10, moved * 10), ["x"], method=method).first()
        assert once["method"] == often["method"] == method
        assert math.isclose(once["wasserstein_norm"], often["wasserstein_norm"], rel_tol=1e-9)
        assert once["distance_drifted"] and often["distance_drifted"] and often["drifted"]
        assert once["drifted"] == once["ks_drifted" if method == "ks" else "distance_drifted"]
    with pytest.raises(ValueError):
        drift.numeric_drift(windowed(spark, few, moved), ["x"], method="other")


def test_one_window_without_values(spark):
    row = drift.numeric_drift(windowed(spark, [None, None], [1, 2, 3]), ["x"]).first()
    assert row["n_reference"] == 0 and not row["drifted"]


def test_categories(spark):
    rows = [("reference", "a")] * 60 + [("reference", "b")] * 40 + [("current", "a")] * 10 + [("current", "c")] * 40
    row = drift.categorical_drift(spark.createDataFrame(rows, "window string, k string"), ["k"]).first()
    p, q = np.array([0.6, 0.4, 0]), np.array([0.2, 0, 0.8])
    m = (p + q) / 2
    js = sum(v * math.log2(v / m[i]) / 2 for s in (p, q) for i, v in enumerate(s) if v)
    assert math.isclose(row["js_distance"], math.sqrt(js), rel_tol=1e-12) and row["drifted"]
    observed = np.array([[60, 40, 0], [10, 0, 40]], dtype=float)
    expected = observed.sum(1, keepdims=True) * observed.sum(0) / observed.sum()
    assert math.isclose(row["chi_square"], ((observed - expected) ** 2 / expected).sum(), rel_tol=1e-12)


FRAME = "window string, target_date date, respondent string, target double, prediction double, demand_lag_1 double, is_holiday int"


def monitor_rows(shock=1.0):
    rng = np.random.default_rng(42)
    rows = []
    for n in range(120):
        for e in ("A", "B"):
            v = 1000 + rng.normal(0, 50)
            k = shock if n >= 90 else 1.0
            rows.append(("current" if n >= 90 else "reference", day(n), e, v, v + 10, v * k, int(n % 30 == 0)))
    return rows


def test_summary_and_shocked_feature(spark, tmp_path):
    columns = drift.drift_columns(spark.createDataFrame(monitor_rows(), FRAME))
    assert columns == ["respondent", "demand_lag_1", "is_holiday", "target", "prediction"]
    calm = drift.drift_summary(spark.createDataFrame(monitor_rows(), FRAME), columns, prediction="prediction").first()
    assert (calm["reference_start_date"], calm["current_end_date"]) == (day(0), day(119))
    assert calm["total_features_evaluated"] == 5 and not calm["dataset_drift_detected"]
    assert math.isclose(calm["wmape_reference"], 1.0, abs_tol=0.1) and len(calm) == 12
    shocked = spark.createDataFrame(monitor_rows(50.0), FRAME)
    per_column = {r["feature"]: r["drifted"] for r in drift.column_drift(shocked, columns).collect()}
    assert per_column["demand_lag_1"] and not per_column["respondent"]
    share = drift.dataset_drift(drift.column_drift(shocked, columns), drift_share=0.2).first()
    assert share["drifted_features"] >= 1 and share["dataset_drift"]
    target = drift.target_drift(drift.column_drift(shocked, columns)).first()
    assert target["feature"] == "target" and not target["drifted"]
    sinks.save_summary(drift.drift_summary(shocked, columns), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first()["total_features_evaluated"] == 5
    without = drift.drift_summary(shocked.drop("prediction"), ["respondent", "demand_lag_1"]).first()
    assert without["wmape_current"] is None and without["target_drift_score"] == 0.0


def test_rows_without_the_first_column_are_left_out(spark):
    df = windowed(spark, [1, None], [2])
    assert drift.evaluation_rows(df, ["x"]).count() == 2


def test_regression_quality(spark):
    rows = [("reference", 10.0, 12.0), ("reference", 0.0, 1.0), ("current", 5.0, 4.0), ("current", None, 4.0)]
    got = {r["window"]: r for r in drift.regression_quality(spark.createDataFrame(rows, "window string, target double, prediction double")).collect()}
    r = got["reference"]
    assert (r["n_samples"], r["mean_error"], r["mae"], r["mape"], r["max_error"]) == (2, 1.5, 1.5, 20.0, 2.0)
    assert got["current"]["n_samples"] == 1 and got["current"]["mean_error"] == -1.0


def test_exact_quantiles_and_profile(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.lognormal(3, 2, 333), np.full(167, 7.0)])
    y = rng.integers(0, 5, 500).astype(float)
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, float("nan"))]
    df = spark.createDataFrame(rows, "x double, y double")
    for buckets in (1, 16):
        got = {r["feature"]: r for r in distribution.exact_quantiles(df, ["x", "y"], {"a": 0.1, "b": 0.5, "c": 0.999}, buckets).collect()}
        for name, values in (("x", x), ("y", y)):
            for field, q in (("a", 0.1), ("b", 0.5), ("c", 0.999)):
                assert math.isclose(got[name][field], np.quantile(values, q), rel_tol=1e-12)
    profile = {r["feature"]: r for r in drift.quality_profile(df, ["x", "y"]).collect()}
    assert (profile["x"]["rows"], profile["x"]["missing"], profile["x"]["distinct"]) == (501, 1, 334)
    assert math.isclose(profile["x"]["top_share"], 167 / 500) and math.isclose(profile["y"]["mean"], y.mean())
    stats = {r["feature"]: r for r in explore.describe(df, ["x", "y"]).collect()}
    assert math.isclose(stats["x"]["q75"], np.quantile(x, 0.75)) and stats["y"]["n"] == 500
    assert math.isclose(stats["x"]["std"], np.std(x, ddof=1), rel_tol=1e-12)


def test_column_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    got = {r["feature"]: r for r in explore.describe(df, ["x", "y"]).collect()}
    assert (got["x"]["n"], got["x"]["q50"], got["y"]["q50"]) == (0, None, 1.5)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(100, 20, 1000), 1)
    df = spark.createDataFrame([(float(a),) for a in v] + [(None,)], "demand double")
    got = explore.histogram(df, bins=20).orderBy("bin").collect()
    want, edges = np.histogram(v, bins=20)
    assert sum(r["n"] for r in got) == 1000 and len(got) == 20
    assert np.abs(np.array([r["n"] for r in got]) - want).sum() <= 4  # values on an edge may fall either side of it
    np.testing.assert_allclose([r["left_edge"] for r in got], edges[:-1])
    same = explore.histogram(spark.createDataFrame([(5.0,), (5.0,)], "demand double"), bins=4).orderBy("bin").collect()
    assert [r["n"] for r in same] == [0, 0, 2, 0] and same[0]["left_edge"] == 4.5


def test_seasonality_and_row_naive(spark, small_panel):
    out = explore.seasonality(small_panel, "dayofweek").toPandas()
    assert len(out) == 35 and np.allclose(out.groupby("respondent").relative.mean(), 1.0)
    p = small_panel.toPandas().sort_values(["respondent", "period"])
    naive = p.groupby("respondent").demand.shift(1)
    want = (np.abs(p.demand - naive) / p.demand * 100).mean()
    row = explore.naive_mape_by_row(small_panel).first()
    assert math.isclose(row["mape"], want, rel_tol=1e-9) and row["rows"] == len(p) - 5
    coverage = {r["respondent"]: r for r in explore.panel_coverage(small_panel).collect()}
    assert (coverage["BA"]["interior_gaps"], coverage["AA"]["coverage_pct"]) == (2, 100.0)
    ends = explore.both_ends(explore.demand_ranking(small_panel), "mean_demand", 2).collect()
    assert [(r["respondent"], r["end"]) for r in ends] == [("AA", "largest"), ("AB", "largest"), ("ZZ", "smallest"), ("CA", "smallest")]
    missing = {r["column"]: r["n_missing"] for r in explore.missing_by_column(small_panel, ["demand", "respondent"]).collect()}
    assert missing == {"demand": 0, "respondent": 0}
    assert ("demand", "double") in explore.column_types(small_panel)
    assert explore.benchmark_errors(small_panel).first()["rows"] == len(p)
    assert explore.first_rows(small_panel, "AA", 3).count() == 3
