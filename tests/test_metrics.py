import math

import numpy as np
import pytest

from panelforge.operators import lookup, metrics, scoring

SCHEMA = "tier string, respondent string, target double, prediction double, naive_persistence double, benchmark_forecast double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(df):
    return {r["tier"]: r for r in df.collect()}


def test_metric_values(spark):
    rng = np.random.default_rng(3)
    y, p = rng.uniform(50, 150, 40), rng.uniform(50, 150, 40)
    rows = [("Large" if i < 25 else "Small", "A", float(y[i]), float(p[i]), 1.0, 1.0) for i in range(40)]
    rows += [("Large", "A", None, 5.0, 1.0, 1.0), ("Small", "A", 5.0, None, 1.0, 1.0), ("Small", "A", float("nan"), 5.0, 1.0, 1.0)]
    got = table(metrics.evaluate(frame(spark, rows), "prediction", rounded=False))
    for tier, part in (("Large", slice(0, 25)), ("Small", slice(25, 40)), ("Overall", slice(0, 40))):
        a, b, r = y[part], p[part], got[tier]
        assert r["n_samples"] == len(a)
        assert math.isclose(r["mae"], np.mean(np.abs(a - b)))
        assert math.isclose(r["smape"], np.mean(200 * np.abs(a - b) / (np.abs(a) + np.abs(b))), rel_tol=1e-9)
        assert math.isclose(r["wmape"], 100 * np.sum(np.abs(a - b)) / np.sum(np.abs(a)), rel_tol=1e-9)
        assert math.isclose(r["r2"], 1 - np.sum((a - b) ** 2) / np.sum((a - a.mean()) ** 2), rel_tol=1e-9)


def test_metric_edges(spark):
    rows = [
        ("None", "A", None, 1.0, 1.0, 1.0), ("One", "A", 4.0, 5.0, 1.0, 1.0), ("Flat", "A", 3.0, 3.0, 1.0, 1.0),
        ("Flat", "B", 3.0, 3.0, 1.0, 1.0), ("FlatBad", "A", 3.0, 4.0, 1.0, 1.0), ("FlatBad", "B", 3.0, 3.0, 1.0, 1.0),
        (None, "A", 10.0, 10.0, 1.0, 1.0),
    ]
    got = table(metrics.evaluate(frame(spark, rows), "prediction"))
    assert (got["None"]["n_samples"], got["None"]["mae"], got["None"]["r2"]) == (0, None, None)
    assert got["One"]["r2"] == 0.0 and got["Flat"]["r2"] == 1.0 and got["FlatBad"]["r2"] == 0.0
    assert got["Overall"]["n_samples"] == 6 and set(got) == {"None", "One", "Flat", "FlatBad", "Overall"}
    negative = frame(spark, [("T", "A", -10.0, -8.0, 0.0, 0.0), ("T", "A", 10.0, 8.0, 0.0, 0.0)])
    assert table(metrics.evaluate(negative, "prediction"))["T"]["wmape"] == 20.0


def test_comparison_log_rows_and_delta(spark):
    df = frame(spark, [("Large", "A", 10.0, 11.0, 12.0, None), ("Large", "B", 20.0, 22.0, 20.0, 18.0)])
    out = metrics.compare_predictions(df, {"model": "prediction", "naive": "naive_persistence", "benchmark": "benchmark_forecast"})
    n = {(r["approach"], r["tier"]): r["n_samples"] for r in out.collect()}
    assert n[("model", "Overall")] == 2 and n[("benchmark", "Large")] == 1 and len(n) == 6
    logged = {r["name"]: r["value"] for r in metrics.flatten_metrics({"model_": out.filter("approach = 'model'")}).collect()}
    assert logged["model_large_mae"] == 1.5 and logged["model_overall_n_samples"] == 2.0 and len(logged) == 10
    model, naive = (out.filter(f"approach = '{a}'") for a in ("model", "naive"))
    delta = {r["tier"]: r["delta_wmape"] for r in metrics.delta_report(naive, model).collect()}
    assert math.isclose(delta["Large"], 10.0 - 6.67)
    fallback = spark.createDataFrame([("Large", "B")], "tier string, respondent string")
    summary = metrics.evaluation_summary(df.selectExpr("*", "date'2024-01-01' target_date"), out, fallback)
    assert summary.filter("section = 'test_period'").count() == 3
    assert summary.filter("section = 'fallback' and name = 'B'").count() == 1


@pytest.mark.parametrize(
    "candidate, live, promote, regressions",
    [
        ({"Large": 5.0, "Overall": 6.0}, {"Large": 5.5, "Overall": 6.5}, True, ""),
        ({"Large": 7.5, "Overall": 6.0}, {"Large": 5.0, "Overall": 6.0}, False, "Large"),
        ({"Large": 7.0}, {"Large": 5.0}, True, ""),
        ({"Large": 9.0, "Small": None}, {"Small": 1.0, "Medium": 2.0}, True, ""),
        ({"Large": 9.0}, None, True, ""),
    ],
)
def test_promotion_gate(spark, candidate, live, promote, regressions):
    def make(d):
        return spark.createDataFrame(list(d.items()), "tier string, wmape double")

    row = metrics.promotion_gate(make(candidate), None if live is None else make(live)).first()
    assert (row["promote"], row["regressions"]) == (promote, regressions)


def test_guardrail_and_fallback(spark):
    rows = [
        ("Small", "BAD", 10.0, 20.0, 11.0, 1.0), ("Small", "GOOD", 10.0, 10.5, 15.0, 1.0), ("Small", "TIE", 10.0, 12.0, 8.0, 1.0),
        ("Small", "NONE", 10.0, None, 8.0, 1.0), ("Small", "BAD", 10.0, 11.0, None, 1.0),
    ]
    df = frame(spark, rows)
    guard = {r["respondent"]: r["fallback"] for r in scoring.guardrail(df, "prediction").collect()}
    assert guard == {"BAD": True, "GOOD": False, "TIE": False}
    out = scoring.apply_fallback(df, scoring.fallback_entities(df, "prediction"), "prediction")
    got = sorted((r["respondent"], r["prediction"]) for r in out.filter("respondent <> 'NONE'").collect() if r["prediction"] is not None)
    assert got == [("BAD", 11.0), ("GOOD", 10.5), ("TIE", 12.0)]
    assert out.filter("respondent = 'BAD' and prediction is null").count() == 1
    assert out.columns == df.columns


def test_baselines(spark):
    df = frame(spark, [("T", "A", 1.0, 2.0, 3.0, 4.0)])
    assert scoring.naive_forecast(df).first()["prediction"] == 3.0
    assert scoring.benchmark_forecast(df).first()["prediction"] == 4.0
    assert scoring.naive_column(df.drop("naive_persistence").selectExpr("*", "1.0 demand_t")) == "demand_t"
    with pytest.raises(KeyError):
        scoring.naive_column(df.select("tier"))
    with pytest.raises(KeyError):
        scoring.benchmark_forecast(df.select("tier"))


def test_win_rate(spark):
    df = frame(spark, [("L", "A", 10.0, 11.0, 13.0, 0.0), ("L", "B", 10.0, 15.0, 12.0, 0.0), ("S", "C", 10.0, 10.0, 12.0, 0.0)])
    got = {r["tier"]: (r["wins"], r["entities"], r["win_pct"]) for r in metrics.win_rate(df, "prediction").collect()}
    assert got == {"L": (1, 2, 50.0), "S": (1, 1, 100.0), "Overall": (2, 3, 66.67)}


# ------------------------------------------------------------------ lookups

LOOKUP_SCHEMA = (
    "respondent string, tier string, forecast_date date, target_date date, target double, prediction double,"
    " naive_persistence double, benchmark_forecast double"
)


@pytest.fixture(scope="module")
def stored(spark):
    from conftest import day

    rows = [("AA", "Large", day(n), day(n + 1), 100.0 + n, 101.0 + n, 98.26 + n, None) for n in range(10)]
    rows += [("BB", "Small", day(n), day(n + 1), [0.0, None, 10.0][n], 5.0, [1.0, 1.0, 0.0][n], 9.0) for n in range(3)]
    return spark.createDataFrame(rows, LOOKUP_SCHEMA)


def test_history(spark, stored):
    asked = spark.createDataFrame([("aa",), ("zz",)], "respondent string")
    rows = lookup.history(stored, asked, 3).orderBy("target_date").collect()
    assert [r["actual_demand"] for r in rows] == [107.0, 108.0, 109.0]
    assert rows[0]["naive_persistence"] == 105.3 and rows[0]["benchmark_forecast"] is None


def test_lookup_and_scored_response(spark, stored):
    from conftest import day

    asked = spark.createDataFrame(
        [("aa", None), ("AA", day(3)), ("AA", day(99)), ("ZZ", None), ("BB", day(1)), ("BB", day(2)), ("BB", day(3))],
        "respondent string, target_date date",
    )
    rows = lookup.lookup_rows(stored, asked)
    found = {(r["respondent"], r["requested_date"]): (r["found"], r["target"]) for r in rows.collect()}
    assert found[("AA", None)] == (True, 109.0) and found[("AA", day(3))] == (True, 102.0)
    assert found[("AA", day(99))] == (False, None) and found[("ZZ", None)] == (False, None)
    out = {(r["respondent"], r["target_date"]): r for r in lookup.scored_response(rows.filter("found"), "prediction").collect()}
    a = out[("AA", day(3))]
    assert (a["model_abs_error"], a["model_error_pct"], a["beats_naive"], a["beats_benchmark"]) == (1.0, 0.98, True, None)
    zero, unknown, no_naive = out[("BB", day(1))], out[("BB", day(2))], out[("BB", day(3))]
    assert (zero["model_abs_error"], zero["model_error_pct"], zero["beats_naive"]) == (5.0, None, None)
    assert (unknown["model_abs_error"], unknown["beats_naive"], unknown["actual_demand"]) == (None, None, None)
    assert (no_naive["beats_naive"], no_naive["beats_benchmark"], no_naive["naive_error_pct"]) == (None, False, 100.0)


def test_entities_by_tier(spark):
    tiers = spark.createDataFrame([("A", "Large"), ("B", "Small"), ("C", "Small")], "respondent string, tier string")
    got = sorted(tuple(r) for r in lookup.entities_by_tier(tiers).collect())
    assert got == [("Large", "A", 1, 3), ("Small", "B", 2, 3), ("Small", "C", 2, 3)]
