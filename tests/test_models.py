import pytest
from conftest import PANEL_SCHEMA, panel_rows
from pyspark.sql import functions as F

from panelforge.operators import features, metrics, models, scoring, splits
from panelforge.session import cut_lineage

FAST = {"maxIter": 3, "maxDepth": 3, "minInstancesPerNode": 2}
USED = ["demand_t", "demand_lag_1", "demand_lag_7", "demand_rolling_mean_7", "demand_trend_7", "target_dayofweek"]


@pytest.fixture(scope="module")
def fitted(spark, tier_map):
    rows = panel_rows({"AA": 9000.0, "AB": 7000.0, "BA": 900.0, "CA": 90.0, "ZZ": 5.0}, 90, {("BA", 20), ("CA", 40)})
    table = features.build_features(spark.createDataFrame(rows, PANEL_SCHEMA), tier_map)
    df = cut_lineage(splits.split_time_series(table, 0.6, 0.2))
    train, val = df.filter("split = 'train'"), df.filter("split = 'val'")
    return df, models.train_all_tiers(train, val, params=FAST, features=USED, params_by_tier={"Small": {"maxDepth": 2}})


def test_every_tier_is_fitted_and_scored(fitted):
    df, tiers = fitted
    assert list(tiers) == ["Large", "Medium", "Small"] and all(m.trees >= 1 for m in tiers.values())
    scored = models.predict_with_tier_models(df.filter("split = 'test'"), tiers)
    assert scored.count() == df.filter("split = 'test'").count()
    assert scored.filter("tier = 'Unknown' and model_prediction is not null").count() == 0
    assert scored.filter("tier <> 'Unknown' and model_prediction is null and naive_persistence is not null").count() == 0
    table = {r["tier"]: r for r in metrics.evaluate(scored, "model_prediction").collect()}
    assert table["Unknown"]["n_samples"] == 0 and table["Overall"]["n_samples"] > 0
    assert table["Large"]["mae"] < 3000


def test_fallback_replaces_the_entities_that_lost(fitted):
    df, tiers = fitted
    model = tiers["Large"]
    val = df.filter("split = 'val' and tier = 'Large'")
    raw = models.predict(val, model, "raw", enable_fallback=False)
    want = {r["respondent"] for r in scoring.fallback_entities(raw, "raw").collect()}
    assert {r["respondent"] for r in models.fallback_of(model).collect()} == want
    forced = models.TierModel(
        model.tier, model.regressor, model.scale, model.features,
        model.entities.withColumn("fallback", F.col("respondent") == "AA"),
    )
    out = models.predict(df.filter("tier = 'Large'"), forced)
    assert out.filter("respondent = 'AA' and not (model_prediction <=> naive_persistence)").count() == 0
    assert out.filter("respondent = 'AB' and model_prediction = naive_persistence").count() < out.filter("respondent = 'AB'").count()


def test_save_and_load(spark, fitted, tmp_path):
    df, tiers = fitted
    models.save_model(tiers["Medium"], str(tmp_path / "medium"))
    again = models.load_model(spark, str(tmp_path / "medium"))
    rows = df.filter("tier = 'Medium'")
    left = models.predict(rows, tiers["Medium"]).select("target_date", "model_prediction")
    assert left.exceptAll(models.predict(rows, again).select("target_date", "model_prediction")).count() == 0
    assert again.features == USED


def test_missing_rows_are_errors(fitted):
    df, _ = fitted
    train, val = df.filter("split = 'train'"), df.filter("split = 'val'")
    with pytest.raises(ValueError, match="no training rows"):
        models.fit_tier(train, val, "Huge", FAST, USED)
    with pytest.raises(ValueError, match="no validation rows"):
        models.fit_tier(train, val.limit(0), "Large", FAST, USED)
    with pytest.raises(ValueError):
        models.fit_tier(train, val, "Large", FAST, ["demand_t", "target"])


def test_next_day_rows(spark, small_panel, tier_map, fitted):
    table = features.build_features(small_panel, tier_map, drop_na_target=False)
    latest = models.latest_rows(table)
    assert latest.count() == 5 and latest.filter("target is not null").count() == 0
    out = models.predict_with_tier_models(latest, fitted[1])
    assert out.filter("tier <> 'Unknown' and model_prediction is null").count() == 0


def test_search(spark, fitted, tmp_path):
    df, _ = fitted
    pool = splits.train_and_validation(df)
    candidates = models.random_candidates(2, seed=7, maxIter=2, maxDepth=2)
    assert candidates == models.random_candidates(2, seed=7, maxIter=2, maxDepth=2)
    trials = models.walk_forward_search(pool, "Medium", candidates, n_splits=2, features=USED)
    rows = trials.orderBy("trial").collect()
    assert [r["folds"] for r in rows] == [2, 2] and all(r["wmape"] > 0 for r in rows)
    best = models.best_params(trials)
    assert best.first()["wmape"] == min(r["wmape"] for r in rows)
    models.save_params(best, str(tmp_path / "best"))
    assert models.load_params(spark, str(tmp_path / "best"))["Medium"]["maxIter"] == 2
    assert models.load_params(spark, str(tmp_path / "none")) == {}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("not json")
    assert models.load_params(spark, str(tmp_path / "bad")) == {}
    with pytest.raises(ValueError, match="no rows"):
        models.walk_forward_search(pool, "Huge", candidates)
