import numpy as np
import pandas as pd
import pytest
from conftest import PANEL_SCHEMA, day, panel_rows
from pyspark.sql import functions as F

from panelforge import schema
from panelforge.operators import features, panel


def test_reindex_fills_each_entity_between_its_own_ends(spark):
    rows = [(day(0), "AA", 1.0, None, None, None), (day(3), "AA", 4.0, None, None, None), (day(2), "BB", 9.0, None, None, None)]
    out = panel.reindex_daily(spark.createDataFrame(rows, PANEL_SCHEMA))
    got = {(r["respondent"], r["period"]): r["demand"] for r in out.collect()}
    assert got == {("AA", day(0)): 1.0, ("AA", day(1)): None, ("AA", day(2)): None, ("AA", day(3)): 4.0, ("BB", day(2)): 9.0}


def test_reindex_count_is_the_sum_of_spans(small_panel):
    spans = small_panel.groupBy("respondent").agg((F.datediff(F.max("period"), F.min("period")) + 1).alias("n"))
    assert panel.reindex_daily(small_panel).count() == spans.agg(F.sum("n")).first()[0]


def test_lag_is_missing_across_a_gap(spark, tier_map):
    rows = [(day(0), "AA", 1.0, 2.0, 3.0, 4.0), (day(2), "AA", 5.0, 6.0, 7.0, 8.0), (day(3), "AA", 6.0, 6.0, 7.0, 8.0)]
    out = features.build_features(spark.createDataFrame(rows, PANEL_SCHEMA), tier_map)
    got = {r["forecast_date"]: r for r in out.collect()}
    # Day 0 has no known next day; the gap day itself is kept because its next day is known.
    assert set(got) == {day(1), day(2)}
    assert got[day(1)]["naive_persistence"] is None and got[day(1)]["target"] == 5.0
    assert got[day(2)]["demand_lag_1"] is None and got[day(2)]["demand_lag_2"] == 1.0
    assert got[day(2)]["benchmark_forecast"] == 6.0


def test_features_agree_with_pandas(small_panel, tier_map):
    got = features.build_features(small_panel, tier_map, drop_na_target=False).toPandas()
    source = small_panel.toPandas()
    assert len(got) == sum((g.period.max() - g.period.min()).days + 1 for _, g in source.groupby("respondent"))
    for entity, group in source.groupby("respondent"):
        s = group.set_index(pd.to_datetime(group.period)).sort_index()
        s = s.reindex(pd.date_range(s.index.min(), s.index.max()))
        mine = got[got.respondent == entity].sort_values("forecast_date")
        d = s.demand
        expected = {
            "target": d.shift(-1), "benchmark_forecast": s.demand_forecast.shift(-1), "naive_persistence": d, "demand_t": d,
            "net_generation_t": s.net_generation, "net_generation_lag_7": s.net_generation.shift(7),
            "interchange_lag_1": s.interchange.shift(1),
            **{f"demand_lag_{k}": d.shift(k) for k in (1, 2, 6, 7, 13, 14, 364)},
            **{f"demand_rolling_mean_{k}": d.rolling(k, min_periods=m).mean() for k, m in ((7, 4), (14, 7), (30, 15))},
            **{f"demand_rolling_std_{k}": d.rolling(k, min_periods=m).std() for k, m in ((7, 4), (30, 15))},
            **{
                f"demand_trend_{k}": d.rolling(k).apply(lambda v: np.polyfit(np.arange(len(v)), v, 1)[0], raw=True)
                for k in (7, 30)
            },
        }
        for name, want in expected.items():
            np.testing.assert_allclose(
                mine[name].astype(float).to_numpy(), want.to_numpy(dtype=float), rtol=1e-9, atol=1e-7, err_msg=f"{entity} {name}"
            )


def test_no_feature_looks_ahead(small_panel, tier_map):
    cut = day(60)
    altered = small_panel.withColumns(
        {c: F.when(F.col("period") > cut, F.col(c) * 7 + 1).otherwise(F.col(c)) for c in schema.SERIES.values()}
    )
    names = ["respondent", "forecast_date", *schema.NUMERIC_FEATURES]

    def upto(df):
        out = features.build_features(df, tier_map, drop_na_target=False)
        return out.filter(F.col("forecast_date") <= cut).select(*names)

    assert upto(small_panel).exceptAll(upto(altered)).count() == 0


def test_column_contract(small_panel, tier_map):
    out = features.build_features(small_panel, tier_map)
    assert out.columns == schema.METADATA_COLUMNS + schema.NUMERIC_FEATURES
    assert len(schema.FEATURE_COLUMNS) == 34 and len(schema.NUMERIC_FEATURES) == 33
    assert out.filter("target is null").count() == 0
    for leaked in ("target", "benchmark_forecast"):
        with pytest.raises(ValueError):
            schema.check_feature_contract(["demand_t", leaked])


def test_missing_series_become_null_columns(small_panel, tier_map):
    out = features.build_features(small_panel.select("period", "respondent", "demand"), tier_map)
    row = out.first()
    assert row["benchmark_forecast"] is None and row["net_generation_t"] is None and row["target"] is not None


def test_tiers(spark, small_panel, tier_map):
    entities = small_panel.select("respondent").distinct()
    want = {"AA": "Large", "AB": "Large", "BA": "Medium", "CA": "Small", "ZZ": "Unknown"}
    assert {r[0]: r["tier"] for r in features.assign_tier(entities, tier_map).collect()} == want
    table = spark.createDataFrame([(e, t) for t, es in tier_map.items() for e in es], "respondent string, tier string")
    assert {r[0]: r["tier"] for r in features.assign_tier(entities, table).collect()} == want
    codes = spark.createDataFrame([("PJM",), ("TVA",), ("WALC",), ("XX",)], "respondent string")
    assert [r["tier"] for r in features.assign_tier(codes).collect()] == ["Large", "Medium", "Small", "Unknown"]
    assert [len(v) for v in schema.TIERS.values()] == [6, 25, 21]
    by_size = features.tier_by_threshold(small_panel, 5000, 500)
    assert {r["respondent"]: r["tier"] for r in by_size.collect()} == {**want, "ZZ": "Small"}


def test_one_shuffle_for_all_feature_columns(small_panel, tier_map):
    plan = features.build_features(small_panel, tier_map)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_stored_features(spark, small_panel, tier_map, tmp_path):
    from panelforge.sources import sinks

    out = features.build_features(small_panel, tier_map)
    sinks.write_features(out, str(tmp_path / "features"))
    large = sinks.read_features(spark, str(tmp_path / "features"), "Large")
    assert large.count() == out.filter("tier = 'Large'").count()
    assert "PartitionFilters: [isnotnull(tier" in large._jdf.queryExecution().executedPlan().toString()


def test_panel_rows_helper_covers_all_days():
    assert len(panel_rows({"A": 1.0}, 5, {("A", 2)})) == 4
