import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.gamma import chi_square_p_value, log_gamma
from panelforge.operators import distribution, drift, sketches
from panelforge.session import cut_lineage

COLUMNS = ["a", "b", "c", "none"]


@pytest.fixture(scope="module")
def table(spark):
    """Two windows of ten days: a smooth column, one with a value on a third of all rows, one with NaN and few values, one empty."""
    rng = F.rand(7)
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "current").otherwise("reference").alias("window"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("day"),
        (F.randn(1) + F.when(F.col("id") % 3 == 0, 0.3).otherwise(0.0)).alias("a"),
        F.when(rng < 0.33, 7.0).otherwise(rng * 1000).alias("b"),
        F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") % 5).cast("double")).alias("c"),
        F.lit(None).cast("double").alias("none"),
    )
    return cut_lineage(df)


def test_profile_of_stored_and_merged_sketches(spark, table, tmp_path):
    by_day = sketches.column_sketches(table, COLUMNS, ["window", "day"])
    sketches.write_sketches(by_day, str(tmp_path / "s"), "day")
    # A day written again replaces itself.
    sketches.write_sketches(sketches.column_sketches(table.filter("day = '2024-01-03'"), COLUMNS, ["window", "day"]), str(tmp_path / "s"), "day")
    stored = sketches.read_sketches(spark, str(tmp_path / "s"), "day")
    got = {r["feature"]: r for r in sketches.sketched_profile(sketches.merge_sketches(stored, [])).collect()}
    exact = {r["feature"]: r for r in drift.quality_profile(table, COLUMNS).collect()}
    counts = {r["feature"]: r for r in distribution.exact_quantiles(table, ["a", "b", "c"], {"q": 0.5}).collect()}
    for name in COLUMNS:
        g, e = got[name], exact[name]
        assert (g["rows"], g["missing"]) == (e["rows"], e["missing"])
        for field in ("mean", "std", "min", "max"):
            assert g[field] == (pytest.approx(e[field], rel=1e-9) if e[field] is not None else None), (name, field)
        if name != "none":
            assert g["distinct"] == pytest.approx(e["distinct"], rel=0.05)
            values = np.sort([r[0] for r in table.filter(F.col(name).isNotNull() & ~F.isnan(name)).select(name).collect()])
            for field, rank in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
                low, high = (np.searchsorted(values, g[field], side) / len(values) for side in ("left", "right"))
                assert low - 3 * g["rank_error"] <= rank <= high + 3 * g["rank_error"]
    assert counts["c"]["q"] == got["c"]["q50"] and got["none"]["q50"] is None
    one_day = sketches.read_sketches(spark, str(tmp_path / "s"), "day", "2024-01-03", "2024-01-04")
    assert sorted(str(r[0]) for r in one_day.select("day").distinct().collect()) == ["2024-01-03", "2024-01-04"]
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_drift_from_sketches_within_its_bound(table):
    got = {r["feature"]: r for r in sketches.sketched_drift(sketches.column_sketches(table, COLUMNS, ["window"])).collect()}
    exact = {r["feature"]: r for r in drift.numeric_drift(table, COLUMNS).collect()}
    width = {"a": 12.0, "b": 1000.0, "c": 4.0}
    for name in ("a", "b", "c"):
        g, e = got[name], exact[name]
        assert (g["n_reference"], g["n_current"], g["ks_drifted"]) == (e["n_reference"], e["n_current"], e["ks_drifted"])
        assert abs(g["ks_statistic"] - e["ks_statistic"]) <= g["ks_error"] < 0.01
        assert abs(g["wasserstein"] - e["wasserstein"]) <= g["ks_error"] * width[name]
    assert got["a"]["drifted"] and got["none"]["ks_statistic"] is None and not got["none"]["drifted"]
    with pytest.raises(ValueError):
        sketches.sketched_drift(table, method="other")


def test_only_sketches_are_shuffled(table):
    plan = sketches.column_sketches(table, ["a", "b"], ["window"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_kll" in plan.lower()


def test_log_gamma(spark):
    z = [1e-3, 0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 12_345.5]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", log_gamma(F.col("z")).alias("g")).collect()
    for r in got:
        assert r["g"] == pytest.approx(math.lgamma(r["z"]), rel=1e-12, abs=1e-12)


def plain_tail(x, k):
    """Chi-square tail by its finite sums: even degrees a Poisson sum, odd ones from the normal tail."""
    if k % 2 == 0:
        return sum(math.exp(-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1)) for i in range(k // 2)) if x else 1.0
    total = math.erfc(math.sqrt(x / 2))
    return total + sum(math.exp(-x / 2 + (i - 0.5) * math.log(x / 2) - math.lgamma(i + 0.5)) for i in range(1, (k + 1) // 2))


def test_chi_square_p_values(spark):
    cases = [(x, k) for k in (1, 2, 3, 10, 25, 99, 1000, 20_001) for x in (0.01, 0.5 * k, 0.97 * k, 1.0 * k, 1.05 * k, 1.5 * k, 3.0 * k)]
    df = spark.createDataFrame([(float(x), k) for x, k in cases] + [(0.0, 5), (1.0, 0)], "x double, k long")
    for r in df.withColumn("p", chi_square_p_value(F.col("x"), F.col("k"))).collect():
        want = None if r["k"] == 0 else plain_tail(r["x"], r["k"]) if r["x"] else 1.0
        assert r["p"] == (want if want is None else pytest.approx(want, abs=1e-9)), r
