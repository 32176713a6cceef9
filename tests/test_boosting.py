import numpy as np
import pytest
from conftest import PANEL_SCHEMA, panel_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.operators import boosting, features, models, splits
from panelforge.session import cut_lineage

INPUTS = ["x", "y"]


def rows(spark, n=3000, seed=3):
    """Part one: a target of small steps, many rounds pay at a small step size.  Part two: noise, none do."""
    draw = np.random.default_rng(seed)
    x, y = draw.random(n), draw.random(n)
    x[::17] = np.nan
    steps = np.where(np.isnan(x), 5.0, 10 * np.floor(x * 8)) + 3 * y + draw.normal(0, 0.05, n)
    data = [
        (part, int(i % 5 == 0), float(t), None if np.isnan(a) else float(a), float(b), f"e{i % 7}", float(t) + 1)
        for part, target in (("one", steps), ("two", draw.normal(10, 1, n)))
        for i, (t, a, b) in enumerate(zip(target, x, y))
    ]
    return spark.createDataFrame(data, "part string, stamp int, target double, x double, y double, entity string, naive double")


@pytest.fixture(scope="module")
def chunks(spark):
    df = cut_lineage(rows(spark))
    cuts = boosting.quantile_cuts(df.filter("stamp = 0"), INPUTS, "part")
    return df, cuts, boosting.chunked_rows(df, INPUTS, cuts, "part", F.col("stamp"), "target", "naive", "entity")


def booster(**over):
    return boosting.Booster(over.pop("part", "one"), 0, 1, 1, **{"step": 0.03, "min_rows": 5, "patience": 8, "depth": 3, "leaves": 8, **over})


def test_the_error_stops_the_rounds_and_fifty_are_too_few(chunks):
    _, _, table = chunks
    steps, noise = booster(), booster(part="two", step=0.2)
    boosting.boost(table, [steps, noise], len(INPUTS), 50)
    assert len(steps.trees) == 50 and not steps.stopped  # still falling
    assert noise.stopped and noise.waited() == noise.patience and len(noise.trees) == noise.best + noise.patience < 50
    at_50 = steps.errors[steps.best]
    boosting.boost(table, [steps, noise], len(INPUTS), 90)
    assert len(steps.errors) == len(steps.trees) + 1 == 91 and len(noise.trees) < 50
    assert steps.errors[steps.best] < 0.6 * at_50


def test_going_on_equals_going_through(chunks):
    _, _, table = chunks
    whole, parts = booster(), booster()
    boosting.boost(table, [whole], len(INPUTS), 14)
    for rounds in (1, 6, 14):
        boosting.boost(table, [parts], len(INPUTS), rounds)
    assert np.allclose(whole.errors, parts.errors) and [t.plain() for t in whole.trees] == [t.plain() for t in parts.trees]


def test_scores_equal_the_margins_and_survive_json(spark, chunks):
    df, cuts, table = chunks
    one = booster()
    boosting.boost(table, [one], len(INPUTS), 6)
    model = boosting.BoostedTrees.of(one, cuts)
    again = boosting.BoostedTrees.from_json(model.to_json())
    scored = df.withColumn("p", boosting.score_column({"one": again}, F.col("part"), [F.col(c) for c in INPUTS]))
    val = scored.filter("stamp = 1 and part = 'one'")
    error = val.agg(F.avg(F.abs(F.col("target") - F.col("p")))).first()[0]
    assert error == pytest.approx(one.errors[one.best])
    other = scored.filter("part = 'two'").withColumn("q", boosting.score_column({"one": model}, F.col("part"), [F.col(c) for c in INPUTS]))
    assert other.filter("q is not null").count() == 0
    # The naive value is off by one everywhere, and so few rounds are worse.
    truth = val.agg(F.sum(F.abs(F.col("target") - F.col("p"))), F.sum(F.abs("target")), F.count("*")).first()
    assert boosting.judged_wmape(table, [one])[0] == pytest.approx((100 * truth[2] / truth[1], 100 * truth[0] / truth[1]))


def test_first_leaf_is_the_median(chunks):
    df, _, table = chunks
    one = booster(depth=1, leaves=1)
    boosting.boost(table, [one], len(INPUTS), 1)
    df = df.filter("part = 'one'")
    exact = df.filter("stamp = 0").agg(F.expr("median(target)")).first()[0]
    spread = df.filter("stamp = 0").agg(F.expr("percentile(target, 0.51)")).first()[0] - exact
    assert abs(one.start - exact) <= abs(spread) + 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=40), st.integers(1, 5))
def test_weighted_median_of_whole_values(values, parts):
    pieces = [boosting.summary(np.array(p)) for p in np.array_split(values, parts) if len(p)]
    points = np.concatenate([p for p, _ in pieces])
    weights = np.concatenate([np.full(len(p), w) for p, w in pieces])
    assert boosting.weighted_median(points, weights) == pytest.approx(np.median(values))


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_best_split_against_trying_all(data):
    n = data.draw(st.integers(2, 40))
    bins = np.array([data.draw(st.lists(st.integers(0, 5), min_size=n, max_size=n)) for _ in range(2)])
    sign = np.array(data.draw(st.lists(st.sampled_from([-1, 0, 1]), min_size=n, max_size=n)))
    least, alpha, lam = data.draw(st.integers(1, 3)), data.draw(st.sampled_from([0.0, 1.5])), data.draw(st.sampled_from([0.0, 2.0]))
    signs, counts = (np.array([np.bincount(b, w, 6) for b in bins]) for w in (sign, None))

    def score(mask):
        return max(abs(sign[mask].sum()) - alpha, 0) ** 2 / (mask.sum() + lam)

    best = 0.0
    for f in range(2):
        for cut in range(1, 6):
            for missing_left in (True, False):
                left = np.where(bins[f] == 0, missing_left, bins[f] <= cut)
                if min(left.sum(), n - left.sum()) >= least:
                    best = max(best, score(left) + score(~left) - score(np.ones(n, bool)))
    got = boosting.best_split(signs, counts, least, alpha, lam)
    assert got[3] == pytest.approx(best) if best > 1e-9 else got[0] == -1


@pytest.fixture(scope="module")
def pool(spark, tier_map):
    panel = panel_rows({"AA": 9000.0, "AB": 7000.0, "BA": 900.0, "CA": 90.0}, 120)
    table = features.build_features(spark.createDataFrame(panel, PANEL_SCHEMA), tier_map)
    return cut_lineage(splits.train_and_validation(splits.split_time_series(table, 0.6, 0.2)))


USED = ["demand_t", "demand_lag_1", "demand_lag_7", "target_dayofweek"]


def test_halving_finds_the_winner_of_the_full_search(spark, pool):
    good = {"maxIter": 30, "stepSize": 0.15, "maxLeaves": 15, "maxDepth": 3, "minInstancesPerNode": 3, "patience": 10}
    candidates = [{**good, "stepSize": s} for s in (0.001, 0.002, 0.15, 0.004, 0.003, 0.0015)]
    full = models.walk_forward_search(pool, "Large", candidates, 3, USED).orderBy("trial").collect()
    halved = models.search_tiers(pool, ["Large", "Medium"], candidates, 3, USED).orderBy("tier", "trial").collect()
    assert [r["folds"] for r in full] == [3] * 6
    large = [r for r in halved if r["tier"] == "Large"]
    assert len(large) == 6 and min(full, key=lambda r: r["wmape"])["trial"] == 2
    finalists = [r for r in large if r["wmape"] is not None]
    assert [r["trial"] for r in finalists] == [2] and finalists[0]["folds"] == 3 and finalists[0]["rung"] == 3
    assert finalists[0]["wmape"] == pytest.approx(full[2]["wmape"])
    best = {r["tier"]: r["params"] for r in models.best_params(spark.createDataFrame(halved, models.TRIALS)).collect()}
    assert '"stepSize": 0.15' in best["Large"]


def test_rungs():
    assert models.halving_rungs(30, 3, 500) == [(30, 1, 19), (10, 2, 97), (4, 3, 500)]
    assert models.halving_rungs(1, 1, 10) == [(1, 1, 10)]


def test_no_row_knows_its_own_target(spark, pool):
    known = pool.filter("respondent = 'AA'").withColumn("level", models.ordered_level())
    got = known.orderBy("target_date").select("target", "level").collect()
    assert got[0]["level"] is None
    for i in range(1, len(got)):
        assert got[i]["level"] == pytest.approx(np.mean([r["target"] for r in got[:i]]))
    later = pool.filter("respondent = 'AA'").withColumn("target", F.when(F.col("target_date") >= "2024-01-10", F.col("target") * 9).otherwise(F.col("target")))
    moved = later.withColumn("level", models.ordered_level()).filter("target_date <= '2024-01-10'").select("target_date", "level")
    assert moved.exceptAll(known.filter("target_date <= '2024-01-10'").select("target_date", "level")).count() == 0
