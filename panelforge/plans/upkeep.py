"""Registered queries of what is kept up to date: snapshots, feature store, sketches, streams that follow revisions and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.gamma import chi_square_p_value
from panelforge.operators import distribution, drift, metrics, models, quality, scoring, sketches
from panelforge.operators.boosting import BoostedTrees, Tree
from panelforge.plans import sql as q
from panelforge.plans.catalog import (
    APPROACHES,
    CATEGORICAL_SQL,
    DRIFT_NUMERIC,
    ECDF,
    LANDED,
    MATRIX_WINDOWS,
    NEWEST,
    ORACLES,
    _landing,
    _requests,
    _scratch,
    _selected,
    _windows,
    feature_table,
    observations,
    query,
    rounded,
    split_predicted,
    stored_wide,
)
from panelforge.session import cut_lineage
from panelforge.sources import feature_store, point_store, sinks, snapshots, tables
from panelforge.sources.ingest_job import ingest_landed
from panelforge.streaming import scoring as stream_scoring
from panelforge.streaming.ingest import append_stream, revisions, stream_pages

# ------------------------------------------------------------------ snapshots and the feature store


@query("snapshot_upsert", NEWEST)
def _(spark, sf_dir):
    """Events in two batches that share a week, each a version of its own."""
    root = _scratch(spark, "snapshots")
    df = tables.event_observations(spark, sf_dir)
    middle = df.agg(F.expr("timestamp_micros((unix_micros(min(_ingested_at)) + unix_micros(max(_ingested_at))) div 2)").alias("m")).first()["m"]
    snapshots.upsert_raw(df.filter(F.col("_ingested_at") < F.lit(middle)), root, "month")
    snapshots.upsert_raw(df.filter(F.col("_ingested_at") >= F.lit(middle) - F.expr("interval 7 days")), root, "month")
    return snapshots.read_raw(spark, root, "month").select("period", "respondent", "type", "value")


@query(
    "feature_store_revision",
    q.with_(
        q.FEATURES,
        """SELECT forecast_date, target_date, respondent, tier, target, benchmark_forecast, naive_persistence, demand_t, demand_lag_1,
                  demand_lag_6 FROM features""",
    ),
)
def _(spark, sf_dir):
    """A store built before some days were revised, and brought up to date."""
    panel, tiers = stored_wide(spark, sf_dir), tables.nation_tiers(spark, sf_dir)
    revised = "respondent in ('NATION_3', 'NATION_12') and period between date'1995-06-01' and date'1995-06-20'"
    late = "respondent = 'NATION_7' and period >= date'1998-01-01'"
    old = panel.filter(f"not ({late})").withColumn("demand", F.when(F.expr(revised), F.col("demand") * 2).otherwise(F.col("demand")))
    root = _scratch(spark, "features")
    feature_store.build_store(old, root, tiers)
    touched = panel.filter(f"({revised}) or ({late})").select("respondent", "period")
    feature_store.revise_store(touched, lambda a, b: panel.filter(F.col("period").between(a, b)), root, tiers)
    return feature_store.read_store(spark, root).select(
        "forecast_date", "target_date", "respondent", "tier", "target", "benchmark_forecast", "naive_persistence", "demand_t",
        "demand_lag_1", "demand_lag_6",
    )


@query("point_lookup", ORACLES["row_lookup"])
def _(spark, sf_dir):
    """Requests against a store that is laid out for them."""
    path = _scratch(spark, "points")
    point_store.write_points(feature_table(spark, sf_dir), path)
    out = point_store.lookup_points(spark, path, _requests(spark, sf_dir))
    return out.select("respondent", "requested_date", "target_date", "found", "target", "demand_t")


# ------------------------------------------------------------------ sketches and tests


@query(
    "sketch_profile",
    q.with_(
        MATRIX_WINDOWS,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS missing, ROUND(AVG({c}), 4) AS mean,
                ROUND(STDDEV_SAMP({c}), 2) AS std, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
                true AS distinct_near, true AS ranks_near FROM windowed"""
            for c in DRIFT_NUMERIC
        ),
    ),
)
def _(spark, sf_dir):
    """Sketches by window and day, stored, read back and merged; their ranks and distinct counts against the rows themselves."""
    df = _windows(spark, sf_dir)
    path = _scratch(spark, "sketches")
    sketches.write_sketches(sketches.column_sketches(df, DRIFT_NUMERIC, ["window", "target_date"]), path, "target_date")
    stored = sketches.read_sketches(spark, path, "target_date")
    profile = cut_lineage(sketches.sketched_profile(sketches.merge_sketches(stored, [])))
    counts = distribution.ordered_counts(df, DRIFT_NUMERIC, {"n": F.lit(1)}).join(profile, "feature")
    near = F.lit(True)
    for name, rank in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        upto = F.max(F.when(F.col("value") <= F.col(name), F.col("cum_n") / F.col("total_n")))
        below = F.coalesce(F.max(F.when(F.col("value") < F.col(name), F.col("cum_n") / F.col("total_n"))), F.lit(0.0))
        slack = 3 * sketches.rank_error()
        near &= (upto >= rank - slack) & (below <= rank + slack)
    judged = counts.groupBy("feature").agg(
        near.alias("ranks_near"),
        (F.abs(F.max("distinct") / F.count(F.lit(1)) - 1) < 0.05).alias("distinct_near"),
    )
    out = profile.select("feature", "rows", "missing", "mean", "std", "min", "max").join(judged, "feature", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(True)) for c in ("ranks_near", "distinct_near")})
    return rounded(rounded(out, 4, "mean"), 2, "std")


@query(
    "sketch_drift",
    q.with_(ECDF, "SELECT feature, n_reference, n_current, true AS ks_near, true AS distance_near FROM numeric_drift"),
)
def _(spark, sf_dir):
    """Drift statistics from one sketch per window and column, against the exact ones."""
    df = _windows(spark, sf_dir)
    made = cut_lineage(sketches.column_sketches(df, DRIFT_NUMERIC, ["window"]))
    width = made.groupBy("feature").agg((F.max("high") - F.min("low")).alias("width"))
    rough = sketches.sketched_drift(made).join(width, "feature")
    exact = drift.numeric_drift(df, DRIFT_NUMERIC).select(
        "feature", F.col("ks_statistic").alias("ks"), F.col("wasserstein").alias("w")
    )
    far = F.abs(F.col("ks_statistic") - F.col("ks")) > F.col("ks_error")
    wide = F.abs(F.col("wasserstein") - F.col("w")) > F.col("ks_error") * F.col("width")
    return rough.join(exact, "feature").select(
        "feature", "n_reference", "n_current", F.coalesce(~far, F.lit(True)).alias("ks_near"), F.coalesce(~wide, F.lit(True)).alias("distance_near")
    )


@query(
    "categorical_test",
    q.with_(
        q.WINDOWS + "," + CATEGORICAL_SQL,
        """SELECT feature, categories - 1 AS degrees, ROUND(chi_square, 6) AS chi_square, ROUND(p, 8) AS p_value, p < 0.05 AS chi_drifted
           FROM (SELECT *, GREATEST(0, LEAST(1, 1 - (SELECT SUM(EXP(-chi_square / 2 + ((categories - 1) / 2.0 + n) * LN(chi_square / 2)
                                                     - LGAMMA((categories - 1) / 2.0 + n + 1))) FROM RANGE(0, 3000) AS r(n)))) AS p
                 FROM categorical_drift)""",
    ),
)
def _(spark, sf_dir):
    out = drift.categorical_drift(_windows(spark, sf_dir), ["respondent", "tier"])
    out = out.withColumn("degrees", F.col("categories") - 1)
    out = out.withColumn("p_value", chi_square_p_value(F.col("chi_square"), F.col("degrees")))
    out = out.select("feature", "degrees", "chi_square", "p_value", (F.col("p_value") < 0.05).alias("chi_drifted"))
    return rounded(rounded(out, 6, "chi_square"), 8, "p_value")


@query("drift_summary_saved", ORACLES["drift_summary"])
def _(spark, sf_dir):
    """The drift summary written as JSON lines and read back."""
    df = _windows(spark, sf_dir)
    out = drift.drift_summary(df, drift.drift_columns(df), prediction="prediction")
    out = rounded(out, 4, "wmape_reference", "wmape_current")
    path = _scratch(spark, "summary")
    sinks.save_summary(out, path)
    return spark.read.schema(out.schema).json(path)


# ------------------------------------------------------------------ streams


@query("stream_revisions", q.with_(LANDED, "SELECT period, respondent, 'D' AS type, value FROM landed WHERE NOT lost"))
def _(spark, sf_dir):
    """All pages, and then all of them once more: what has been seen goes no further."""
    landing, out, state = _landing(spark, sf_dir), _scratch(spark, "stream"), _scratch(spark, "stream-state")
    for again in (False, True):
        if again:
            spark.read.text(landing).write.mode("append").partitionBy("entity", "year").text(landing)
        append_stream(revisions(stream_pages(spark, landing, "pages")), out, state).awaitTermination()
    return spark.read.parquet(out).select("period", "respondent", "type", "value")


#: Cut and both values of the stand-in models, one split of today's demand each.
STUMPS = {"Large": (60_000.0, 50_000.0, 90_000.0), "Medium": (55_000.0, 40_000.0, 80_000.0), "Small": (50_000.0, 30_000.0, 70_000.0)}


def stump_models(spark, sf_dir, tiers) -> dict[str, models.TierModel]:
    """Fixed one-split models in place of fitted ones; every fifth nation falls back."""
    nations = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("respondent"), "n_nationkey")
    known = nations.join(tables.nation_tiers(spark, sf_dir), "respondent")
    out = {}
    for tier in tiers:
        cut, low, high = STUMPS[tier]
        tree = Tree.of(
            {"feature": [0, -1, -1], "cut": [1, 0, 0], "missing_left": [True, False, False], "left": [1, 0, 0], "right": [2, 0, 0], "value": [0.0, low, high]}
        )
        entities = known.filter(F.col("tier") == tier).select(
            "respondent", F.lit(None).cast("double").alias("_level"), (F.col("n_nationkey") % 5 == 0).alias("fallback")
        )
        trees = BoostedTrees([np.array([cut]), np.array([])], 0.0, 1.0, [tree])
        out[tier] = models.TierModel(tier, trees, 1.0, ["demand_t"], entities)
    return out


def _stump_sql(tiers) -> str:
    cases = " ".join(
        f"WHEN tier = '{t}' THEN CASE WHEN f.demand_t > {STUMPS[t][0]} THEN {STUMPS[t][2]} ELSE {STUMPS[t][1]} END" for t in tiers
    )
    listed = ", ".join(f"'{t}'" for t in tiers)
    return f"CASE WHEN n_nationkey % 5 = 0 AND tier IN ({listed}) THEN naive_persistence ELSE CAST(CASE {cases} END AS DOUBLE) END"


FEATURE_KEYS = "FROM features f JOIN nation ON n_name = f.respondent"


@query(
    "tier_routing",
    q.with_(q.FEATURES, f"SELECT f.respondent, target_date, tier, {_stump_sql(['Large', 'Medium'])} AS model_prediction {FEATURE_KEYS}"),
)
def _(spark, sf_dir):
    """Rows by the model of their tier; small ones have none."""
    scored = models.predict_with_tier_models(feature_table(spark, sf_dir), stump_models(spark, sf_dir, ["Large", "Medium"]))
    return scored.select("respondent", "target_date", "tier", "model_prediction")


@query(
    "stream_scoring",
    q.with_(
        q.FEATURES,
        f"SELECT f.respondent, target_date, tier, {_stump_sql(STUMPS)} AS model_prediction, CAST(1 AS INTEGER) AS model_version {FEATURE_KEYS}",
    ),
)
def _(spark, sf_dir):
    """Feature rows as a stream, scored by models saved and loaded again."""
    rows, root, out = _scratch(spark, "rows"), _scratch(spark, "models"), _scratch(spark, "scored")
    columns = ["respondent", "target_date", "tier", "demand_t", "naive_persistence"]
    feature_table(spark, sf_dir).select(*columns).write.parquet(rows)
    stream_scoring.publish_models(stump_models(spark, sf_dir, STUMPS), root)
    stream = spark.readStream.schema(spark.read.parquet(rows).schema).parquet(rows)
    stream_scoring.score_with_newest(stream, root, out, _scratch(spark, "stream-state")).awaitTermination()
    return stream_scoring.read_scored(spark, out).select("respondent", "target_date", "tier", "model_prediction", "model_version")


# ------------------------------------------------------------------ models and their records


@query(
    "ordered_entity_level",
    q.with_(
        q.FEATURES,
        """SELECT respondent, target_date, ROUND(AVG(target) OVER (PARTITION BY respondent ORDER BY target_date
                  RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 4) AS level FROM features""",
    ),
)
def _(spark, sf_dir):
    out = feature_table(spark, sf_dir).select("respondent", "target_date", models.ordered_level().alias("level"))
    return rounded(out, 4, "level")


@query(
    "best_parameters",
    q.with_(
        q.FEATURES
        + """, trials AS (
          SELECT tier, n_nationkey AS trial, '{"trial": ' || n_nationkey || '}' AS params,
                 ROUND(100.0 * SUM(ABS(target - naive_persistence)) / SUM(ABS(target)), 6) AS wmape
          FROM features f JOIN nation ON n_name = f.respondent WHERE naive_persistence IS NOT NULL GROUP BY 1, 2)""",
        "SELECT tier, ARG_MIN(params, (wmape, trial)) AS params, MIN(wmape) AS wmape FROM trials GROUP BY 1",
    ),
)
def _(spark, sf_dir):
    """The best of stand-in trials, an entity's naive error each; saved and loaded again."""
    nations = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("respondent"), F.col("n_nationkey").cast("int").alias("trial"))
    rows = feature_table(spark, sf_dir).filter("naive_persistence is not null").join(nations, "respondent")
    error = 100.0 * F.sum(F.abs(F.col("target") - F.col("naive_persistence"))) / F.sum(F.abs("target"))
    trials = rows.groupBy("tier", "trial").agg(F.round(error, 6).alias("wmape"))
    trials = trials.withColumn("params", F.concat(F.lit('{"trial": '), F.col("trial").cast("string"), F.lit("}")))
    path = _scratch(spark, "params")
    models.save_params(models.best_params(trials), path)
    loaded = models.load_params(spark, path)
    best = spark.read.schema("tier string, params string, wmape double").json(path)
    return best.filter(F.col("tier").isin(list(loaded)))


@query(
    "evaluation_summary",
    q.with_(
        q.FALLBACK
        + ", test_scored AS (SELECT * FROM scored WHERE split = 'test'), m AS ("
        + q.comparison("test_scored", APPROACHES)
        + ")",
        " UNION ALL ".join(
            f"SELECT approach AS section, tier, '{n}' AS name, CAST({n} AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text FROM m"
            for n in ("mae", "smape", "wmape", "r2", "n_samples")
        )
        + """ UNION ALL SELECT 'test_period', NULL, 'start', NULL, CAST(MIN(target_date) AS VARCHAR) FROM test_scored
              UNION ALL SELECT 'test_period', NULL, 'end', NULL, CAST(MAX(target_date) AS VARCHAR) FROM test_scored
              UNION ALL SELECT 'test_period', NULL, 'rows', COUNT(*), NULL FROM test_scored
              UNION ALL SELECT 'fallback', tier, respondent, NULL, 'naive' FROM guard WHERE model_mae > naive_mae""",
    ),
)
def _(spark, sf_dir):
    """Errors of all approaches, the period and the entities that fall back, as one report."""
    df = cut_lineage(split_predicted(spark, sf_dir).withColumn("prediction", F.col("demand_lag_6")))
    lost = scoring.fallback_entities(df.filter("split = 'val'"), "prediction")
    test = cut_lineage(scoring.apply_fallback(df, lost, "prediction").filter("split = 'test'"))
    report = metrics.evaluation_summary(test, metrics.compare_predictions(test, APPROACHES), lost)
    path = _scratch(spark, "evaluation")
    sinks.save_summary(report, path)
    number = F.expr("try_cast(value as double)")
    return spark.read.schema(report.schema).json(path).select(
        "section", "tier", "name", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text")
    )


# ------------------------------------------------------------------ ingest log, report list, schema faults


@query(
    "failure_log",
    q.with_(
        LANDED + ", found AS (SELECT respondent, COUNT(*) FILTER (WHERE NOT lost) AS n, COUNT(*) AS seen FROM landed GROUP BY 1)",
        """SELECT n_name AS respondent, CASE WHEN n_nationkey = 24 THEN 'timeout' ELSE 'no_data' END AS reason,
                  CASE WHEN n_nationkey = 24 THEN 'error' ELSE 'no_data' END AS category
           FROM nation LEFT JOIN found ON n_name = found.respondent WHERE n_nationkey = 24 OR COALESCE(n, 0) = 0""",
    ),
)
def _(spark, sf_dir):
    """What a run could not fetch, read back from its log."""
    nations = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("respondent"), "n_nationkey")
    failures = nations.filter("n_nationkey = 24").select("respondent", F.lit("timeout").alias("reason"))
    log = _scratch(spark, "failures")
    ingest_landed(spark, _landing(spark, sf_dir), _scratch(spark, "store"), nations, "pages", failures=failures, log=log)
    return spark.read.schema("respondent string, reason string, category string").json(log)


@query("report_list", q.with_(q.COVERAGE, "SELECT respondent FROM coverage WHERE role <> 'aggregate' AND coverage_pct >= 50"))
def _(spark, sf_dir):
    """Approved entities as one document with a list, and read back from it."""
    listed = F.to_json(F.struct(F.collect_list("respondent").alias("modeling_respondents")))
    path = _scratch(spark, "report")
    _selected(spark, sf_dir).filter("selection = 'keep'").agg(listed.alias("value")).write.text(path)
    return sinks.read_report_list(spark, path)


@query(
    "schema_faults",
    """SELECT 'no value' AS fault, 'schema' AS "check", 'ERROR' AS severity, false AS passed
       UNION ALL SELECT 'text value', 'schema', 'ERROR', false UNION ALL SELECT 'text value', 'units', 'INFO', false
       UNION ALL SELECT 'text period', 'schema', 'ERROR', false UNION ALL SELECT 'text period', 'units', 'INFO', false""",
)
def _(spark, sf_dir):
    """Tables that the gate turns away by their schema."""
    df = observations(spark, sf_dir)
    faulty = {
        "no value": df.drop("value"),
        "text value": df.withColumn("value", F.col("value").cast("string")),
        "text period": df.withColumn("period", F.col("period").cast("string")),
    }
    out: DataFrame | None = None
    for fault, table in faulty.items():
        result = quality.validate(table)
        passed = result.verdict.select("passed").scalar()
        part = result.findings.select(F.lit(fault).alias("fault"), "check", "severity", passed.alias("passed"))
        out = part if out is None else out.unionByName(part)
    return out

