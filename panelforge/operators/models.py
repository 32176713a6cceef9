"""One gradient-boosted regressor per tier, with guardrail, search and persistence."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators.boosting import (
    Booster,
    BoostedTrees,
    boost,
    chunked_rows,
    judged_wmape,
    quantile_cuts,
    score_column,
)
from panelforge.operators.scoring import fallback_entities, naive_column
from panelforge.operators.splits import walk_forward_folds
from panelforge.schema import NUMERIC_FEATURES, TIER_NAMES, check_feature_contract
from panelforge.session import cut_lineage

# Settings of a fit and bounds of the search, which must equal the compared library's.
DEFAULT_PARAMS = {
    "maxIter": 600,
    "stepSize": 0.03,
    "maxLeaves": 31,
    "minInstancesPerNode": 20,
    "subsamplingRate": 0.85,
    "featureSubsetStrategy": "0.85",
    "patience": 40,
    "seed": 42,
}
SEARCH_ITERATIONS = 500
STEP_BOUNDS = (0.01, 0.15)
LEAF_BOUNDS = (15, 63)
DEPTH_BOUNDS = (3, 10)
ROWS_BOUNDS = (10, 50)
SHARE_BOUNDS = (0.6, 1.0)
PENALTY_BOUNDS = (1e-3, 10.0)

#: Trees of a fit without a depth of its own; the number of leaves binds first.
MAX_DEPTH = 6


@dataclass(frozen=True)
class TierModel:
    """A fitted tier.

    ``entities`` holds (respondent, _level, fallback): the entity's mean target
    in the training rows, which stands for the entity as a feature, and whether
    its forecasts fall back to the naive value.  A table and not a list of
    labels, since the number of entities has no bound.
    """

    tier: str
    regressor: BoostedTrees
    scale: float
    features: list[str]
    entities: DataFrame

    best_score: float | None = None

    @property
    def best_iteration(self) -> int:
        """Boosting iterations kept: the trees up to the best validation error."""
        return self.regressor.getNumTrees

    @property
    def trees(self) -> int:
        return self.regressor.getNumTrees


def ordered_level(target: str = "target", entity: str = "respondent", date: str = "target_date") -> Column:
    """Mean target of the entity over strictly earlier days: the entity as a feature of a training row.

    The row's own and later targets play no part, so the feature tells nothing that was not known then.
    """
    day = F.unix_date(F.to_date(date))
    earlier = Window.partitionBy(entity).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    return F.avg(target).over(earlier)


def _booster(part: str, params: dict, train_to: int, val_from: int, val_to: int) -> Booster:
    p = {**DEFAULT_PARAMS, **params}
    return Booster(
        part,
        train_to,
        val_from,
        val_to,
        step=float(p["stepSize"]),
        leaves=int(p["maxLeaves"]),
        depth=int(p.get("maxDepth", MAX_DEPTH)),
        min_rows=int(p["minInstancesPerNode"]),
        rows_share=float(p["subsamplingRate"]),
        features_share=float(p["featureSubsetStrategy"]),
        alpha=float(p.get("regAlpha", 0.0)),
        lam=float(p.get("regLambda", 0.0)),
        seed=int(p["seed"]),
        patience=int(p["patience"]),
    )


def _labelled(df: DataFrame, tiers: list[str]) -> DataFrame:
    return df.filter(F.col("tier").isin(tiers) & F.col("target").isNotNull())


def train_all_tiers(
    train: DataFrame,
    val: DataFrame,
    tiers: Iterable[str] = TIER_NAMES,
    params: dict | None = None,
    params_by_tier: dict[str, dict] | None = None,
    features: list[str] = NUMERIC_FEATURES,
) -> dict[str, TierModel]:
    """One model per tier with absolute loss; iterations stop when the tier's validation error does.

    All tiers are boosted in the same jobs.  A training row knows its entity by ``ordered_level``, a later row
    by the mean over all training rows.
    """
    check_feature_contract(features)
    tiers = list(tiers)
    tr, va = _labelled(train, tiers), _labelled(val, tiers)
    for rows, name in ((tr, "training"), (va, "validation")):
        present = {r["tier"] for r in rows.select("tier").distinct().collect()}
        for tier in tiers:
            if tier not in present:
                raise ValueError(f"no {name} rows for tier {tier}")

    levels = cut_lineage(tr.groupBy("tier", "respondent").agg(F.avg("target").alias("_level")))
    columns = list(dict.fromkeys(["tier", "respondent", "target", naive_column(train), *features]))
    early = tr.withColumn("_level", ordered_level()).select(*columns, "_level", F.lit(0).alias("_stamp"))
    late = va.join(levels, ["tier", "respondent"], "left").select(*columns, "_level", F.lit(1).alias("_stamp"))
    inputs = [*features, "_level"]
    cuts = quantile_cuts(early, inputs, "tier")
    chunks = chunked_rows(
        early.unionByName(late), inputs, cuts, "tier", F.col("_stamp"), "target", naive_column(train), "respondent"
    )
    settings = [{**(params or {}), **(params_by_tier or {}).get(tier, {})} for tier in tiers]
    boosters = [_booster(tier, own, 0, 1, 1) for tier, own in zip(tiers, settings)]
    limits = [int({**DEFAULT_PARAMS, **own}["maxIter"]) for own in settings]
    for limit in sorted(set(limits)):
        boost(chunks, [b for b, most in zip(boosters, limits) if most >= limit], len(inputs), limit)

    fitted = {tier: BoostedTrees.of(b, cuts) for tier, b in zip(tiers, boosters)}
    scored = _scored(va, fitted, features, levels, "_raw")
    lost = fallback_entities(scored, "_raw").withColumn("fallback", F.lit(True))
    entities = cut_lineage(
        levels.join(lost, ["tier", "respondent"], "full").withColumn("fallback", F.coalesce("fallback", F.lit(False)))
    )
    return {
        tier: TierModel(
            tier,
            fitted[tier],
            1.0,
            list(features),
            entities.filter(F.col("tier") == tier).select("respondent", "_level", "fallback"),
            b.errors[b.best],
        )
        for tier, b in zip(tiers, boosters)
    }


def fit_tier(
    train: DataFrame,
    val: DataFrame,
    tier: str,
    params: dict | None = None,
    features: list[str] = NUMERIC_FEATURES,
) -> TierModel:
    """Fit one tier; see :func:`train_all_tiers`."""
    return train_all_tiers(train, val, [tier], params, None, features)[tier]


def fallback_of(model: TierModel) -> DataFrame:
    """(tier, respondent) of the entities whose forecasts fall back."""
    return model.entities.filter("fallback").select(F.lit(model.tier).alias("tier"), "respondent")


def _scored(df: DataFrame, models: dict[str, BoostedTrees], features: list[str], entities: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` scored by the model of their tier, with the columns of ``entities``."""
    joined = df.join(entities, ["tier", "respondent"], "left")
    return joined.withColumn(name, score_column(models, F.col("tier"), [F.col(c) for c in [*features, "_level"]])).drop("_level")


def predict(df: DataFrame, model: TierModel, name: str = "model_prediction", enable_fallback: bool = True) -> DataFrame:
    """Score all rows with one tier model, batch or stream."""
    columns = [c for c in df.columns if c != name]
    own = df.select(*[F.col(c).alias(f"_own_{c}") if c == "tier" else F.col(c) for c in columns]).withColumn("tier", F.lit(model.tier))
    scored = predict_with_tier_models(own, {model.tier: model}, name, enable_fallback)
    return scored.select(*[F.col(f"_own_{c}").alias(c) if c == "tier" else F.col(c) for c in columns], name)


def predict_with_tier_models(
    df: DataFrame,
    models: dict[str, TierModel],
    name: str = "model_prediction",
    enable_fallback: bool = True,
) -> DataFrame:
    """Score every row with the model of its tier; rows of other tiers get NULL.

    The rows are read once: one join with the entities of all models and one scoring column.
    """
    columns = [c for c in df.columns if c != name]
    if not models:
        return df.select(*columns).withColumn(name, F.lit(None).cast("double"))
    entities = None
    for tier, model in models.items():
        own = model.entities.select(
            F.lit(tier).alias("tier"), "respondent", "_level", F.col("fallback").alias("_fallback")
        )
        entities = own if entities is None else entities.unionByName(own)
    by_features: dict[tuple, dict[str, BoostedTrees]] = {}
    for tier, model in models.items():
        by_features.setdefault(tuple(model.features), {})[tier] = model.regressor
    joined = df.select(*columns).join(entities, ["tier", "respondent"], "left")
    parts = [
        score_column(group, F.col("tier"), [F.col(c) for c in [*features, "_level"]])
        for features, group in by_features.items()
    ]
    scored = joined.withColumn(name, F.coalesce(*parts))
    if enable_fallback:
        naive = F.col(naive_column(df))
        scored = scored.withColumn(name, F.when(F.col("_fallback"), naive).otherwise(F.col(name)))
    return scored.select(*columns, name)


def latest_rows(features: DataFrame) -> DataFrame:
    """The last feature row of each entity, combined map-side; its target may be unknown."""
    others = [c for c in features.columns if c not in ("respondent", "forecast_date")]
    newest = F.max(F.struct("forecast_date", *others)).alias("_r")
    return features.groupBy("respondent").agg(newest).select("respondent", "_r.*").select(*features.columns)


# ------------------------------------------------------------------ persistence


META = "tier string, scale double, features array<string>, best_score double"


def save_model(model: TierModel, path: str) -> None:
    spark = model.entities.sparkSession
    trees = spark.createDataFrame([(model.regressor.to_json(),)], "model string")
    trees.write.mode("overwrite").parquet(f"{path}/regressor")
    model.entities.write.mode("overwrite").parquet(f"{path}/entities")
    meta = spark.createDataFrame(
        [(model.tier, model.scale, model.features, model.best_score)], META
    )
    meta.write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> TierModel:
    meta = spark.read.schema(META).json(f"{path}/meta").first()
    return TierModel(
        tier=meta["tier"],
        regressor=BoostedTrees.from_json(spark.read.parquet(f"{path}/regressor").first()["model"]),
        scale=meta["scale"],
        features=list(meta["features"]),
        entities=spark.read.parquet(f"{path}/entities"),
        best_score=meta["best_score"],
    )


# ------------------------------------------------------------------ search


def random_candidates(n: int, seed: int = 42, **fixed) -> list[dict]:
    """Seeded parameter sets; learning rates and penalties are drawn log-uniformly."""
    draw = random.Random(seed)

    def logged(bounds: tuple[float, float]) -> float:
        return round(math.exp(draw.uniform(*map(math.log, bounds))), 6)

    return [
        {
            "maxIter": SEARCH_ITERATIONS,
            "stepSize": logged(STEP_BOUNDS),
            "maxLeaves": draw.randint(*LEAF_BOUNDS),
            "maxDepth": draw.randint(*DEPTH_BOUNDS),
            "minInstancesPerNode": draw.randint(*ROWS_BOUNDS),
            "subsamplingRate": round(draw.uniform(*SHARE_BOUNDS), 4),
            "featureSubsetStrategy": str(round(draw.uniform(*SHARE_BOUNDS), 4)),
            "regAlpha": logged(PENALTY_BOUNDS),
            "regLambda": logged(PENALTY_BOUNDS),
            **fixed,
        }
        for _ in range(n)
    ]


def halving_rungs(candidates: int, n_splits: int, rounds: int, keep: float = 1 / 3) -> list[tuple[int, int, int]]:
    """``(candidates, folds, rounds)`` of each rung: a share ``keep`` goes on, folds and rounds grow to the full ones.

    There is a rung per fold, with 1/27, 1/9, ... of the rounds before the last.
    """
    rungs = []
    for rung in range(n_splits):
        left = n_splits - 1 - rung
        rungs.append((max(1, math.ceil(candidates * keep**rung)), rung + 1, max(1, math.ceil(rounds / 3 ** (1.5 * left)))))
    return rungs


TRIALS = "tier string, trial int, params string, folds int, wmape double, rung int, rung_wmape double"


def search_tiers(
    df: DataFrame,
    tiers: list[str],
    candidates: list[dict],
    n_splits: int = 3,
    features: list[str] = NUMERIC_FEATURES,
    rungs: list[tuple[int, int, int]] | None = None,
) -> DataFrame:
    """Search over walk-forward folds by successive halving, all tiers, trials and folds in the same jobs.

    ``rungs`` holds (candidates, folds, rounds), by default :func:`halving_rungs`; one rung with all folds and rounds is the full search.
    Rows are binned once for all trials, and boosters go on where the rung before left them.  A trial's score is its mean validation
    WMAPE with fallback over the folds of the rung; folds without a valid pair are left out.  Trials whose models all fall back
    yet are told apart by the WMAPE without fallback.

    Result: ``TRIALS``; ``wmape`` only for those that reached the last rung, ``rung_wmape`` for every trial at its last rung (counted from 1).
    """
    check_feature_contract(features)
    rows = _labelled(df, tiers)
    folds = {}
    for tier in tiers:
        own = rows.filter(F.col("tier") == tier)
        if own.isEmpty():
            raise ValueError(f"no rows for tier {tier}")
        cut = [F.unix_date(c).alias(c) for c in ("train_end", "val_start", "val_end")]
        folds[tier] = walk_forward_folds(own, n_splits).orderBy("fold").select(*cut).collect()
    inputs = [*features, "_level"]
    naive = naive_column(df)
    known = rows.withColumn("_level", ordered_level())
    cuts = quantile_cuts(known, inputs, "tier")
    stamp = F.unix_date(F.to_date("target_date"))
    chunks = chunked_rows(known, inputs, cuts, "tier", stamp, "target", naive, "respondent")

    iterations = max(int({**DEFAULT_PARAMS, **c}["maxIter"]) for c in candidates)
    rungs = rungs or halving_rungs(len(candidates), n_splits, iterations)
    boosters: dict[tuple[str, int, int], Booster] = {}
    alive = {tier: list(range(len(candidates))) for tier in tiers}
    scores: dict[tuple[str, int], tuple[int, int, float | None, float]] = {}
    for rung, (many, used, rounds) in enumerate(rungs, 1):
        for tier in tiers:
            alive[tier] = sorted(alive[tier], key=lambda t: (*_rank(scores.get((tier, t))), t))[:many]
            for trial in alive[tier]:
                for fold in range(used):
                    cut = folds[tier][fold]
                    boosters.setdefault((tier, trial, fold), _booster(tier, candidates[trial], *cut))
        own = [(k, boosters[k]) for k in boosters if k[1] in alive[k[0]] and k[2] < used]
        limits = {k: min(rounds, int({**DEFAULT_PARAMS, **candidates[k[1]]}["maxIter"])) for k, _ in own}
        for limit in sorted(set(limits.values())):
            boost(chunks, [b for k, b in own if limits[k] >= limit], len(inputs), limit)
        judged = judged_wmape(chunks, [b for _, b in own])
        for tier in tiers:
            for trial in alive[tier]:
                valid = [judged[i] for i, (k, _) in enumerate(own) if k[:2] == (tier, trial) and i in judged]
                mean, plain = (sum(v) / len(valid) for v in zip(*valid)) if valid else (None, math.inf)
                scores[tier, trial] = (rung, len(valid), mean, plain)
    out = [
        (tier, trial, json.dumps(candidates[trial], sort_keys=True), n, w if rung == len(rungs) else None, rung, w)
        for (tier, trial), (rung, n, w, _) in sorted(scores.items())
    ]
    return df.sparkSession.createDataFrame(out, TRIALS)


def _rank(score: tuple | None) -> tuple[float, float]:
    """Order of the trials: unknown ones as they come, those without a valid row last."""
    if score is None:
        return 0.0, 0.0
    return (math.inf if score[2] is None else score[2]), score[3]


def walk_forward_search(
    df: DataFrame, tier: str, candidates: list[dict], n_splits: int = 3, features: list[str] = NUMERIC_FEATURES
) -> DataFrame:
    """Every candidate over all folds and rounds: (tier, trial, params, folds, wmape).

    Folds without a valid pair are left out; a candidate without any has NULL.
    """
    most = max(int({**DEFAULT_PARAMS, **c}["maxIter"]) for c in candidates)
    trials = search_tiers(df, [tier], candidates, n_splits, features, [(len(candidates), n_splits, most)])
    return trials.select("tier", "trial", "params", "folds", "wmape")


def best_params(trials: DataFrame) -> DataFrame:
    """The parameter set with the lowest WMAPE per tier; ties go to the earlier trial."""
    return (
        trials.filter("wmape is not null")
        .groupBy("tier")
        .agg(F.min(F.struct("wmape", "trial", "params")).alias("_b"))
        .select("tier", "_b.params", "_b.wmape")
    )


def save_params(best: DataFrame, path: str) -> None:
    best.write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str) -> dict[str, dict]:
    """Parameter sets by tier; a missing file and lines that cannot be read give none."""
    try:
        rows = spark.read.schema("tier string, params string, wmape double").json(path).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    out = {}
    for row in rows:
        try:
            out[row["tier"]] = json.loads(row["params"])
        except (TypeError, ValueError):
            continue
    return out
