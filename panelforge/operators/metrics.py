"""Metric tables: per tier and overall, comparison, deltas, promotion gate, log rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import errors
from panelforge.schema import OVERALL, nan_to_null


def _metric_struct(truth: str, prediction: str, rounded: bool) -> Column:
    fields = []
    for name, fn in errors.HEADLINE.items():
        value = fn(truth, prediction)
        fields.append((F.round(value, errors.HEADLINE_SCALE[name]) if rounded else value).alias(name))
    return F.struct(*fields, errors.n_samples(truth, prediction).alias("n_samples"))


def compare_predictions(
    df: DataFrame, predictions: dict[str, str], truth: str = "target", tier: str = "tier", rounded: bool = True
) -> DataFrame:
    """Metrics of several predictions per tier and overall: (approach, tier, metrics).

    ``predictions`` maps an approach name to its column.  All approaches are
    aggregated side by side in one pass; only the few result rows are unpivoted.
    """
    wide = (
        df.rollup(tier)
        .agg(
            F.grouping(tier).alias("_all"),
            *[
                _metric_struct(truth, column, rounded).alias(f"_m{i}")
                for i, column in enumerate(predictions.values())
            ],
        )
        .filter(F.col("_all").eqNullSafe(1) | F.col(tier).isNotNull())
    )
    rows = F.array(
        *[F.struct(F.lit(name).alias("approach"), F.col(f"_m{i}").alias("m")) for i, name in enumerate(predictions)]
    )
    return (
        wide.select(F.when(F.col("_all") == 1, OVERALL).otherwise(F.col(tier)).alias("tier"), F.explode(rows).alias("r"))
        .select("r.approach", "tier", "r.m.*")
    )


def evaluate(
    df: DataFrame, prediction: str, truth: str = "target", tier: str = "tier", rounded: bool = True
) -> DataFrame:
    """MAE, SMAPE, WMAPE, R² and sample count per tier and overall."""
    return compare_predictions(df, {"p": prediction}, truth, tier, rounded).drop("approach")


def delta_report(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Change of SMAPE and WMAPE per tier between two metric tables."""
    old = prior.select("tier", F.col("smape").alias("prior_smape"), F.col("wmape").alias("prior_wmape"))
    cur = new.select("tier", F.col("smape").alias("new_smape"), F.col("wmape").alias("new_wmape"))
    return old.join(cur, "tier").select(
        "tier",
        "prior_smape",
        "new_smape",
        (F.col("new_smape") - F.col("prior_smape")).alias("delta_smape"),
        "prior_wmape",
        "new_wmape",
        (F.col("new_wmape") - F.col("prior_wmape")).alias("delta_wmape"),
    )


def promotion_gate(candidate: DataFrame, live: DataFrame | None, max_wmape_regression: float = 2.0) -> DataFrame:
    """One row: ``promote``, the number of tiers compared and the tiers that regressed.

    A tier regresses when its WMAPE grows by strictly more than the tolerance.
    Tiers without a value on one side are skipped.  Without a live table the
    candidate is promoted.
    """
    if live is None:
        live = candidate.select("tier", "wmape").limit(0)
    both = (
        candidate.select("tier", nan_to_null(F.col("wmape").cast("double")).alias("c"))
        .join(live.select("tier", nan_to_null(F.col("wmape").cast("double")).alias("l")), "tier")
        .filter("c is not null and l is not null")
        .withColumn("regressed", F.col("c") - F.col("l") > max_wmape_regression)
    )
    return both.agg(
        (F.count_if(F.col("regressed")) == 0).alias("promote"),
        F.count(F.lit(1)).alias("tiers_compared"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("regressed"), F.col("tier")))), ",").alias("regressions"),
        F.max(F.col("c") - F.col("l")).alias("worst_delta"),
    )


def win_rate(df: DataFrame, prediction: str, baseline: str = "naive_persistence", truth: str = "target") -> DataFrame:
    """Entities whose MAE is below the baseline's, per tier and overall."""
    y, p, b = (nan_to_null(F.col(c).cast("double")) for c in (truth, prediction, baseline))
    valid = y.isNotNull() & p.isNotNull() & b.isNotNull()
    per_entity = df.filter(valid).groupBy("tier", "respondent").agg(
        F.avg(F.abs(y - p)).alias("model_mae"), F.avg(F.abs(y - b)).alias("baseline_mae")
    )
    return (
        per_entity.rollup("tier")
        .agg(
            F.grouping("tier").alias("_all"),
            F.count_if(F.col("model_mae") < F.col("baseline_mae")).alias("wins"),
            F.count(F.lit(1)).alias("entities"),
        )
        .filter("_all = 1 or tier is not null")
        .select(
            F.when(F.col("_all") == 1, OVERALL).otherwise(F.col("tier")).alias("tier"),
            "wins",
            "entities",
            F.round(F.col("wins") / F.col("entities") * 100, 2).alias("win_pct"),
        )
    )


def flatten_metrics(metrics: dict[str, DataFrame]) -> DataFrame:
    """Log rows ``(name, value)`` named ``<prefix><tier>_<metric>``; missing values are left out."""
    names = [*errors.HEADLINE, "n_samples"]

    def flat(prefix: str, table: DataFrame) -> DataFrame:
        pairs = ", ".join(f"'{name}', cast({name} as double)" for name in names)
        return (
            table.select("tier", F.expr(f"stack({len(names)}, {pairs}) as (metric, value)"))
            .filter("value is not null")
            .select(F.concat(F.lit(prefix), F.lower("tier"), F.lit("_"), "metric").alias("name"), "value")
        )

    return reduce(DataFrame.unionByName, [flat(prefix, table) for prefix, table in metrics.items()])


def evaluation_period(df: DataFrame, column: str = "target_date") -> DataFrame:
    """One row: first and last evaluated day and number of rows."""
    return df.agg(
        F.min(column).alias("start"), F.max(column).alias("end"), F.count(F.lit(1)).alias("rows")
    )


def evaluation_summary(df: DataFrame, comparison: DataFrame, fallback: DataFrame) -> DataFrame:
    """Flat rows of an evaluation: (section, tier, name, value)."""
    names = [*errors.HEADLINE, "n_samples"]
    pairs = ", ".join(f"'{name}', cast({name} as string)" for name in names)
    metric_rows = comparison.select(
        F.col("approach").alias("section"), "tier", F.expr(f"stack({len(names)}, {pairs}) as (name, value)")
    )
    period = evaluation_period(df)
    period_rows = period.select(
        F.lit("test_period").alias("section"),
        F.lit(None).cast("string").alias("tier"),
        F.expr("stack(3, 'start', cast(start as string), 'end', cast(end as string), 'rows', cast(rows as string))"
               " as (name, value)"),
    )
    fallback_rows = fallback.select(
        F.lit("fallback").alias("section"), "tier", F.col("respondent").alias("name"), F.lit("naive").alias("value")
    )
    return metric_rows.unionByName(period_rows).unionByName(fallback_rows)
