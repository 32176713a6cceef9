"""Distribution drift, data quality and regression quality between two windows.

Input rows carry ``window``: reference or current (see ``monitoring_windows``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import errors
from panelforge.operators.distribution import ordered_counts, quantile_columns, unpivot_row
from panelforge.schema import CATEGORICAL_FEATURES, FEATURE_COLUMNS, nan_to_null


def _in_window(name: str) -> Column:
    return F.col("window") == name



def drift_columns(
    df: DataFrame, features: list[str] | None = None, target: str = "target", prediction: str = "prediction"
) -> list[str]:
    """Columns to compare: the features present, then target and prediction where present."""
    columns = [c for c in (features or FEATURE_COLUMNS) if c in df.columns]
    return columns + [c for c in (target, prediction) if c in df.columns and c not in columns]


def evaluation_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose first compared column is present."""
    return df.filter(F.col(columns[0]).isNotNull()) if columns else df


def _ks_p_value(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value: the alternating exponential series."""
    effective = F.sqrt(F.try_divide(n * m, n + m))
    x = (effective + 0.12 + F.try_divide(F.lit(0.11), effective)) * statistic
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x * x),
    )
    series = F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)
    # Below this the series has not converged, and the probability is 1 to many digits.
    bounded = F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return F.when(x.isNotNull(), bounded)


def numeric_drift(
    df: DataFrame,
    columns: list[str],
    p_threshold: float = 0.05,
    distance_threshold: float = 0.1,
    method: str = "ks",
    buckets: int | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov and Wasserstein-1 statistics per numeric column.

    Both are returned with their flags, the Wasserstein distance in units of the
    reference deviation.  ``method`` (wasserstein or ks) names the one that
    decides ``score`` and ``drifted``; the number of rows plays no part.  A column
    without values in one of the windows has neither statistic and no flag.
    """
    if method not in ("wasserstein", "ks"):
        raise ValueError("method is 'wasserstein' or 'ks'")
    weights = {"r": _in_window("reference").cast("long"), "c": _in_window("current").cast("long")}
    counts = ordered_counts(df, columns, weights, buckets)
    gap = F.abs(F.try_divide("cum_r", "total_r") - F.try_divide("cum_c", "total_c"))
    width = F.col("next_value") - F.col("value")
    stats = counts.groupBy("feature").agg(
        F.max("total_r").alias("n_reference"),
        F.max("total_c").alias("n_current"),
        F.max(gap).alias("ks_statistic"),
        F.when((F.max("total_r") > 0) & (F.max("total_c") > 0), F.coalesce(F.sum(gap * width), F.lit(0.0))).alias("wasserstein"),
    )
    spread = unpivot_row(
        df.agg(
            *[
                F.stddev_pop(F.when(_in_window("reference"), nan_to_null(F.col(c).cast("double")))).alias(f"s_{i}")
                for i, c in enumerate(columns)
            ]
        ),
        columns,
        {"reference_std": "s"},
    )
    p_value = _ks_p_value(
        F.col("ks_statistic"), F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    )
    normalised = F.col("wasserstein") / F.greatest("reference_std", F.lit(0.001))
    flags = {
        "ks_drifted": F.coalesce(F.col("p_value") < p_threshold, F.lit(False)),
        "distance_drifted": F.coalesce(F.col("wasserstein_norm") >= distance_threshold, F.lit(False)),
    }
    return (
        spread.join(stats, "feature", "left")
        .withColumns({"p_value": p_value, "wasserstein_norm": normalised})
        .select(
            "feature",
            F.coalesce("n_reference", F.lit(0)).alias("n_reference"),
            F.coalesce("n_current", F.lit(0)).alias("n_current"),
            "ks_statistic",
            "p_value",
            "wasserstein",
            "wasserstein_norm",
            F.lit(method).alias("method"),
            F.col("p_value" if method == "ks" else "wasserstein_norm").alias("score"),
            *(flag.alias(name) for name, flag in flags.items()),
            flags["ks_drifted" if method == "ks" else "distance_drifted"].alias("drifted"),
        )
    )


def categorical_drift(df: DataFrame, columns: list[str], distance_threshold: float = 0.1) -> DataFrame:
    """Chi-square statistic and Jensen-Shannon distance per categorical column.

    Both windows are counted in one aggregate per (column, category), so no
    join of the two sides is needed.
    """
    entries = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns]
    )
    counts = (
        df.select("window", F.inline(entries))
        .filter("category is not null")
        .groupBy("feature", "category")
        .agg(F.count_if(_in_window("reference")).alias("r"), F.count_if(_in_window("current")).alias("c"))
    )
    totals = counts.groupBy("feature").agg(F.sum("r").alias("n_r"), F.sum("c").alias("n_c"))
    n_r, n_c = F.col("n_r").cast("double"), F.col("n_c").cast("double")
    p, q = F.try_divide(F.col("r"), n_r), F.try_divide(F.col("c"), n_c)
    mid = (p + q) / 2

    def divergence(share: Column) -> Column:
        return F.when(share > 0, share * F.log2(share / mid)).otherwise(0.0)

    both = F.col("r") + F.col("c")
    expected_r = both * n_r / (n_r + n_c)
    expected_c = both * n_c / (n_r + n_c)
    chi = F.try_divide((F.col("r") - expected_r) ** 2, expected_r) + F.try_divide(
        (F.col("c") - expected_c) ** 2, expected_c
    )
    # One row per compared column: bounded by the column list.
    return (
        counts.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(
            F.max("n_r").alias("n_reference"),
            F.max("n_c").alias("n_current"),
            F.sum(chi).alias("chi_square"),
            F.sqrt(F.greatest(F.sum((divergence(p) + divergence(q)) / 2), F.lit(0.0))).alias("js_distance"),
            F.count(F.lit(1)).alias("categories"),
        )
        .withColumn("drifted", F.coalesce(F.col("js_distance") >= distance_threshold, F.lit(False)))
    )


def column_drift(
    df: DataFrame, columns: list[str], categorical: list[str] = CATEGORICAL_FEATURES, **numeric_options
) -> DataFrame:
    """(feature, kind, method, score, drifted) for all compared columns."""
    parts = []
    numbers = [c for c in columns if c not in categorical]
    names = [c for c in columns if c in categorical]
    if numbers:
        parts.append(
            numeric_drift(df, numbers, **numeric_options).select(
                "feature", F.lit("numeric").alias("kind"), "method", "score", "drifted"
            )
        )
    if names:
        parts.append(
            categorical_drift(df, names).select(
                "feature",
                F.lit("categorical").alias("kind"),
                F.lit("jensen_shannon").alias("method"),
                F.col("js_distance").alias("score"),
                "drifted",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def dataset_drift(columns: DataFrame, drift_share: float = 0.30) -> DataFrame:
    """One row: compared and drifted columns, their share, and whether it reaches the threshold."""
    share = F.try_divide(F.count_if(F.col("drifted")), F.count(F.lit(1)))
    return columns.agg(
        F.count(F.lit(1)).alias("total_features"),
        F.count_if(F.col("drifted")).alias("drifted_features"),
        F.round(share, 4).alias("drift_share"),
        (share >= drift_share).alias("dataset_drift"),
    )


def target_drift(columns: DataFrame, target: str = "target") -> DataFrame:
    """The score and flag of the target column; no row when it was not compared."""
    return columns.filter(F.col("feature") == target).select("feature", "method", "score", "drifted")


def quality_profile(df: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Per numeric column: rows, missing, distinct, mean, deviation, extremes, quartiles, share of the commonest value."""
    numbers = [nan_to_null(F.col(c).cast("double")) for c in columns]
    wide = df.agg(
        *[F.count(F.lit(1)).alias(f"n_{i}") for i in range(len(columns))],
        *[F.count_if(x.isNull()).alias(f"missing_{i}") for i, x in enumerate(numbers)],
        *[F.avg(x).alias(f"mean_{i}") for i, x in enumerate(numbers)],
        *[F.stddev_samp(x).alias(f"std_{i}") for i, x in enumerate(numbers)],
    )
    moments = unpivot_row(wide, columns, {"rows": "n", "missing": "missing", "mean": "mean", "std": "std"})
    shape = (
        ordered_counts(df, columns, {"n": F.lit(1)}, buckets)
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("distinct"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            *quantile_columns({"q25": 0.25, "q50": 0.5, "q75": 0.75}),
            (F.max("n") / F.max("total_n")).alias("top_share"),
        )
    )
    return moments.join(shape, "feature", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def regression_quality(df: DataFrame, truth: str = "target", prediction: str = "prediction") -> DataFrame:
    """Error statistics of each window."""
    return df.groupBy("window").agg(
        errors.n_samples(truth, prediction).alias("n_samples"),
        errors.mean_error(truth, prediction).alias("mean_error"),
        errors.mae(truth, prediction).alias("mae"),
        errors.rmse(truth, prediction).alias("rmse"),
        errors.mape(truth, prediction).alias("mape"),
        errors.wmape(truth, prediction).alias("wmape"),
        errors.max_abs_error(truth, prediction).alias("max_error"),
    )


def drift_summary(
    df: DataFrame,
    columns: list[str],
    drift_share: float = 0.30,
    target: str = "target",
    prediction: str | None = None,
    date: str = "target_date",
    **numeric_options,
) -> DataFrame:
    """One row of twelve fields: window bounds, drift counts and flags, target drift, WMAPE of both windows."""
    rows = evaluation_rows(df, columns)
    per_column = column_drift(rows, columns, **numeric_options)
    is_target = F.col("feature") == target
    drift = per_column.agg(
        F.struct(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("drifted")).alias("drifted"),
            F.coalesce(F.bool_or(F.when(is_target, F.col("drifted"))), F.lit(False)).alias("target_drifted"),
            F.coalesce(F.max(F.when(is_target, F.col("score"))), F.lit(0.0)).alias("target_score"),
        )
    ).scalar()

    def bound(fn, window: str) -> Column:
        return fn(F.when(F.col("window") == window, F.col(date)))

    def window_wmape(window: str) -> Column:
        if prediction is None:
            return F.lit(None).cast("double")
        y = F.when(F.col("window") == window, nan_to_null(F.col(target).cast("double")))
        p = nan_to_null(F.col(prediction).cast("double"))
        both = y.isNotNull() & p.isNotNull()
        error = F.sum(F.when(both, F.abs(y - p)))
        return 100.0 * error / (F.sum(F.when(both, F.abs(y))) + errors.EPS)

    bounds = df.agg(
        bound(F.min, "reference").alias("reference_start_date"),
        bound(F.max, "reference").alias("reference_end_date"),
        bound(F.min, "current").alias("current_start_date"),
        bound(F.max, "current").alias("current_end_date"),
        window_wmape("reference").alias("wmape_reference"),
        window_wmape("current").alias("wmape_current"),
    )
    share = F.try_divide("d.drifted", "d.total")
    return bounds.withColumn("d", drift).select(
        "reference_start_date",
        "reference_end_date",
        "current_start_date",
        "current_end_date",
        F.col("d.total").alias("total_features_evaluated"),
        F.col("d.drifted").alias("drifted_features_count"),
        F.round(share, 4).alias("share_of_drifted_features"),
        (share >= drift_share).alias("dataset_drift_detected"),
        F.col("d.target_drifted").alias("target_drift_detected"),
        F.round("d.target_score", 4).alias("target_drift_score"),
        "wmape_reference",
        "wmape_current",
    )
