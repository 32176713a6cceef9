"""Distributions from mergeable sketches: one scan, and only sketches are shuffled.

A table of sketches holds one row per group and column: a KLL quantile sketch, a HyperLogLog sketch of the distinct values, and count,
missing, mean, squared deviations, smallest and largest value.  Everything in it can be merged, so sketches are made once per window
and day, stored, and joined to any longer span without reading the rows again.  The exact path stays in ``distribution``.

Counts, means, deviations and extremes are exact.  Ranks are off by at most :func:`rank_error` of all values with 99 % probability each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators.drift import _ks_p_value
from panelforge.schema import nan_to_null

#: Size of a quantile sketch, and the ranks at which two of them are compared.
K, RANKS = 4096, 1000


def rank_error(k: int = K) -> float:
    """Error of a rank from a KLL sketch of this size, single-sided, with 99 % probability."""
    return 2.296 / k**0.9723


def column_sketches(df: DataFrame, columns: list[str], by: list[str], k: int = K) -> DataFrame:
    """One row per group and column: ``by``, ``feature``, ``n`` (present), ``missing``, ``mean``, ``m2``, ``low``, ``high``, ``quantiles``, ``distinct``.

    One aggregate over the rows of ``df``; NaN counts as missing.
    """
    aggregates = []
    for i, name in enumerate(columns):
        x = nan_to_null(F.col(name).cast("double"))
        aggregates += [
            F.count(x).alias(f"n_{i}"),
            F.count_if(x.isNull()).alias(f"missing_{i}"),
            F.avg(x).alias(f"mean_{i}"),
            (F.var_pop(x) * F.count(x)).alias(f"m2_{i}"),
            F.min(x).alias(f"low_{i}"),
            F.max(x).alias(f"high_{i}"),
            F.kll_sketch_agg_double(x, k).alias(f"quantiles_{i}"),
            # Minus zero and zero are one value.
            F.hll_sketch_agg((x + 0.0).cast("string"), 14).alias(f"distinct_{i}"),
        ]
    fields = ["n", "missing", "mean", "m2", "low", "high", "quantiles", "distinct"]
    entries = F.array(
        *[F.struct(F.lit(c).alias("feature"), *[F.col(f"{f}_{i}").alias(f) for f in fields]) for i, c in enumerate(columns)]
    )
    return df.groupBy(*by).agg(*aggregates).select(*by, F.inline(entries))


def merge_sketches(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """The same table for a coarser grouping; ``by`` may be empty."""
    parts = F.collect_list(F.struct("n", "mean", "m2"))

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        step = b["mean"] - a["mean"]
        mean = a["mean"] + step * b["n"] / n
        m2 = a["m2"] + b["m2"] + step * step * a["n"] * b["n"] / n
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2")))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("m2"))
    merged = sketches.groupBy(*by, "feature").agg(
        F.aggregate(F.sort_array(parts), none, add).alias("s"),
        F.sum("missing").alias("missing"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles", k).alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )
    return merged.select(*by, "feature", "s.n", "missing", "s.mean", "s.m2", "low", "high", "quantiles", "distinct")


def write_sketches(sketches: DataFrame, path: str, day: str) -> None:
    """Store sketches by day; days written again are replaced."""
    writer = sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(day).parquet(path)


def read_sketches(spark: SparkSession, path: str, day: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored sketches of the days from ``first`` to ``last``; other days are not read."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col(day) >= F.lit(first).cast("date"))
    if last is not None:
        df = df.filter(F.col(day) <= F.lit(last).cast("date"))
    return df


def _at(sketch: str, ranks: list[float]) -> Column:
    """Quantiles at the ranks; null for an empty sketch."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, ranks))))


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """Per row of a sketch table: rows, missing, mean, std, distinct (estimated), min, quartiles, max and ``rank_error``."""
    quartiles = _at("quantiles", [0.25, 0.5, 0.75])
    std = F.sqrt(F.col("m2") / (F.col("n") - 1))
    return sketches.withColumn("q", quartiles).select(
        *[c for c in sketches.columns if c not in ("n", "missing", "mean", "m2", "low", "high", "quantiles", "distinct")],
        (F.col("n") + F.col("missing")).alias("rows"),
        "missing",
        "mean",
        F.when(F.col("n") > 1, std).alias("std"),
        F.hll_sketch_estimate("distinct").alias("distinct"),
        F.col("low").alias("min"),
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"),
        F.col("high").alias("max"),
        F.lit(rank_error()).alias("rank_error"),
    )


def sketched_drift(
    sketches: DataFrame, p_threshold: float = 0.05, distance_threshold: float = 0.1, method: str = "ks"
) -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein statistics of both windows per column, from one sketch per window and column.

    The columns of ``drift.numeric_drift``, and ``ks_error``: how far the statistic may be off (both rank errors and the
    spacing of the ranks).  The Wasserstein distance is off by at most as much times the range of the values.
    Work and memory hang on columns and ranks only.
    """
    if method not in ("wasserstein", "ks"):
        raise ValueError("method is 'wasserstein' or 'ks'")
    ranks = [(i + 0.5) / RANKS for i in range(RANKS)]
    read = sketches.withColumn("q", _at("quantiles", ranks))

    def of(window: str, column: str) -> Column:
        return F.max(F.when(F.col("window") == window, F.col(column)))

    both = read.groupBy("feature").agg(
        F.coalesce(of("reference", "n"), F.lit(0)).alias("n_reference"),
        F.coalesce(of("current", "n"), F.lit(0)).alias("n_current"),
        of("reference", "m2").alias("m2"),
        F.max(F.when(F.col("window") == "reference", F.struct("q"))).getField("q").alias("r"),
        F.max(F.when(F.col("window") == "current", F.struct("q"))).getField("q").alias("c"),
    )
    gaps = F.zip_with("r", "c", lambda a, b: F.abs(a - b))
    both = both.withColumn("wasserstein", F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / RANKS)
    # Both step functions side by side: 2 x RANKS points per column.
    points = both.filter("r is not null and c is not null").select(
        "feature",
        F.explode(
            F.concat(
                F.transform("r", lambda v: F.struct(v.alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c"))),
                F.transform("c", lambda v: F.struct(v.alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c"))),
            )
        ).alias("p"),
    )
    # Points of equal value are one step.
    upto = Window.partitionBy("feature").orderBy("p.v").rangeBetween(Window.unboundedPreceding, 0)
    curve = points.select("feature", (F.sum("p.r").over(upto) - F.sum("p.c").over(upto)).alias("gap"))
    ks = curve.groupBy("feature").agg((F.max(F.abs("gap")) / RANKS).alias("ks_statistic"))
    out = both.join(ks, "feature", "left")
    spread = F.greatest(F.sqrt(F.col("m2") / F.col("n_reference")), F.lit(0.001))
    out = out.withColumns(
        {
            "p_value": _ks_p_value(F.col("ks_statistic"), F.col("n_reference").cast("double"), F.col("n_current").cast("double")),
            "wasserstein_norm": F.col("wasserstein") / spread,
        }
    )
    flags = {
        "ks_drifted": F.coalesce(F.col("p_value") < p_threshold, F.lit(False)),
        "distance_drifted": F.coalesce(F.col("wasserstein_norm") >= distance_threshold, F.lit(False)),
    }
    return out.select(
        "feature",
        "n_reference",
        "n_current",
        "ks_statistic",
        "p_value",
        "wasserstein",
        "wasserstein_norm",
        F.lit(method).alias("method"),
        F.col("p_value" if method == "ks" else "wasserstein_norm").alias("score"),
        *(flag.alias(name) for name, flag in flags.items()),
        flags["ks_drifted" if method == "ks" else "distance_drifted"].alias("drifted"),
        F.lit(2 * rank_error() + 2 / RANKS).alias("ks_error"),
    )
