"""Exact cumulative distributions without a single-task sort.

Distinct values are counted per column first, so a value that holds a third of
all rows is one row.  Columns are then cut into buckets at approximate
quantiles.  Each bucket is ordered on its own, and bucket totals (columns x
buckets rows) give every bucket its offset.  The cut points only balance the
work: any cuts give the same exact counts.  They are fitted once and enter the
plan as constants, so a retried task sees the same buckets.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.schema import nan_to_null

#: Rows a bucket holds at most before more buckets are cut, and the most cuts fitted.  Both set the number of
#: tasks only: results are exact for any buckets.
ROWS_PER_BUCKET = 1_000_000
MOST_BUCKETS = 4096


def bucket_count(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // ROWS_PER_BUCKET)))


def _with_buckets(df: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    probabilities = [i / buckets for i in range(1, buckets)]
    fitted = df.approxQuantile(columns, probabilities, 1.0 / (2 * buckets)) if buckets > 1 else [[] for _ in columns]
    splits = []
    for cuts in fitted:
        inner = sorted({c for c in cuts if math.isfinite(c)}) or [0.0]
        splits.append([-math.inf, *inner, math.inf])
    bucketizer = Bucketizer(
        splitsArray=splits,
        inputCols=columns,
        outputCols=[f"_bucket_{i}" for i in range(len(columns))],
        handleInvalid="keep",
    )
    return bucketizer.transform(df)


def ordered_counts(
    df: DataFrame, columns: list[str], weights: dict[str, Column], buckets: int | None = None
) -> DataFrame:
    """Per column and distinct value: counts and cumulative counts.

    ``buckets`` follows from the number of rows where it is not given.  ``weights`` are 0/1 (or integer) expressions over ``df``, summed per value.
    Result: (feature, value, next_value, and per weight w: w, cum_w, total_w).
    """
    clean = df.select(
        *[nan_to_null(F.col(c).cast("double")).alias(f"_v_{i}") for i, c in enumerate(columns)],
        *[w.alias(name) for name, w in weights.items()],
    )
    values = [f"_v_{i}" for i in range(len(columns))]
    buckets = buckets or bucket_count(df.count())
    bucketed = _with_buckets(clean, values, buckets)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"_bucket_{i}").cast("int").alias("bucket"),
                F.col(f"_v_{i}").alias("value"),
            )
            for i, c in enumerate(columns)
        ]
    )
    counts = (
        bucketed.select(*weights, F.explode(entries).alias("e"))
        .select("e.*", *weights)
        # Both tests, so that both consumers below plan the same shuffle and Spark runs it once.
        .filter("value is not null and bucket is not null")
        .groupBy("feature", "bucket", "value")
        .agg(*[F.sum(name).alias(name) for name in weights])
    )
    in_feature = Window.partitionBy("feature").orderBy("bucket")
    whole = Window.partitionBy("feature")
    totals = (
        counts.groupBy("feature", "bucket")
        .agg(F.min("value").alias("_low"), *[F.sum(name).alias(name) for name in weights])
        .select(
            "feature",
            "bucket",
            F.lead("_low").over(in_feature).alias("_next_low"),
            *[
                (F.sum(name).over(in_feature.rowsBetween(Window.unboundedPreceding, 0)) - F.col(name)).alias(f"_before_{name}")
                for name in weights
            ],
            *[F.sum(name).over(whole).alias(f"total_{name}") for name in weights],
        )
    )
    in_bucket = Window.partitionBy("feature", "bucket").orderBy("value")
    local = counts.select(
        "feature",
        "bucket",
        "value",
        *weights,
        F.lead("value").over(in_bucket).alias("_next"),
        *[
            F.sum(name).over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_local_{name}")
            for name in weights
        ],
    )
    # At most columns x (buckets + 1) rows: the size of this side is bounded by MOST_BUCKETS.
    return local.join(F.broadcast(totals), ["feature", "bucket"]).select(
        "feature",
        "value",
        F.coalesce("_next", "_next_low").alias("next_value"),
        *weights,
        *[(F.col(f"_before_{name}") + F.col(f"_local_{name}")).alias(f"cum_{name}") for name in weights],
        *[f"total_{name}" for name in weights],
    )


def quantile_columns(probabilities: dict[str, float]) -> list[Column]:
    """Aggregates over ``ordered_counts`` with weight ``n``: linear-interpolated exact quantiles."""
    out = []
    for name, q in probabilities.items():
        place = (F.col("total_n") - 1) * F.lit(float(q))
        low, high = F.floor(place), F.ceil(place)

        def at(rank: Column) -> Column:
            inside = (rank < F.col("cum_n")) & (rank >= F.col("cum_n") - F.col("n"))
            return F.max(F.when(inside, F.col("value")))

        share = F.max(place - low)
        out.append((at(low) + (at(high) - at(low)) * share).alias(name))
    return out


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: dict[str, float], buckets: int | None = None
) -> DataFrame:
    """(feature, one column per quantile)."""
    counts = ordered_counts(df, columns, {"n": F.lit(1)}, buckets)
    return counts.groupBy("feature").agg(*quantile_columns(probabilities))


def unpivot_row(row: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """One wide row of ``<field>_<i>`` aggregates as one row per column."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(f"{prefix}_{i}").alias(name) for name, prefix in fields.items()])
            for i, c in enumerate(columns)
        ]
    )
    return row.select(F.inline(entries))
