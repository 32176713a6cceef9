"""Chronological splits, walk-forward folds and monitoring windows.

Cut dates come from the sorted distinct dates, a list bounded by the calendar.
They enter the plan as a scalar subquery, so rows are labelled by comparing
their date with a constant: no join and no ranking of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "target_date"


def _dates(df: DataFrame, column: str) -> DataFrame:
    """One row: ``dates``, the sorted distinct dates, and their number ``n``."""
    distinct = df.select(F.to_date(column).alias("d")).filter("d is not null").distinct()
    listed = distinct.agg(F.sort_array(F.collect_list("d")).alias("dates"))
    return listed.withColumn("n", F.size("dates"))


def _require(condition: Column, message: Column | str, value: Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, value).otherwise(F.raise_error(text).cast("date"))


def _whole(number: Column) -> Column:
    """Truncation of a double, as ``int()`` does for positive numbers."""
    return F.floor(number).cast("int")


# ------------------------------------------------------------------ three-way split


def split_dates(df: DataFrame, train_frac: float = 0.70, val_frac: float = 0.15, column: str = DATE) -> DataFrame:
    """One row: last train date and last validation date."""
    n = F.col("n").cast("double")
    enough = F.col("n") >= 10
    message = F.format_string("not enough dates for a three-way split: %d", F.col("n"))
    train_end = F.try_element_at("dates", F.greatest(_whole(n * F.lit(train_frac)), F.lit(1)))
    val_end = F.try_element_at("dates", F.greatest(_whole(n * F.lit(train_frac + val_frac)), F.lit(1)))
    return _dates(df, column).select(
        _require(enough, message, train_end).alias("train_end"),
        _require(enough, message, val_end).alias("val_end"),
        F.col("n").alias("n_dates"),
    )


def _label(day: Column, cuts: Column) -> Column:
    return F.when(day <= cuts["train_end"], "train").when(day <= cuts["val_end"], "val").otherwise("test")


def split_time_series(
    df: DataFrame,
    train_frac: float = 0.70,
    val_frac: float = 0.15,
    column: str = DATE,
    dates_from: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: train, val or test, in order of date.

    ``dates_from`` may name a cheaper table with the same dates.
    """
    source = df if dates_from is None else dates_from
    cuts = split_dates(source, train_frac, val_frac, column).select(F.struct("train_end", "val_end")).scalar()
    return df.withColumn("split", _label(F.to_date(column), cuts))


def split_profile(df: DataFrame, column: str = DATE) -> DataFrame:
    """Rows and date range of each split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(column).alias("first_date"),
        F.max(column).alias("last_date"),
    )


def split_is_clean(df: DataFrame, column: str = DATE) -> DataFrame:
    """One row: does every split end before the next one begins?"""

    def bound(fn, split):
        return fn(F.when(F.col("split") == split, F.col(column)))

    train_before = bound(F.max, "train") < bound(F.min, "val")
    val_before = bound(F.max, "val") < bound(F.min, "test")
    return df.agg(F.coalesce(train_before & val_before, F.lit(False)).alias("clean"))


def train_and_validation(df: DataFrame) -> DataFrame:
    """Rows open to tuning; the test split stays out."""
    return df.filter(F.col("split").isin("train", "val"))


def split_nearest_quantile(
    df: DataFrame, train_q: float = 0.70, val_q: float = 0.85, column: str = "period"
) -> DataFrame:
    """Add ``split`` with cuts at the dates nearest to two quantiles of the distinct dates."""

    def nearest(q: float) -> Column:
        place = F.bround((F.col("n").cast("double") - 1) * F.lit(q), 0).cast("int")
        return F.try_element_at("dates", place + 1)

    cuts = _dates(df, column).select(
        F.struct(nearest(train_q).alias("train_end"), nearest(val_q).alias("val_end"))
    )
    return df.withColumn("split", _label(F.to_date(column), cuts.scalar()))


# ------------------------------------------------------------------ walk-forward folds


def walk_forward_folds(
    df: DataFrame, n_splits: int = 3, min_train_frac: float = 0.50, column: str = DATE
) -> DataFrame:
    """One row per fold: ``fold``, ``train_end``, ``val_start``, ``val_end``.

    Training windows grow; the last validation window takes the remainder.
    """
    n = F.col("n")
    initial = F.greatest(_whole(n.cast("double") * F.lit(min_train_frac)), F.lit(2))
    rest = n - initial
    message = (
        F.when(n == 0, F.lit("cannot build folds on an empty table"))
        .when(n < 6, F.format_string("not enough dates for folds: %d", n))
        .when(rest < n_splits, F.format_string("%d dates left for folds", rest))
    )
    size = F.floor(rest / F.lit(n_splits)).cast("int")
    fold = F.col("fold")
    train_n = F.col("initial") + fold * F.col("size")
    val_n = F.when(fold < n_splits - 1, train_n + F.col("size")).otherwise(n)
    dates = _dates(df, column).select(
        F.when(message.isNull(), F.col("dates")).otherwise(F.raise_error(message).cast("array<date>")).alias("dates"),
        "n",
        initial.alias("initial"),
        size.alias("size"),
    )
    return (
        dates.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
        .select(
            "fold",
            F.try_element_at("dates", train_n).alias("train_end"),
            F.try_element_at("dates", train_n + 1).alias("val_start"),
            F.try_element_at("dates", val_n).alias("val_end"),
        )
    )


def assign_folds(
    df: DataFrame, n_splits: int = 3, min_train_frac: float = 0.50, column: str = DATE
) -> DataFrame:
    """Each row once per fold it belongs to, with ``fold`` and ``role`` (train or val).

    The folds are an array constant, so rows are repeated in place by a
    projection instead of a range join.
    """
    columns = df.columns
    folds = walk_forward_folds(df, n_splits, min_train_frac, column)
    array = folds.agg(
        F.sort_array(F.collect_list(F.struct("fold", "train_end", "val_start", "val_end"))).alias("folds")
    ).scalar()
    day = F.to_date(column)

    def role(f: Column) -> Column:
        return F.when(day <= f["train_end"], "train").when(day.between(f["val_start"], f["val_end"]), "val")

    roles = F.transform("_folds", lambda f: F.struct(f["fold"].alias("fold"), role(f).alias("role")))
    member = F.filter(roles, lambda r: r["role"].isNotNull())
    return (
        df.withColumn("_folds", array)
        .select(*columns, F.explode(member).alias("_m"))
        .select(*columns, "_m.fold", "_m.role")
    )


# ------------------------------------------------------------------ monitoring windows


def monitoring_windows(
    df: DataFrame, reference_days: int = 90, current_days: int = 30, column: str = DATE
) -> DataFrame:
    """Rows of the reference and the current window, labelled in ``window``.

    The current window holds the last day and ``current_days`` before it; the
    reference window ends the day before.  Too few dates or an empty window
    fail the query.
    """
    dates = F.col("dates")
    last = F.try_element_at("dates", F.lit(-1))
    split = F.date_sub(last, current_days)
    start = F.date_sub(split, reference_days)
    needed = (reference_days + current_days) // 3
    has_reference = F.exists(dates, lambda d: (d >= start) & (d < split))
    message = (
        F.when(F.col("n") == 0, F.lit("no dates to monitor"))
        .when(F.col("n") < needed, F.format_string("not enough dates for monitoring: %d", F.col("n")))
        .when(~has_reference, F.lit("the reference window is empty"))
    )
    bounds = _dates(df, column).select(
        F.struct(
            _require(message.isNull(), message, split).alias("split"),
            start.alias("start"),
        )
    ).scalar()
    day = F.to_date(column)
    # The label is computed once and filtered on, so a failed check always surfaces.
    window = F.when(day >= bounds["split"], "current").when(day >= bounds["start"], "reference")
    return df.withColumn("window", window).filter("window is not null")
