"""Forecast-error aggregates as column expressions.

Each takes the truth and the prediction and may be used in any ``agg``.  Pairs
with a missing side are left out inside the expression, so a group without any
valid pair still yields a row (NULL metrics, zero samples).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.schema import nan_to_null

EPS = 1e-8


def _pair(truth: str, prediction: str) -> tuple[Column, Column]:
    y = nan_to_null(F.col(truth).cast("double"))
    p = nan_to_null(F.col(prediction).cast("double"))
    both = y.isNotNull() & p.isNotNull()
    return F.when(both, y), F.when(both, p)


def n_samples(truth: str, prediction: str) -> Column:
    y, p = _pair(truth, prediction)
    return F.count(y - p)


def mean_error(truth: str, prediction: str) -> Column:
    y, p = _pair(truth, prediction)
    return F.avg(p - y)


def mae(truth: str, prediction: str) -> Column:
    y, p = _pair(truth, prediction)
    return F.avg(F.abs(y - p))


def rmse(truth: str, prediction: str) -> Column:
    y, p = _pair(truth, prediction)
    return F.sqrt(F.avg((y - p) * (y - p)))


def mape(truth: str, prediction: str) -> Column:
    """Mean absolute percentage error; rows with a zero truth are left out."""
    y, p = _pair(truth, prediction)
    return F.avg(F.abs(y - p) / F.nullif(y, F.lit(0.0)) * 100.0)


def max_abs_error(truth: str, prediction: str) -> Column:
    y, p = _pair(truth, prediction)
    return F.max(F.abs(y - p))


def smape(truth: str, prediction: str) -> Column:
    y, p = _pair(truth, prediction)
    return F.avg(200.0 * F.abs(y - p) / (F.abs(y) + F.abs(p) + EPS))


def wmape(truth: str, prediction: str) -> Column:
    y, p = _pair(truth, prediction)
    return 100.0 * F.sum(F.abs(y - p)) / (F.sum(F.abs(y)) + EPS)


def r2(truth: str, prediction: str) -> Column:
    """Share of variance explained.

    Fewer than two pairs give 0.  A constant truth has no variance to explain:
    1 when every error is 0, otherwise 0.
    """
    y, p = _pair(truth, prediction)
    n = F.count(y)
    sse = F.sum((y - p) * (y - p))
    total = n * F.var_pop(y)
    return (
        F.when(n == 0, F.lit(None).cast("double"))
        .when(n < 2, F.lit(0.0))
        .when(total > 0, 1.0 - sse / total)
        .otherwise(F.when(sse == 0, 1.0).otherwise(0.0))
    )


HEADLINE = {"mae": mae, "smape": smape, "wmape": wmape, "r2": r2}
HEADLINE_SCALE = {"mae": 2, "smape": 2, "wmape": 2, "r2": 4}
