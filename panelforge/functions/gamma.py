"""The gamma functions that tests of significance need, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Stirling's series for the logarithm of the gamma function.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
_SHIFT = 10
_TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for ``z > 0``: Stirling's series ten steps further on, then back."""
    far = z + _SHIFT
    series = F.lit(0.0)
    for i, c in enumerate(STIRLING):
        series += c / F.pow(far, F.lit(2 * i + 1))
    back = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(0.0), lambda s, i: s + F.ln(z + i))
    return (far - 0.5) * F.ln(far) - far + 0.5 * math.log(2 * math.pi) + series - back


def upper_gamma_share(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x), to about 1e-12.

    The power series of the lower part where ``x < a + 1``, the continued fraction of the upper part elsewhere; both run for a
    number of steps that grows with the root of ``a``.  1 for ``x <= 0``.
    """
    steps = F.sequence(F.lit(1), (F.lit(200) + 12 * F.sqrt(F.greatest(a, x))).cast("int"))
    front = F.exp(-x + a * F.ln(x) - log_gamma(a))
    term = 1.0 / a
    lower = F.aggregate(
        steps,
        F.struct(term.alias("t"), term.alias("s")),
        lambda acc, n: F.struct((acc["t"] * x / (a + n)).alias("t"), (acc["s"] + acc["t"] * x / (a + n)).alias("s")),
        lambda acc: acc["s"],
    )

    def off_zero(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def fraction(acc: Column, i: Column) -> Column:
        up = -i * (i - a)
        b = acc["b"] + 2
        d = 1.0 / off_zero(up * acc["d"] + b)
        c = off_zero(b + up / acc["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    first = 1.0 / off_zero(x + 1 - a)
    upper = F.aggregate(
        steps,
        F.struct((x + 1 - a).alias("b"), F.lit(1 / _TINY).alias("c"), first.alias("d"), first.alias("h")),
        fraction,
        lambda acc: acc["h"],
    )
    share = F.when(x <= 0, 1.0).when(x < a + 1, 1.0 - front * lower).otherwise(front * upper)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))


def chi_square_p_value(statistic: Column, degrees: Column) -> Column:
    """Probability of a chi-square value at least this large; null without degrees of freedom."""
    return F.when(degrees > 0, upper_gamma_share(degrees.cast("double") / 2, statistic.cast("double") / 2))
