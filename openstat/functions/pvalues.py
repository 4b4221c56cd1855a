"""Tail probabilities, one value per test result (never per data row).

Spark has no Student-t or chi-square distribution function. Both reduce to the
regularized incomplete beta and gamma functions, evaluated in log space so that
p underflows to zero only where a double cannot hold it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_EPS = 1e-15


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    total = d
    for m in range(1, 20_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + step / c
            c = c if abs(c) > _TINY else _TINY
            total *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return total


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with df degrees of freedom."""
    if math.isnan(t) or not df > 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    if df > 1e8:
        return math.erfc(abs(t) / math.sqrt(2.0))
    a, b = df / 2.0, 0.5
    x = df / (df + t * t)
    y = t * t / (df + t * t)
    if y == 0.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        - a * math.log1p(t * t / df) + b * math.log(y)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front + math.log(_beta_fraction(a, b, x)) - math.log(a))
    return max(0.0, 1.0 - math.exp(log_front) * _beta_fraction(b, a, y) / b)


def chi2_upper(x: float, df: float) -> float:
    """P(X >= x) for chi-square with df degrees of freedom."""
    if math.isnan(x) or not df > 0:
        return float("nan")
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    log_front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1.0
            term *= z / k
            total += term
        return max(0.0, 1.0 - math.exp(log_front + math.log(total)))
    b = z + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    total = d
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + step / c
        c = c if abs(c) > _TINY else _TINY
        total *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return math.exp(log_front + math.log(total))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_upper(float(a), float(b)) for a, b in zip(x, df)], dtype="float64")
