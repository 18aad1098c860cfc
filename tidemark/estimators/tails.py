"""Tail probabilities. Spark has no erf or gamma functions; these run on result rows, one per estimate."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if pd.notna(v) else None).astype("float64")


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h / a


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student p-value."""
    return pd.Series([
        incomplete_beta(n / (n + v * v), n / 2.0, 0.5) if pd.notna(v) and pd.notna(n) and n > 0 else None for v, n in zip(t, df)
    ], dtype="float64")


@F.pandas_udf(DoubleType())
def binomial_upper(successes: pd.Series, n: pd.Series, p0: pd.Series) -> pd.Series:
    """P(X >= successes) for X ~ Binomial(n, p0); constant work whatever n is."""
    return pd.Series([
        None if pd.isna(k) or m <= 0 else (1.0 if k <= 0 else incomplete_beta(p, float(k), float(m - k + 1)))
        for k, m, p in zip(successes, n, p0)
    ], dtype="float64")
