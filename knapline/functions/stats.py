"""Statistics that Spark lacks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + term / (c if abs(c) > tiny else tiny)
        out *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (out - 1)


def p_value(r: float, n: float) -> float:
    """Two-sided p of a Pearson correlation of n pairs."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    free = n - 2
    return incomplete_beta(free / 2, 0.5, 1 - r * r)


def pearson_p(r: Column | str, n: Column | str) -> Column:
    """p of correlations r over n pairs; null where fewer than three."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_value(a, b) for a, b in zip(r, n, strict=True)], dtype=float)

    return F.nanvl(p(r, n), F.lit(None).cast("double"))


def both(x: Column, y: Column) -> Column:
    """Whether a pair counts: neither null nor NaN."""
    return x.isNotNull() & y.isNotNull() & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double"))
