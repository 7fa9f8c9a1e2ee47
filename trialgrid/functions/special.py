"""Tail probabilities for rows of test statistics (small, aggregated tables), as Series-to-Series pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if not (a > 0 and b > 0) or math.isnan(x):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 and not math.isnan(t) else math.nan


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi-squared, by the series of the lower incomplete gamma function or its continued fraction."""
    if math.isnan(x) or df <= 0:
        return math.nan
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= y / n
            total += term
        return 1 - front * total
    b, c = y + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def binom_tail(k: int, n: int) -> float:
    """P(X >= k) for n fair coins."""
    return 1.0 if k <= 0 else beta_inc(k, n - k + 1, 0.5)


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f) with df1 and df2 degrees of freedom."""
    return 1.0 if f <= 0 else beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def beta_quantile(q: float, a: float, b: float) -> float:
    """Quantile of the beta distribution, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_inc(a, b, mid) < q else (low, mid)
    return (low + high) / 2


def _column(f, n: int):
    def apply(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*map(float, row)) if not any(pd.isna(v) for v in row) else np.nan for row in zip(*series, strict=True)], dtype=float)

    if n == 2:
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return apply(a, b)
        return F.pandas_udf(two, DoubleType())

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return apply(a, b, c)
    return F.pandas_udf(three, DoubleType())


t_p = _column(t_tail, 2)
chi2_p = _column(chi2_tail, 2)
binom_p = _column(binom_tail, 2)
beta_q = _column(beta_quantile, 3)
