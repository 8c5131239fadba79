"""Tail probabilities as Arrow functions (chi-square with one degree, t, beta quantile)."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + k * d, 1.0 + k / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return front * h


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def t_two_sided(t: float, df: float) -> float:
    if not math.isfinite(t):
        return 0.0 if t in (math.inf, -math.inf) else math.nan
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def chi2_1_tail(x):
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_two_sided(float(a), float(b)) for a, b in zip(t, df)], dtype="Float64")


@F.pandas_udf(T.StructType().add("low", "double").add("high", "double"))
def binomial_interval(k: pd.Series, n: pd.Series, level: pd.Series) -> pd.DataFrame:
    """Exact (Clopper-Pearson) interval of a share."""
    out = []
    for a, b, c in zip(k, n, level):
        t = (1 - c) / 2
        out.append((0.0 if a == 0 else beta_quantile(t, a, b - a + 1), 1.0 if a == b else beta_quantile(1 - t, a + 1, b - a)))
    return pd.DataFrame(out, columns=["low", "high"], dtype=float)
