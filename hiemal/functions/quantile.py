"""Quantiles of a sorted array column under the three rules in use."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _interpolate(a: Column, h: Column) -> Column:
    """Linear interpolation at 1-based fractional position h, clamped to the ends."""
    n = F.size(a)
    hc = F.greatest(F.lit(1.0), F.least(h, n.cast("double")))
    lo = F.floor(hc).cast("int")
    hi = F.least(lo + 1, n)
    x = F.get(a, lo - 1)
    return F.when(n > 0, x + (hc - lo) * (F.get(a, hi - 1) - x))


def median_unbiased(a: Column, p: float) -> Column:
    """Hyndman-Fan type 8 on an ascending array."""
    n = F.size(a).cast("double")
    third = 1.0 / 3.0
    return _interpolate(a, (n + F.lit(third)) * F.lit(p) + F.lit(third))


def linear(a: Column, p: float) -> Column:
    """Type 7 on an ascending array (the default of most numeric libraries)."""
    n = F.size(a).cast("double")
    return _interpolate(a, (n - 1) * F.lit(p) + 1)


def median(a: Column) -> Column:
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int"))
                          + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once. Spark doesn't share what a lambda repeats: an expression in one is worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mad(a: Column, centre: Column) -> Column:
    """Median absolute deviation of an array about ``centre``."""
    return bound(centre, lambda c: bound(F.array_sort(F.transform(a, lambda x: F.abs(x - c))), median))
