"""Ranks and running totals over a family of any size.

A plain window over a family puts the whole family into one task. Here ties are collapsed first (partial aggregation),
the result is range-partitioned by (family, key) into as many ranges as the session has shuffle partitions (adaptive
execution merges small ones), ranges are summed, and only the inside of one range is windowed. The ranges are staged, so that sums and
rows see the same cut; ranks and totals are exact for any cut.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stage_table


def _ranges(df: DataFrame, family: list[str], key: str) -> DataFrame:
    """``df`` sorted by (family, key) and cut into ranges, with the number of the range."""
    cut = df.repartitionByRange(*[F.col(c) for c in (*family, key)]).sortWithinPartitions(*family, key)
    return stage_table(cut.withColumn("_range", F.spark_partition_id()))


def tie_totals(df: DataFrame, family: list[str], key: str, weights: dict[str, str] | None = None) -> DataFrame:
    """One row per (family, key): n, n_before (rows with a smaller key), n_family.

    ``weights`` maps an output name to a numeric column; each adds ``w``, ``w_before`` and
    ``w_family`` sums in the same way. Rows with a null key are left out.
    """
    weights = weights or {}
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(w) for w, c in weights.items()]
    cut = _ranges(df.filter(F.col(key).isNotNull()).groupBy(*family, key).agg(*aggs), family, key)
    names = ["n", *weights]
    before = W.partitionBy(*family).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*family)
    totals = cut.groupBy(*family, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in names]).select(
        *family, "_range",
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_off") for c in names],
        *[F.sum(f"_{c}").over(whole).alias(f"{c}_family") for c in names],
    )
    inside = W.partitionBy(*family, "_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    out = cut.join(totals, [*family, "_range"])
    for c in names:
        out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}_off"))
    return out.drop("_range", *[f"_{c}_off" for c in names])


def running_extreme(df: DataFrame, family: list[str], key: str, value: str, out: str) -> DataFrame:
    """Minimum of ``value`` over all rows of the family with the same or a larger ``key``.

    Keys must be unique inside a family (use ``tie_totals`` first).
    """
    cut = _ranges(df, family, key)
    after = W.partitionBy(*family).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    low = cut.groupBy(*family, "_range").agg(F.min(value).alias("_low")).select(*family, "_range", F.min("_low").over(after).alias("_later"))
    inside = W.partitionBy(*family, "_range").orderBy(F.desc(key)).rowsBetween(W.unboundedPreceding, 0)
    return cut.join(low, [*family, "_range"]).withColumn(out, F.least(F.min(value).over(inside), F.col("_later"))).drop("_range", "_later")


def with_rank(df: DataFrame, family: list[str], value: str, make) -> DataFrame:
    """``df`` with the columns that ``make`` derives from it per (family, value); rows without a value get nulls.

    ``df`` is staged first: both sides of the join then hold the same bits, whatever order its sums were made in. Rows
    without a value don't take part in the join, so they are no hot key.
    """
    df = stage_table(df)
    table = make(df)
    known = df.filter(F.col(value).isNotNull()).join(table, [*family, value], "left")
    return known.unionByName(df.filter(F.col(value).isNull()), allowMissingColumns=True)


def average_rank(df: DataFrame, family: list[str], value: str, out: str) -> DataFrame:
    """Average rank (ties share the mean of their positions) of every row; null stays null."""
    return with_rank(df, family, value, lambda d: tie_totals(d, family, value).select(
        *family, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(out)))


def minimum_rank(df: DataFrame, family: list[str], value: str, out: str,
                 descending: bool = True) -> DataFrame:
    """Competition rank (ties share the smallest position)."""
    pos = (F.col("n_family") - F.col("n_before") - F.col("n") + 1) if descending else F.col("n_before") + 1
    return with_rank(df, family, value, lambda d: tie_totals(d, family, value).select(*family, value, pos.cast("long").alias(out)))


def order_statistics(df: DataFrame, family: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """One row per family with the values at given 0-based positions of the sorted family.

    ``positions`` maps an output name to a Column over ``n_family``.
    """
    t = tie_totals(df, family, value)
    here = lambda p: (p >= F.col("n_before")) & (p < F.col("n_before") + F.col("n"))
    aggs = [F.max(F.when(here(p), F.col(value))).alias(k) for k, p in positions.items()]
    return t.groupBy(*family).agg(F.max("n_family").alias("n_family"), *aggs)


def family_quantiles(df: DataFrame, family: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-rule quantiles of families of any size (n_family and one column per prob)."""
    n = F.col("n_family")
    pos, out = {}, []
    for name, p in probs.items():
        h = (n - 1) * F.lit(p)
        pos[f"_{name}_lo"], pos[f"_{name}_hi"] = F.floor(h), F.ceil(h)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return order_statistics(df, family, value, pos).select(*family, "n_family", *out)


def median_of_others(df: DataFrame, family: list[str], value: str, out: str, count_out: str) -> DataFrame:
    """For every row the median of the other rows of its family, without a self join.

    Leaving one row out only shifts the positions after it, so four middle values per family and
    the row's own rank decide the answer.
    """
    df = stage_table(df)  # the join below is on values: both sides have to hold the same bits
    ranked = tie_totals(df, family, value)
    n = F.col("n_family")
    lo, hi = F.floor((n - 2) / 2), F.floor((n - 1) / 2)
    here = lambda p: (p >= F.col("n_before")) & (p < F.col("n_before") + F.col("n"))
    mid = ranked.groupBy(*family).agg(*[
        F.max(F.when(here(p), F.col(value))).alias(k)
        for k, p in (("_lo", lo), ("_lo1", lo + 1), ("_hi", hi), ("_hi1", hi + 1))])
    at = ranked.select(*family, value, "n_before", "n_family")
    known = df.filter(F.col(value).isNotNull()).join(at, [*family, value], "left")
    j = known.unionByName(df.filter(F.col(value).isNull()), allowMissingColumns=True).join(mid, family, "left")
    r = F.col("n_before")
    a = F.when(lo < r, F.col("_lo")).otherwise(F.col("_lo1"))
    b = F.when(hi < r, F.col("_hi")).otherwise(F.col("_hi1"))
    return (j.withColumn(count_out, n - 1).withColumn(out, F.when(n > 1, (a + b) / 2))
            .drop("n_before", "n_family", "_lo", "_lo1", "_hi", "_hi1"))
