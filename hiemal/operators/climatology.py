"""Calendar climatologies, anomalies, percentile thresholds and short time filters.

A circular calendar window of +-h days would multiply the base rows by 2h+1 if every row were
copied to its neighbouring days. Instead each series is packed once into its calendar (bounded by
calendar slots times years) and the windows are read row-locally.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..plans.single import attach
from . import calendar_kernels as ck


def _series(batch: pa.RecordBatch, entry: str):
    """For each row of a batch its number and the columns of its packed entries."""
    packed = batch.column(batch.schema.get_field_index(entry))
    ends, flat = packed.offsets.to_numpy(), packed.values
    columns = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]
    return [(i, [c[ends[i]:ends[i + 1]] for c in columns]) for i in range(batch.num_rows)]


def _sampled(base: DataFrame, keys: list[str], value: str, slot: str, half: int, period: int, year: str, columns: str,
             make: Callable[[ck.Samples], list[tuple]]) -> DataFrame:
    """(keys, ``columns``): what ``make`` gives of the ordered samples of every slot, pooled over +-half slots.

    The years of a series are packed into one row, at most its calendar; its windows are read from the row.
    """
    x, here = F.col(value).cast("double"), F.col(slot).between(1, period)
    e = base.filter(x.isNotNull() & here).select(*keys, F.struct(F.col(slot).cast("int").alias("k"), x.alias("x"), F.coalesce(F.col(year).cast("int"), F.lit(-1)).alias("y")).alias("_e"))
    packed = e.groupBy(*keys).agg(F.collect_list("_e").alias("_e"))
    kept = [packed.schema[k] for k in keys]
    schema = T.StructType(kept + list(T.StructType.fromDDL(columns).fields))

    def run(batches):
        for batch in batches:
            head = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))], names=keys)
            ready, size = [], 0
            for i, (k, x, y) in _series(batch, "_e"):
                for samples in ck.pooled(k, x, y, half, period):
                    for part in make(samples):
                        ready.append((i, part))
                        size += len(part[0])
                if size > 20_000:
                    yield _rows(head, ready)
                    ready, size = [], 0
            if ready:
                yield _rows(head, ready)

    def _rows(head, ready):
        owner = np.repeat([i for i, _ in ready], [len(p[0]) for _, p in ready])
        out = list(head.take(pa.array(owner)).columns)
        for j, t in enumerate(types):
            v = np.ma.concatenate([p[j] for _, p in ready])
            out.append(pa.array(v.data, t, mask=np.ma.getmaskarray(v)))
        return pa.RecordBatch.from_arrays(out, names=names)

    names = schema.names
    types = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.float64() for f in schema.fields[len(keys):]]
    return packed.mapInArrow(run, schema)


def pooled_moments(base: DataFrame, keys: list[str], value: str, slot: str, half: int, period: int = 365) -> DataFrame:
    """(keys, slot, n, mean, sd): moments of all values within +-half slots, pooled not averaged.

    Each slot holds its count, sum and sum of squared departures from its mean; those of a window are merged pairwise, so a large mean costs no digit
    of the deviation.
    """
    x = F.col(value).cast("double")
    by_slot = base.filter(x.isNotNull() & F.col(slot).between(1, period)).groupBy(*keys, slot).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("s"), (F.var_pop(x) * F.count(F.lit(1))).alias("q"))
    packed = by_slot.groupBy(*keys).agg(F.collect_list(F.struct(F.col(slot).cast("int").alias("k"), "n", "s", "q")).alias("_e"))
    kind = base.schema[slot].dataType
    schema = T.StructType([packed.schema[k] for k in keys]).add(slot, "integer").add("n", "long").add("mean", "double").add("sd", "double")

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                batch = whole.slice(first, 64)
                cal = np.zeros((3, batch.num_rows, period))
                for i, (k, *v) in _series(batch, "_e"):
                    cal[:, i, k - 1] = v
                n, s, q = ck.merged_moments(*cal, half)
                owner, at = np.nonzero(n)
                n, s, q = n[owner, at], s[owner, at], q[owner, at]
                with np.errstate(divide="ignore", invalid="ignore"):
                    sd = pa.array(np.sqrt(q / (n - 1)), pa.float64(), mask=n <= 1)
                head = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))], names=keys).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([*head.columns, pa.array(at + 1, pa.int32()), pa.array(n, pa.int64()), pa.array(s / n), sd], names=names)

    names = schema.names
    return packed.mapInArrow(run, schema).withColumn(slot, F.col(slot).cast(kind))


def calendar_anomaly(df: DataFrame, keys: list[str], value: str, slot: str, half: int, baseline: Column | str,
                     period: int = 365, scale: bool = False) -> DataFrame:
    """Departure from the pooled calendar-day mean of the baseline (z-score if ``scale``)."""
    clim = pooled_moments(df.filter(baseline), keys, value, slot, half, period)
    j = df.join(clim, [*keys, slot], "left")
    dep = F.col(value) - F.col("mean")
    return j.withColumn("anomaly", dep / F.when(F.col("sd") != 0, F.col("sd")) if scale else dep).withColumnsRenamed(
        {"mean": "clim_mean", "sd": "clim_sd", "n": "clim_n"})


def robust_calendar(base: DataFrame, keys: list[str], value: str, slot: str, half: int = 15, min_years: int = 1,
                    min_obs: int = 1, min_scale: float = 0.5, year: str = "year") -> DataFrame:
    """Pooled median, MAD, robust scale, p01 and p99 per calendar day."""
    b = base.filter(F.col(value).isNotNull())
    years = b.groupBy(*keys, year).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("clim_years")).filter(F.col("clim_years") >= min_years)

    def make(d):
        m = d.median()
        mad = d.departures(m).median()
        enough = d.n >= min_obs
        return [tuple(v[enough] for v in (d.slots, d.n, m, mad, np.maximum(1.4826 * mad, min_scale), d.linear(0.01), d.linear(0.99)))]

    s = _sampled(b, keys, value, slot, half, 366, year, f"{slot} int, clim_n int, clim_median double, clim_mad double, clim_scale double, clim_p01 double, clim_p99 double", make)
    return s.join(years, keys).select(*keys, slot, "clim_n", "clim_years", "clim_median", "clim_mad", "clim_scale", "clim_p01", "clim_p99")


def month_day_climatology(df: DataFrame, keys: list[str], value: str, month_day: str, baseline: Column | str | None = None,
                          quantiles: bool = False) -> DataFrame:
    """Mean, sample SD, count (and p75, p90) per month-day without a window."""
    b = df.filter(baseline) if baseline is not None else df
    aggs = [F.avg(value).alias("clim_mean"), F.stddev_samp(value).alias("clim_sd"), F.count(value).alias("clim_n")]
    if quantiles:
        aggs += [F.percentile(value, 0.75).alias("clim_p75"), F.percentile(value, 0.9).alias("clim_p90")]
    return b.groupBy(*keys, month_day).agg(*aggs)


def standardise(df: DataFrame, clim: DataFrame, on: list[str], value: str) -> DataFrame:
    """anomaly and zscore against a climatology; a zero or missing SD gives a null z-score."""
    j = df.join(clim, on, "left")
    dep = F.col(value) - F.col("clim_mean")
    return j.withColumn("anomaly", dep).withColumn("zscore", dep / F.when(F.col("clim_sd") != 0, F.col("clim_sd")))


# ---------------------------------------------------------------- percentile thresholds
# fixed values: threshold percentiles
LEVELS = {"p05": 0.05, "p10": 0.10, "p20": 0.20}


def calendar_thresholds(base: DataFrame, keys: list[str], value: str, slot: str, half: int = 2, levels=None,
                        min_obs: int = 1, min_years: int = 1, year: str = "year") -> DataFrame:
    """Median-unbiased calendar quantiles with observation and year counts."""
    levels = levels or LEVELS

    def make(d):
        ny = d.years()
        enough = (d.n >= min_obs) & (ny >= min_years)
        return [(d.slots, d.n, ny, *[np.ma.array(d.median_unbiased(p), mask=~enough) for p in levels.values()])]

    return _sampled(base, keys, value, slot, half, 366, year, ", ".join([f"{slot} int", "observation_count int", "year_count int", *[f"{k} double" for k in levels]]), make)


def leave_year_out_thresholds(base: DataFrame, keys: list[str], value: str, slot: str, p: float, first: int, last: int,
                              half: int = 2, min_obs: int = 1, min_years: int = 1, year: str = "year") -> DataFrame:
    """The same quantile with one calendar year left out, for every baseline year."""
    def make(d):
        out = []
        for y in range(first, last + 1):
            kept = d.without(y)
            ny = kept.years()
            enough = (kept.n >= min_obs) & (ny >= min_years) & (kept.n > 0)
            out.append((d.slots, np.full(len(d.n), y), kept.n, ny, np.ma.array(kept.median_unbiased(p), mask=~enough)))
        return out

    return _sampled(base, keys, value, slot, half, 366, year, f"{slot} int, excluded_year int, loo_observation_count int, loo_year_count int, loo_threshold double", make)


def assign_threshold(df: DataFrame, full: DataFrame, loo: DataFrame, keys: list[str], slot: str, column: str, first: int,
                     last: int, year: str = "year") -> DataFrame:
    """Baseline dates take the threshold that leaves out their own year, other dates the full one."""
    f = full.select(*keys, slot, F.col(column).alias("_full"))
    o = loo.select(*keys, slot, F.col("excluded_year").alias(year), F.col("loo_threshold").alias("_loo"))
    inside = F.col(year).between(first, last)
    return (df.join(f, [*keys, slot], "left").join(o, [*keys, slot, year], "left")
            .withColumn("threshold", F.when(inside, F.col("_loo")).otherwise(F.col("_full")))
            .withColumn("threshold_source", F.when(inside, "leave_year_out").otherwise("full_baseline"))
            .drop("_full", "_loo"))


def cold_flag(value: Column, threshold: Column, eligible: Column | None = None) -> Column:
    """Strictly below the threshold; false (not null) where either is missing."""
    c = F.coalesce(value < threshold, F.lit(False))
    return c if eligible is None else c & F.coalesce(eligible, F.lit(False))


def unordered_thresholds(thresholds: DataFrame) -> DataFrame:
    """Rows that break p05 <= p10 <= p20."""
    return thresholds.filter((F.col("p05") > F.col("p10")) | (F.col("p10") > F.col("p20")))


def compound_flags(df: DataFrame, a: str, b: str) -> DataFrame:
    """Set algebra of two day flags plus the exactly-one-class check."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    out = (df.withColumn("both", x & y).withColumn("either", x | y).withColumn("only_a", x & ~y)
           .withColumn("only_b", ~x & y).withColumn("neither", ~x & ~y))
    one = sum((F.col(c).cast("int") for c in ("both", "only_a", "only_b", "neither")), F.lit(0)) == 1
    return out.withColumn("exactly_one", one)


def deficit(value: Column, reference: Column, flag: Column) -> Column:
    return F.when(flag, reference - value)


# ---------------------------------------------------------------- time filters
def _day(date: str) -> Column:
    return F.unix_date(F.col(date))


def tendency(df: DataFrame, keys: list[str], date: str, value: str, out: str, positional: bool = False) -> DataFrame:
    """Change since the previous row; only across consecutive dates unless ``positional``."""
    w = W.partitionBy(*keys).orderBy(date)
    step = F.col(value) - F.lag(value).over(w)
    if not positional:
        step = F.when(F.datediff(F.col(date), F.lag(date).over(w)) == 1, step)
    return df.withColumn(out, step)


def lagged(df: DataFrame, keys: list[str], date: str, value: str, days: int, out: str) -> DataFrame:
    """Value exactly ``days`` earlier on the calendar (a range frame; no gap filling needed)."""
    w = W.partitionBy(*keys).orderBy(_day(date)).rangeBetween(-days, -days)
    return df.withColumn(out, F.max(value).over(w))


def trailing_mean(df: DataFrame, keys: list[str], date: str, value: str, days: int, out: str, until: int = 0) -> DataFrame:
    """Mean over ``days`` calendar days that end ``until`` days before the row; all must be present."""
    w = W.partitionBy(*keys).orderBy(_day(date)).rangeBetween(-(days + until - 1), -until)
    return df.withColumn(out, F.when(F.count(value).over(w) == days, F.avg(value).over(w)))


def centred_mean(df: DataFrame, keys: list[str], date: str, value: str, half: int, out: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(_day(date)).rangeBetween(-half, half)
    return df.withColumn(out, F.when(F.count(value).over(w) == 2 * half + 1, F.avg(value).over(w)))


def detrend(df: DataFrame, keys: list[str], date: str, values: list[str]) -> DataFrame:
    """Subtract the least-squares line over elapsed days from each column.

    Slopes come from one aggregate per key; the line passes through the mean point, so the
    column is also centred.
    """
    t = _day(date).cast("double")
    aggs = []
    for c in values:
        aggs += [F.regr_slope(F.col(c), t).alias(f"_{c}_b"), F.regr_intercept(F.col(c), t).alias(f"_{c}_a")]
    if keys:
        j = df.join(df.groupBy(*keys).agg(*aggs), keys)
    else:
        j = attach(df, df.agg(*aggs))
    for c in values:
        j = j.withColumn(f"{c}_detrended", F.col(c) - (F.col(f"_{c}_a") + F.col(f"_{c}_b") * t)).drop(f"_{c}_a", f"_{c}_b")
    return j


# ---------------------------------------------------------------- grids
def grid_climatology(grid: DataFrame, cell: list[str], values: list[str], time: str = "time", baseline: Column | str | None = None) -> DataFrame:
    """Mean and count per (month-day, cell); partial aggregation plays the accumulator."""
    g = grid.filter(baseline) if baseline is not None else grid
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_clim"), F.count(v).alias(f"{v}_clim_n")]
    return g.groupBy(F.date_format(time, "MM-dd").alias("month_day"), *cell).agg(*aggs)


def grid_anomaly(grid: DataFrame, clim: DataFrame, cell: list[str], values: list[str], time: str = "time") -> DataFrame:
    g = grid.withColumn("month_day", F.date_format(time, "MM-dd")).join(clim, ["month_day", *cell], "left")
    for v in values:
        g = g.withColumn(f"{v}_anom", F.col(v) - F.col(f"{v}_clim"))
    return g


def sample_counts(df: DataFrame, time: str = "time") -> DataFrame:
    """Number of distinct dates behind every month-day."""
    return (df.select(F.to_date(time).alias("_d")).distinct().groupBy(F.date_format("_d", "MM-dd").alias("month_day"))
            .agg(F.count(F.lit(1)).alias("sample_count")))
