"""Completeness, station networks and homogeneity."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import calendar as cal, quantile as q
from ..functions.numeric import first_match
from ..plans.ordered import median_of_others


# ---------------------------------------------------------------- completeness
def station_seasons(stations: DataFrame, first: int, last: int, start_month: int = 12, last_month: int = 2) -> DataFrame:
    """Every station times every season, with the expected (leap-aware) day count."""
    s = F.col("season")
    return (stations.select("station").distinct().withColumn("season", F.explode(F.sequence(F.lit(first), F.lit(last))))
            .withColumn("expected_days", cal.season_length(s, start_month, last_month)))


def season_completeness(rows: DataFrame, stations: DataFrame, first: int, last: int, value: str = "value", complete_at: float = 95.0,
                        start_month: int = 12, last_month: int = 2) -> DataFrame:
    """Represented, numeric, absent and missing days per station and season."""
    d = F.col("date")
    months = [m for m in range(1, 13) if m >= start_month or m <= last_month]
    inside = rows.filter(F.month(d).isin(*months)).withColumn("season", cal.season_year(d, last_month))
    got = inside.groupBy("station", "season").agg(F.count(F.lit(1)).alias("represented_days"), F.count(value).alias("numeric_days"))
    g = station_seasons(stations, first, last, start_month, last_month).join(got, ["station", "season"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    g = g.withColumn("represented_days", zero("represented_days")).withColumn("numeric_days", zero("numeric_days"))
    pct = F.lit(100.0) * F.col("numeric_days") / F.col("expected_days")
    return (g.withColumn("absent_days", F.col("expected_days") - F.col("represented_days"))
            .withColumn("missing_days", F.col("represented_days") - F.col("numeric_days"))
            .withColumn("completeness_percent", pct).withColumn("complete", pct >= complete_at))


def longest_runs(df: DataFrame, key: str, order: str, flag: str, out: str) -> DataFrame:
    """Longest run of consecutive true steps of an integer axis, 0 where there is none."""
    hit = df.filter(F.col(flag)).withColumn("_i", F.col(order) - F.row_number().over(W.partitionBy(key).orderBy(order)))
    runs = hit.groupBy(key, "_i").agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(F.max("_n").alias(out))
    return df.select(key).distinct().join(runs, key, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def fixed_network(completeness: DataFrame, meta: DataFrame, min_complete: int) -> DataFrame:
    """Per-station rule results and eligibility (metadata, coordinates, complete seasons)."""
    g = completeness.groupBy("station").agg(
        F.count(F.lit(1)).alias("season_count"), F.count_if("complete").alias("complete_seasons"),
        F.avg("completeness_percent").alias("mean_completeness"), F.min("completeness_percent").alias("minimum_completeness"))
    m = meta.select("station", F.lit(True).alias("_m"), "lat", "lon")
    j = g.join(m, "station", "left").join(longest_runs(completeness, "station", "season", "complete", "longest_complete_run"), "station")
    has_meta = F.coalesce(F.col("_m"), F.lit(False))
    has_xy = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    enough = F.col("complete_seasons") >= min_complete
    return j.select(
        "station", "season_count", "complete_seasons", "longest_complete_run", "mean_completeness", "minimum_completeness",
        has_meta.alias("metadata_pass"), has_xy.alias("coordinates_pass"), enough.alias("completeness_pass"),
        (has_meta & has_xy & enough).alias("in_network"),
        first_match([(~has_meta, "metadata_missing"), (~has_xy, "coordinates_missing"), (~enough, "too_few_complete_seasons")], "").alias("exclusion_reason"))


def season_eligibility(completeness: DataFrame, network: DataFrame, min_stations: int, min_fraction: float) -> DataFrame:
    """A season is eligible when enough of the network is complete: max(count, ceil(share * n))."""
    inside = completeness.join(network.filter("in_network").select("station"), "station", "left_semi")
    g = inside.groupBy("season").agg(
        F.count(F.lit(1)).alias("station_count"), F.count_if("complete").alias("complete_stations"),
        F.avg("completeness_percent").alias("mean_completeness"), F.min("completeness_percent").alias("minimum_completeness"),
        F.sum("numeric_days").alias("numeric_station_days"), F.sum("expected_days").alias("expected_station_days"))
    need = F.greatest(F.lit(min_stations).cast("long"), F.ceil(F.col("station_count") * F.lit(min_fraction)).cast("long"))
    return g.withColumn("required_stations", need).withColumn("eligible", F.col("complete_stations") >= need)


def dense_seasons(rows: DataFrame, stations: DataFrame, first: int, last: int, start_month: int = 12, last_month: int = 2) -> DataFrame:
    """One row per station and season day; absent rows are explicit."""
    s = station_seasons(stations, first, last, start_month, last_month)
    day = F.explode(F.sequence(cal.season_start(F.col("season"), start_month), cal.season_end(F.col("season"), last_month)))
    grid = s.select("station", "season", day.alias("date"))
    grid = grid.withColumn("season_day", F.datediff("date", cal.season_start(F.col("season"), start_month)) + 1)
    j = grid.join(rows.withColumn("record_present", F.lit(True)), ["station", "date"], "left")
    return j.withColumn("record_present", F.coalesce("record_present", F.lit(False)))


# fixed values: sub-networks and the homogeneity signals each of them leaves out
NETWORKS = (("all_stations", ()), ("without_high_signal", ("high",)), ("stable_only", ("high", "moderate")))


def network_membership(status: DataFrame, networks=NETWORKS) -> DataFrame:
    """Long membership (network, station, member) from the signal status of each station."""
    spec = F.array(*[F.struct(F.lit(n).alias("network"), F.array(*[F.lit(x) for x in ex]).cast("array<string>").alias("left_out")) for n, ex in networks])
    return status.select("station", "signal_status", F.inline(spec)).select(
        "network", "station", (~F.array_contains("left_out", F.col("signal_status"))).alias("member"))


def membership_wide(long: DataFrame, networks=NETWORKS) -> DataFrame:
    names = [n for n, _ in networks]
    return long.groupBy("station").pivot("network", names).agg(F.first("member")).select(
        "station", *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names])


def network_usability(long: DataFrame, completeness: DataFrame, min_stations: int, min_fraction: float) -> DataFrame:
    """Seasons each sub-network can be used in."""
    m = long.filter("member").join(completeness.select("station", "season", "complete"), "station")
    g = m.groupBy("network", "season").agg(F.count(F.lit(1)).alias("station_count"), F.count_if("complete").alias("complete_stations"))
    need = F.greatest(F.lit(min_stations).cast("long"), F.ceil(F.col("station_count") * F.lit(min_fraction)).cast("long"))
    return g.withColumn("usable", F.col("complete_stations") >= need)


# ---------------------------------------------------------------- homogeneity
def monthly_means(rows: DataFrame, value: str = "value", min_days: int = 20) -> DataFrame:
    """Monthly mean where enough days are numeric, and its departure from the station's calendar month."""
    m = rows.groupBy("station", F.to_date(F.trunc("date", "month")).alias("month")).agg(F.count(value).alias("numeric_days"), F.avg(value).alias("_m"))
    m = m.withColumn("month_mean", F.when(F.col("numeric_days") >= min_days, F.col("_m"))).drop("_m")
    # at most one row per month and station, so the window is bounded by the number of years
    clim = F.avg("month_mean").over(W.partitionBy("station", F.month("month")))
    return m.withColumn("month_anomaly", F.col("month_mean") - clim)


def network_residuals(monthly: DataFrame, min_others: int = 8, value: str = "month_anomaly") -> DataFrame:
    """Departure of each station-month from the median of all other stations in that month."""
    j = median_of_others(monthly.filter(F.col(value).isNotNull()), ["month"], value, "reference", "other_count")
    ok = F.col("other_count") >= min_others
    return j.withColumn("reference", F.when(ok, F.col("reference"))).withColumn("residual", F.col(value) - F.col("reference"))


def robust_scale(values: Column, floor: float) -> Column:
    """max(1.4826 MAD, floor) of an ascending array; null if empty."""
    deviation = q.bound(values, lambda v: q.mad(v, q.median(v)))
    return q.bound(deviation, lambda m: F.when(m.isNotNull(), F.greatest(F.lit(1.4826) * m, F.lit(floor))))


def series_scale(df: DataFrame, key: str, value: str, floor: float) -> DataFrame:
    """Robust scale per station of a monthly or annual series (bounded by its time axis)."""
    a = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("_a"))
    return a.select(key, robust_scale(F.col("_a"), floor).alias("robust_scale"))


_CI = T.StructType().add("ci_lower", "double").add("ci_upper", "double")


def shift_interval(reps: int, seed: int):
    """Arrow function: percentile interval of the median difference of two resampled arrays."""
    @F.pandas_udf(_CI)
    def interval(key: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
        out = []
        for k, a, b in zip(key, before, after):
            if a is None or b is None or len(a) == 0 or len(b) == 0:
                out.append((None, None))
                continue
            rng = np.random.default_rng([seed, int(k) & 0x7FFFFFFF])
            a, b = np.asarray(a, float), np.asarray(b, float)
            d = (np.median(b[rng.integers(0, len(b), (reps, len(b)))], axis=1)
                 - np.median(a[rng.integers(0, len(a), (reps, len(a)))], axis=1))
            out.append(tuple(np.quantile(d, [0.025, 0.975])))
        return pd.DataFrame(out, columns=["ci_lower", "ci_upper"], dtype=float)
    return interval


def classify_shift(shift: Column, standardised: Column, lo: Column, hi: Column, moderate=(0.3, 0.5), high=(0.6, 1.0)) -> Column:
    """high / moderate / no major / insufficient, needing an interval that excludes zero."""
    sure = F.coalesce((lo > 0) | (hi < 0), F.lit(False))
    big = lambda t: (F.abs(shift) >= t[0]) & (F.abs(standardised) >= t[1])
    return first_match([(shift.isNull() | standardised.isNull(), "insufficient_data"), (sure & big(high), "high_shift_signal"),
                        (sure & big(moderate), "moderate_shift_signal")], "no_major_shift_signal")


def known_date_shift(residuals: DataFrame, transitions: DataFrame, min_months: int = 24, floor: float = 0.1, reps: int = 2000, seed: int = 42,
                     moderate=(0.3, 0.5), high=(0.6, 1.0), value: str = "residual") -> DataFrame:
    """Median shift at a known transition date per station (station, transition_month)."""
    j = residuals.filter(F.col(value).isNotNull()).join(transitions, "station")
    before = F.col("month") < F.col("transition_month")
    g = j.groupBy("station", "transition_month").agg(
        F.array_sort(F.collect_list(F.when(before, F.col(value)))).alias("_a"), F.array_sort(F.collect_list(F.when(~before, F.col(value)))).alias("_b"))
    g = g.withColumn("pre_count", F.size("_a")).withColumn("post_count", F.size("_b"))
    ok = (F.col("pre_count") >= min_months) & (F.col("post_count") >= min_months)
    g = g.withColumn("_a", F.when(ok, F.col("_a"))).withColumn("_b", F.when(ok, F.col("_b")))
    g = (g.withColumn("pre_median", q.median(F.col("_a"))).withColumn("post_median", q.median(F.col("_b")))
         .withColumn("pooled_scale", robust_scale(F.array_sort(F.concat("_a", "_b")), floor))
         .withColumn("pre_scale", robust_scale(F.col("_a"), floor)).withColumn("post_scale", robust_scale(F.col("_b"), floor)))
    g = g.withColumn("median_shift", F.col("post_median") - F.col("pre_median"))
    g = g.withColumn("standardised_shift", F.col("median_shift") / F.col("pooled_scale")).withColumn(
        "scale_ratio", F.greatest("pre_scale", "post_scale") / F.least("pre_scale", "post_scale"))
    g = g.withColumn("_ci", shift_interval(reps, seed)(F.xxhash64("station"), "_a", "_b")).select("*", "_ci.*").drop("_ci", "_a", "_b")
    return g.withColumn("shift_class", classify_shift(F.col("median_shift"), F.col("standardised_shift"), F.col("ci_lower"), F.col("ci_upper"), moderate, high))


def annual_residuals(residuals: DataFrame, min_months: int = 8, value: str = "residual") -> DataFrame:
    r = residuals.filter(F.col(value).isNotNull()).groupBy("station", F.year("month").alias("year")).agg(
        F.count(value).alias("month_count"), F.percentile(value, 0.5).alias("annual_residual"))
    return r.withColumn("valid", F.col("month_count") >= min_months)


def break_scan(annual: DataFrame, min_side: int = 10, floor: float = 0.1, reps: int = 2000, seed: int = 42,
               moderate=(0.3, 0.5), high=(0.6, 1.0)) -> DataFrame:
    """Largest standardised median shift over every split of the annual series.

    The series of one station (at most one value per year) is an array; all splits are evaluated
    inside its row. The interval is drawn for the winning split only.
    """
    g = annual.filter("valid").groupBy("station").agg(
        F.array_sort(F.collect_list(F.struct(F.col("year").alias("y"), F.col("annual_residual").alias("v")))).alias("_s"))
    n = F.size("_s")
    vals = F.transform("_s", lambda e: e["v"])
    g = g.withColumn("valid_years", n).withColumn("_v", vals).withColumn("pooled_scale", robust_scale(F.array_sort(vals), floor))
    can = F.col("valid_years") >= 2 * min_side

    def split(i: Column) -> Column:
        left, right = F.slice("_v", F.lit(1), i), F.slice("_v", i + 1, F.col("valid_years") - i)
        d = q.median(F.array_sort(right)) - q.median(F.array_sort(left))
        return F.struct(F.abs(d / F.col("pooled_scale")).alias("size"), (-i).alias("first"), d.alias("shift"), i.alias("left_years"))

    g = g.withColumn("_best", F.when(can, F.array_max(F.transform(
        F.sequence(F.lit(min_side), F.greatest(F.col("valid_years") - min_side, F.lit(min_side))), split))))
    i = F.col("_best.left_years")
    g = g.withColumn("_a", F.when(can, F.slice("_v", F.lit(1), i))).withColumn("_b", F.when(can, F.slice("_v", i + 1, F.col("valid_years") - i)))
    g = g.select(
        "station", "valid_years", F.when(can, F.col("valid_years") - 2 * min_side + 1).otherwise(0).alias("split_count"),
        F.when(can, F.element_at("_s", i)["y"]).alias("break_after_year"), i.alias("left_years"), (F.col("valid_years") - i).alias("right_years"),
        F.col("_best.shift").alias("break_shift"), "pooled_scale", (F.col("_best.shift") / F.col("pooled_scale")).alias("standardised_shift"),
        shift_interval(reps, seed)(F.xxhash64("station"), "_a", "_b").alias("_ci"))
    g = g.select("*", "_ci.*").drop("_ci")
    return g.withColumn("break_class", classify_shift(F.col("break_shift"), F.col("standardised_shift"), F.col("ci_lower"), F.col("ci_upper"), moderate, high))


def combined_signal(known: DataFrame, scan: DataFrame) -> DataFrame:
    """Worse of the two classes per station: high, moderate, none or insufficient."""
    j = known.select("station", F.col("shift_class").alias("_k")).join(scan.select("station", F.col("break_class").alias("_s")), "station", "full")
    has = lambda w: F.coalesce(F.col("_k") == w, F.lit(False)) | F.coalesce(F.col("_s") == w, F.lit(False))
    return j.select("station", first_match([(has("high_shift_signal"), "high"), (has("moderate_shift_signal"), "moderate"),
                                            (has("no_major_shift_signal"), "none")], "insufficient").alias("signal_status"))
