"""Covariates aligned to event onset and end."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.single import attach
from .events import event_days


def aligned_rows(cov: DataFrame, cat: DataFrame, onset: tuple[int, int], end: tuple[int, int], keep: list[str]) -> DataFrame:
    """Event-lag rows on onset and on end with the covariates of their date; absent dates drop out."""
    rows = None
    for name, ref, (a, b) in (("onset", "start_date", onset), ("end", "end_date", end)):
        r = cat.select("event_id", *keep, F.col(ref).alias("_r"), F.explode(F.sequence(F.lit(a), F.lit(b))).alias("lag")).select(
            "event_id", *keep, F.lit(name).alias("align"), "lag", F.date_add("_r", F.col("lag")).alias("date"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.join(cov, "date")


def lag_means(aligned: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.count(v).alias(f"{v}_count")]
    return aligned.groupBy("align", *by, "lag").agg(*aggs)


def window_means(aligned: DataFrame, windows: dict[str, tuple[str, int, int]], values: list[str], keep: list[str]) -> DataFrame:
    """Event-level means over named lag windows (name -> align, first, last)."""
    spec = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).alias("_al"), F.lit(x).alias("_x"), F.lit(y).alias("_y")) for n, (a, x, y) in windows.items()])
    j = aligned.select("*", F.inline(spec)).filter((F.col("align") == F.col("_al")) & F.col("lag").between(F.col("_x"), F.col("_y")))
    return j.groupBy("event_id", *keep, "window").agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("day_count"))


def own_day_means(cov: DataFrame, cat: DataFrame, values: list[str], keep: list[str]) -> DataFrame:
    """Event-level means over the event's own days."""
    d = event_days(cat, keep=keep)
    return d.join(cov, "date").groupBy("event_id", *keep).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("day_count"))


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per variable, so that every variable is one group of the same job."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in values])))


def join_families(base: DataFrame, families: list[DataFrame], key: str = "date") -> DataFrame:
    """Left joins of covariate families on the date."""
    for f in families:
        base = base.join(f, key, "left")
    return base


def sustained_lead(lags: DataFrame, by: list[str], low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """Earliest lag from which the interval excludes zero with one sign on every lag to 0."""
    sign = F.when(F.col(low) > 0, 1).when(F.col(high) < 0, -1).otherwise(0)
    d = lags.filter(F.col("lag") <= 0).withColumn("_s", sign)
    w = W.partitionBy(*by).orderBy(F.desc("lag"))
    first = F.first("_s").over(w)
    d = d.withColumn("_f", first).withColumn("_at", F.first("lag").over(w)).withColumn("_step", F.row_number().over(w) - 1)
    ok = (F.col("_s") == F.col("_f")) & (F.col("_s") != 0) & (F.col("_at") == 0) & (F.col("lag") == -F.col("_step"))
    d = d.withColumn("_run", F.min(ok.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(*by).agg(F.min(F.when(F.col("_run") == 1, F.col("lag"))).alias("lead_lag"), F.max(F.when(F.col("_run") == 1, F.col("_f"))).alias("lead_sign"))


def window_features(daily: DataFrame, cat: DataFrame, windows: dict[str, tuple[int, int]], keep: list[str]) -> DataFrame:
    """Event x sector x window features of a sector index.

    ``daily``: sector, date, value, standardised, limit, high_day, episode, is_peak. The window
    named ``event`` is the event's own days. A missing day is an error: its row makes the job fail
    instead of shrinking the mean.
    """
    spec = [F.struct(F.lit(n).alias("window"), F.date_add("start_date", a).alias("_a"), F.date_add("start_date", b).alias("_b")) for n, (a, b) in windows.items()]
    spec.append(F.struct(F.lit("event").alias("window"), F.col("start_date").alias("_a"), F.col("end_date").alias("_b")))
    days = cat.select("event_id", *keep, F.inline(F.array(*spec))).select("event_id", *keep, "window", F.explode(F.sequence("_a", "_b")).alias("date"))
    names = daily.agg(F.collect_set("sector").alias("_s"))  # a short list of sector names
    days = attach(days, names).withColumn("sector", F.explode("_s")).drop("_s")
    j = days.join(daily.withColumn("_hit", F.lit(True)), ["sector", "date"], "left")
    j = j.filter(F.assert_true(F.col("_hit").isNotNull(), F.lit("window day missing from the daily index")).isNull())
    keys = ["event_id", *keep, "sector", "window"]
    hi = W.partitionBy(*keys, "high_day").orderBy("date")
    j = j.withColumn("_g", F.when(F.col("high_day"), F.unix_date("date") - F.row_number().over(hi)))
    j = j.withColumn("_n", F.when(F.col("high_day"), F.count(F.lit(1)).over(W.partitionBy(*keys, "high_day", "_g"))).otherwise(0))
    share = lambda c: F.avg(F.col(c).cast("double"))
    f = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("day_count"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"), F.avg("standardised").alias("mean_standardised"),
        share("high_day").alias("high_day_fraction"), F.max("_n").alias("longest_high_run"), F.sum(F.greatest(F.col("value") - F.col("limit"), F.lit(0.0))).alias("excess_sum"),
        F.count_if("is_peak").alias("peak_count"), share("episode").alias("episode_fraction"))
    return f.withColumn("recurrent", (F.col("peak_count") >= 2) & (F.col("high_day_fraction") > 0))
