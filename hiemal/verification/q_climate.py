"""Climatologies, anomalies, thresholds and time filters."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.single import attach
from ..functions import calendar as cal
from ..operators import climatology as k
from .registry import GRID_DAILY_SQL, R, STATION_DAILY_SQL, grid_daily, query, r6, station_daily

LEAP = "(year(date) % 4 = 0 AND (year(date) % 100 <> 0 OR year(date) % 400 = 0))"
S366 = "CAST(dayofyear(make_date(2000, month(date), day(date))) AS INTEGER)"
S365 = f"CAST(CASE WHEN month(date) = 2 AND day(date) = 29 THEN 59 ELSE dayofyear(date) - CASE WHEN {LEAP} AND dayofyear(date) > 60 THEN 1 ELSE 0 END END AS INTEGER)"
SD_SQL = STATION_DAILY_SQL + f""", sd AS (SELECT *, CAST(year(date) AS INTEGER) AS year, {S366} AS slot, {S365} AS slot365, strftime(date, '%m-%d') AS month_day FROM station_daily)"""
FIRST, LAST = 1995, 1999


def series(spark, sf):
    d = F.col("date")
    return station_daily(spark, sf).select(
        "station", "date", "tmin", "tmax", F.year(d).alias("year"), cal.slot_366(d).alias("slot"), cal.slot_365(d).alias("slot365"),
        cal.month_day(d).alias("month_day"))


BASE = f"year BETWEEN {FIRST} AND {LAST}"


def t8(arr: str, p: float) -> str:
    n = f"len({arr})"
    h = f"greatest(1.0::DOUBLE, least(({n} + 1::DOUBLE / 3) * {p}::DOUBLE + 1::DOUBLE / 3, {n}::DOUBLE))"
    lo = f"CAST(floor({h}) AS BIGINT)"
    return f"({arr}[{lo}] + ({h} - floor({h})) * ({arr}[least({lo} + 1, {n})] - {arr}[{lo}]))"


def moments_sql(value: str, half: int, src: str = "sd", slot: str = "slot365", period: int = 365, cond: str = f"year BETWEEN {FIRST} AND {LAST}", keys: str = "station"):
    return f"""(SELECT {keys}, ({slot} - 1 - o + {period}) % {period} + 1 AS {slot}, avg({value}) AS m, stddev_samp({value}) AS s, count({value}) AS n
  FROM {src}, (SELECT unnest(range(-{half}, {half + 1})) AS o) offs WHERE {cond} AND {value} IS NOT NULL GROUP BY 1, 2)"""


@query("calendar_anomaly", "K01", f"""WITH {SD_SQL}
SELECT sd.station, sd.date, {R('sd.tmin - c.m')} AS anomaly, c.n AS clim_n FROM sd LEFT JOIN {moments_sql('tmin', 15)} c ON c.station = sd.station AND c.slot365 = sd.slot365""")
def _(spark, sf):
    a = k.calendar_anomaly(series(spark, sf), ["station"], "tmin", "slot365", 15, BASE)
    return a.select("station", "date", r6("anomaly").alias("anomaly"), "clim_n")


@query("calendar_zscore", "K02", f"""WITH {SD_SQL}
SELECT sd.station, sd.date, {R('(sd.tmax - c.m) / nullif(c.s, 0)', 5)} AS zscore, {R('c.s', 5)} AS clim_sd FROM sd LEFT JOIN {moments_sql('tmax', 15)} c ON c.station = sd.station AND c.slot365 = sd.slot365""")
def _(spark, sf):
    a = k.calendar_anomaly(series(spark, sf), ["station"], "tmax", "slot365", 15, BASE, scale=True)
    return a.select("station", "date", r6("anomaly", 5).alias("zscore"), r6("clim_sd", 5).alias("clim_sd"))


NATION_SQL = SD_SQL + ", nat AS (SELECT date, year, slot365, month_day, avg(tmax) AS x, avg(tmin) AS y FROM sd GROUP BY 1, 2, 3, 4)"


def national(spark, sf):
    return series(spark, sf).groupBy("date", "year", "slot365", "month_day").agg(F.avg("tmax").alias("x"), F.avg("tmin").alias("y"))


@query("month_day_zscore", "K03", f"""WITH {NATION_SQL}, c AS (SELECT month_day, avg(x) AS m, stddev_samp(x) AS s, count(x) AS n FROM nat WHERE year BETWEEN {FIRST} AND {LAST} GROUP BY 1)
SELECT date, {R('x - m')} AS anomaly, {R('(x - m) / nullif(s, 0)')} AS zscore FROM nat LEFT JOIN c USING (month_day)""")
def _(spark, sf):
    n = national(spark, sf)
    z = k.standardise(n, k.month_day_climatology(n, [], "x", "month_day", BASE), ["month_day"], "x")
    return z.select("date", r6("anomaly").alias("anomaly"), r6("zscore").alias("zscore"))


@query("month_day_quantiles", "K04", f"""WITH {GRID_DAILY_SQL}
SELECT lon, strftime(time, '%m-%d') AS month_day, {R('avg(v)')} AS clim_mean, {R('stddev_samp(v)')} AS clim_sd, count(v) AS clim_n, {R('quantile_cont(v, 0.75)')} AS clim_p75, {R('quantile_cont(v, 0.9)')} AS clim_p90
FROM grid GROUP BY 1, 2""")
def _(spark, sf):
    g = grid_daily(spark, sf).withColumn("month_day", F.date_format("time", "MM-dd"))
    c = k.month_day_climatology(g, ["lon"], "v", "month_day", quantiles=True)
    return c.select("lon", "month_day", "clim_n", *[r6(x).alias(x) for x in ("clim_mean", "clim_sd", "clim_p75", "clim_p90")])


SAMPLE2 = f"""smp AS (SELECT station, (slot - 1 - o + 366) % 366 + 1 AS slot, tmin AS x, year FROM sd, (SELECT unnest(range(-2, 3)) AS o) offs WHERE year BETWEEN {FIRST} AND {LAST})"""
THR_SQL = f"""{SD_SQL}, {SAMPLE2}, arr AS (SELECT station, slot, list(x ORDER BY x) AS a, count(*) AS observation_count, count(DISTINCT year) AS year_count FROM smp GROUP BY 1, 2),
thr AS (SELECT station, CAST(slot AS INTEGER) AS slot, CAST(observation_count AS INTEGER) AS observation_count, CAST(year_count AS INTEGER) AS year_count,
  CASE WHEN observation_count >= 3 AND year_count >= 2 THEN {t8('a', 0.05)} END AS p05, CASE WHEN observation_count >= 3 AND year_count >= 2 THEN {t8('a', 0.1)} END AS p10,
  CASE WHEN observation_count >= 3 AND year_count >= 2 THEN {t8('a', 0.2)} END AS p20 FROM arr)"""


def thresholds(spark, sf):
    return k.calendar_thresholds(series(spark, sf).filter(BASE), ["station"], "tmin", "slot", 2, min_obs=3, min_years=2)


@query("calendar_thresholds", "K05", f"WITH {THR_SQL} SELECT station, slot, observation_count, year_count, {R('p05')} AS p05, {R('p10')} AS p10, {R('p20')} AS p20 FROM thr")
def _(spark, sf):
    return thresholds(spark, sf).select("station", "slot", "observation_count", "year_count", *[r6(c).alias(c) for c in ("p05", "p10", "p20")])


LOO_SQL = f"""looa AS (SELECT station, slot, y.y AS excluded_year, list(x ORDER BY x) FILTER (WHERE year <> y.y) AS a, count(*) FILTER (WHERE year <> y.y) AS n, count(DISTINCT year) FILTER (WHERE year <> y.y) AS ny
  FROM smp, (SELECT unnest(range({FIRST}, {LAST + 1})) AS y) y GROUP BY 1, 2, 3),
loo AS (SELECT station, CAST(slot AS INTEGER) AS slot, CAST(excluded_year AS INTEGER) AS excluded_year, CAST(n AS INTEGER) AS loo_observation_count, CAST(ny AS INTEGER) AS loo_year_count,
  CASE WHEN n >= 3 AND ny >= 2 THEN {t8('a', 0.1)} END AS loo_threshold FROM looa)"""


def loo(spark, sf):
    return k.leave_year_out_thresholds(series(spark, sf).filter(BASE), ["station"], "tmin", "slot", 0.1, FIRST, LAST, 2, 3, 2)


@query("leave_year_out_thresholds", "K06", f"WITH {THR_SQL}, {LOO_SQL} SELECT station, slot, excluded_year, loo_observation_count, loo_year_count, {R('loo_threshold')} AS loo_threshold FROM loo")
def _(spark, sf):
    return loo(spark, sf).withColumn("loo_threshold", r6("loo_threshold"))


ASSIGNED_SQL = f"""{THR_SQL}, {LOO_SQL}, asg AS (SELECT sd.*, CASE WHEN sd.year BETWEEN {FIRST} AND {LAST} THEN l.loo_threshold ELSE t.p10 END AS threshold, t.p20,
   CASE WHEN sd.year BETWEEN {FIRST} AND {LAST} THEN 'leave_year_out' ELSE 'full_baseline' END AS threshold_source
 FROM sd LEFT JOIN thr t ON t.station = sd.station AND t.slot = sd.slot LEFT JOIN loo l ON l.station = sd.station AND l.slot = sd.slot AND l.excluded_year = sd.year)"""


@query("assigned_thresholds", "K07 K08", f"""WITH {ASSIGNED_SQL}
SELECT station, date, {R('threshold')} AS threshold, threshold_source, coalesce(tmin < threshold, false) AS cold FROM asg""")
def _(spark, sf):
    a = k.assign_threshold(series(spark, sf), thresholds(spark, sf), loo(spark, sf), ["station"], "slot", "p10", FIRST, LAST)
    return a.select("station", "date", r6("threshold").alias("threshold"), "threshold_source", k.cold_flag(F.col("tmin"), F.col("threshold")).alias("cold"))


@query("threshold_order_check", "K09", f"""WITH {THR_SQL} SELECT count(*) AS threshold_rows, count(*) FILTER (WHERE p05 > p10 OR p10 > p20) AS unordered FROM thr""")
def _(spark, sf):
    t = thresholds(spark, sf)
    n = t.agg(F.count(F.lit(1)).alias("threshold_rows"))
    return attach(n, k.unordered_thresholds(t).agg(F.count(F.lit(1)).alias("unordered")))


@query("compound_cold_days", "K10 K11", f"""WITH {THR_SQL}, j AS (SELECT sd.station, sd.date, sd.tmin, t.p20, coalesce(sd.tmin < t.p20, false) AS a, coalesce(sd.tmin <= 10, false) AS b FROM sd LEFT JOIN thr t ON t.station = sd.station AND t.slot = sd.slot)
SELECT station, date, a AND b AS "both", a OR b AS "either", a AND NOT b AS only_a, NOT a AND b AS only_b, NOT a AND NOT b AS neither, true AS exactly_one,
  {R('CASE WHEN a THEN p20 - tmin END')} AS percentile_deficit, {R('CASE WHEN b THEN 10 - tmin END')} AS category_deficit FROM j""")
def _(spark, sf):
    j = series(spark, sf).join(thresholds(spark, sf).select("station", "slot", "p20"), ["station", "slot"], "left")
    j = j.withColumn("a", k.cold_flag(F.col("tmin"), F.col("p20"))).withColumn("b", F.col("tmin") <= 10)
    c = k.compound_flags(j, "a", "b")
    return c.select("station", "date", "both", "either", "only_a", "only_b", "neither", "exactly_one",
                    r6(k.deficit(F.col("tmin"), F.col("p20"), F.col("a"))).alias("percentile_deficit"),
                    r6(k.deficit(F.col("tmin"), F.lit(10.0), F.col("b"))).alias("category_deficit"))


@query("tendency_and_lag", "K12 K13", f"""WITH {SD_SQL}
SELECT s.station, s.date, {R('s.tmin - p.tmin')} AS tendency, {R('s.tmin - lag(s.tmin) OVER (PARTITION BY s.station ORDER BY s.date)')} AS positional_step, {R('w.tmin')} AS week_before
FROM sd s LEFT JOIN sd p ON p.station = s.station AND p.date = s.date - 1 LEFT JOIN sd w ON w.station = s.station AND w.date = s.date - 7""")
def _(spark, sf):
    d = k.tendency(series(spark, sf), ["station"], "date", "tmin", "tendency")
    d = k.tendency(d, ["station"], "date", "tmin", "positional_step", positional=True)
    d = k.lagged(d, ["station"], "date", "tmin", 7, "week_before")
    return d.select("station", "date", *[r6(c).alias(c) for c in ("tendency", "positional_step", "week_before")])


@query("rolling_means", "K13 K14", f"""WITH {NATION_SQL}, w AS (SELECT date, count(y) OVER a AS n3, avg(y) OVER a AS m3, count(y) OVER b AS n5, avg(y) OVER b AS m5 FROM nat
 WINDOW a AS (ORDER BY date RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW), b AS (ORDER BY date RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND INTERVAL 2 DAYS FOLLOWING))
SELECT date, {R('CASE WHEN n3 = 3 THEN m3 END')} AS trailing_3, {R('CASE WHEN n5 = 5 THEN m5 END')} AS centred_5 FROM w""")
def _(spark, sf):
    n = k.trailing_mean(national(spark, sf), [], "date", "y", 3, "trailing_3")
    n = k.centred_mean(n, [], "date", "y", 2, "centred_5")
    return n.select("date", r6("trailing_3").alias("trailing_3"), r6("centred_5").alias("centred_5"))


@query("detrended_series", "K15", f"""WITH {SD_SQL}, f AS (SELECT station, regr_slope(tmin, date_diff('day', DATE '1970-01-01', date)) AS b1, regr_intercept(tmin, date_diff('day', DATE '1970-01-01', date)) AS a1,
  regr_slope(tmax, date_diff('day', DATE '1970-01-01', date)) AS b2, regr_intercept(tmax, date_diff('day', DATE '1970-01-01', date)) AS a2 FROM sd GROUP BY 1)
SELECT station, date, {R("tmin - (a1 + b1 * date_diff('day', DATE '1970-01-01', date))", 5)} AS tmin_detrended, {R("tmax - (a2 + b2 * date_diff('day', DATE '1970-01-01', date))", 5)} AS tmax_detrended FROM sd JOIN f USING (station)""")
def _(spark, sf):
    d = k.detrend(series(spark, sf), ["station"], "date", ["tmin", "tmax"])
    return d.select("station", "date", r6("tmin_detrended", 5).alias("tmin_detrended"), r6("tmax_detrended", 5).alias("tmax_detrended"))


GCLIM_SQL = GRID_DAILY_SQL + ", gclim AS (SELECT strftime(time, '%m-%d') AS month_day, lat, lon, avg(t) AS t_clim, count(t) AS t_clim_n FROM grid WHERE year(time) <= 1999 GROUP BY 1, 2, 3)"


@query("grid_climatology", "K16 K18", f"""WITH {GCLIM_SQL}, n AS (SELECT strftime(time, '%m-%d') AS month_day, count(DISTINCT time) AS sample_count FROM grid GROUP BY 1)
SELECT month_day, lat, lon, {R('t_clim')} AS t_clim, t_clim_n, sample_count FROM gclim JOIN n USING (month_day)""")
def _(spark, sf):
    g = grid_daily(spark, sf)
    c = k.grid_climatology(g, ["lat", "lon"], ["t"], baseline=F.year("time") <= 1999)
    return c.join(k.sample_counts(g), "month_day").withColumn("t_clim", r6("t_clim"))


@query("grid_anomaly", "K17", f"""WITH {GCLIM_SQL} SELECT time, g.lat, g.lon, {R('t - t_clim')} AS t_anom FROM grid g LEFT JOIN gclim c ON c.month_day = strftime(time, '%m-%d') AND c.lat = g.lat AND c.lon = g.lon""")
def _(spark, sf):
    g = grid_daily(spark, sf)
    a = k.grid_anomaly(g, k.grid_climatology(g, ["lat", "lon"], ["t"], baseline=F.year("time") <= 1999), ["lat", "lon"], ["t"])
    return a.select("time", "lat", "lon", r6("t_anom").alias("t_anom"))
