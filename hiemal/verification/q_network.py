"""Completeness, networks and homogeneity."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as nw
from .q_climate import SD_SQL, series
from .registry import R, STATION_XY_SQL, query, r6, station_xy

FIRST, LAST = 1995, 2000


def rows(spark, sf):
    s = series(spark, sf)
    return s.select("station", "date", F.when(F.col("tmin") <= 45, F.col("tmin")).alias("value"))


ROWS_SQL = f"{SD_SQL}, rw AS (SELECT station, date, CASE WHEN tmin <= 45 THEN tmin END AS value FROM sd)"
COMP_SQL = f"""{ROWS_SQL}, ss AS (SELECT s.station, y.season, date_diff('day', make_date(y.season, 12, 1), make_date(y.season + 1, 3, 1)) AS expected_days FROM (SELECT DISTINCT station FROM rw) s, (SELECT unnest(range({FIRST}, {LAST + 1})) AS season) y),
cg AS (SELECT station, year(date) - CASE WHEN month(date) <= 2 THEN 1 ELSE 0 END AS season, count(*) AS rep, count(value) AS num FROM rw WHERE month(date) IN (12, 1, 2) GROUP BY 1, 2),
comp AS (SELECT ss.station, CAST(ss.season AS INTEGER) AS season, CAST(expected_days AS INTEGER) AS expected_days, coalesce(rep, 0) AS represented_days, coalesce(num, 0) AS numeric_days, expected_days - coalesce(rep, 0) AS absent_days, coalesce(rep, 0) - coalesce(num, 0) AS missing_days,
  100.0::DOUBLE * coalesce(num, 0) / expected_days AS pct, 100.0::DOUBLE * coalesce(num, 0) / expected_days >= 20 AS complete FROM ss LEFT JOIN cg ON cg.station = ss.station AND cg.season = ss.season)"""


def completeness(spark, sf):
    r = rows(spark, sf)
    return nw.season_completeness(r, r, FIRST, LAST, complete_at=20.0)


@query("season_completeness", "N01", f"WITH {COMP_SQL} SELECT station, season, expected_days, represented_days, numeric_days, absent_days, missing_days, {R('pct')} AS completeness_percent, complete FROM comp")
def _(spark, sf):
    return completeness(spark, sf).withColumn("completeness_percent", r6("completeness_percent"))


NETW_SQL = f"""{COMP_SQL}, {STATION_XY_SQL}, isl AS (SELECT station, season - row_number() OVER (PARTITION BY station ORDER BY season) AS i FROM comp WHERE complete), rl AS (SELECT station, max(n) AS longest FROM (SELECT station, i, count(*) AS n FROM isl GROUP BY 1, 2) GROUP BY 1),
fn AS (SELECT c.station, count(*) AS season_count, count(*) FILTER (WHERE complete) AS complete_seasons, coalesce(any_value(longest), 0) AS longest_complete_run, avg(pct) AS mp, min(pct) AS lp, any_value(x.station) IS NOT NULL AS metadata_pass, any_value(x.lat) IS NOT NULL AND any_value(x.lon) IS NOT NULL AS coordinates_pass
  FROM comp c LEFT JOIN rl ON rl.station = c.station LEFT JOIN (SELECT station, CASE WHEN lon < 91.8 THEN lat END AS lat, lon FROM station_xy WHERE lat < 25.8) x ON x.station = c.station GROUP BY 1),
fixed AS (SELECT *, complete_seasons >= 4 AS completeness_pass, metadata_pass AND coordinates_pass AND complete_seasons >= 4 AS in_network,
  CASE WHEN NOT metadata_pass THEN 'metadata_missing' WHEN NOT coordinates_pass THEN 'coordinates_missing' WHEN complete_seasons < 4 THEN 'too_few_complete_seasons' ELSE '' END AS exclusion_reason FROM fn)"""


def network(spark, sf):
    meta = station_xy(spark, sf).filter("lat < 25.8").withColumn("lat", F.when(F.col("lon") < 91.8, F.col("lat")))
    return nw.fixed_network(completeness(spark, sf), meta, 4)


@query("fixed_network", "N02 N03", f"WITH {NETW_SQL} SELECT station, season_count, complete_seasons, longest_complete_run, {R('mp')} AS mean_completeness, {R('lp')} AS minimum_completeness, metadata_pass, coordinates_pass, completeness_pass, in_network, exclusion_reason FROM fixed")
def _(spark, sf):
    return network(spark, sf).withColumn("mean_completeness", r6("mean_completeness")).withColumn("minimum_completeness", r6("minimum_completeness"))


@query("season_eligibility", "N04", f"""WITH {NETW_SQL}, g AS (SELECT season, count(*) AS station_count, count(*) FILTER (WHERE complete) AS complete_stations, avg(pct) AS mp, min(pct) AS lp, CAST(sum(numeric_days) AS BIGINT) AS nd, CAST(sum(expected_days) AS BIGINT) AS ed FROM comp WHERE station IN (SELECT station FROM fixed WHERE in_network) GROUP BY 1)
SELECT season, station_count, complete_stations, {R('mp')} AS mean_completeness, {R('lp')} AS minimum_completeness, nd AS numeric_station_days, ed AS expected_station_days, CAST(greatest(3, ceil(station_count * 0.7::DOUBLE)) AS BIGINT) AS required_stations, complete_stations >= greatest(3, ceil(station_count * 0.7::DOUBLE)) AS eligible FROM g""")
def _(spark, sf):
    e = nw.season_eligibility(completeness(spark, sf), network(spark, sf), 3, 0.7)
    return e.withColumn("mean_completeness", r6("mean_completeness")).withColumn("minimum_completeness", r6("minimum_completeness"))


@query("dense_season_days", "N05", f"""WITH {ROWS_SQL}, g AS (SELECT s.station, CAST(year(d.date) - CASE WHEN month(d.date) <= 2 THEN 1 ELSE 0 END AS INTEGER) AS season, d.date FROM (SELECT DISTINCT station FROM rw) s, (SELECT CAST(unnest(generate_series(DATE '{FIRST}-12-01', DATE '{LAST + 1}-02-28', INTERVAL 1 DAY)) AS DATE) AS date) d WHERE month(d.date) IN (12, 1, 2))
SELECT g.station, g.date, g.season, CAST(date_diff('day', make_date(g.season, 12, 1), g.date) + 1 AS INTEGER) AS season_day, {R('value')} AS value, rw.station IS NOT NULL AS record_present FROM g LEFT JOIN rw ON rw.station = g.station AND rw.date = g.date""")
def _(spark, sf):
    r = rows(spark, sf)
    return nw.dense_seasons(r, r, FIRST, LAST).select("station", "date", "season", "season_day", r6("value").alias("value"), "record_present")


MON_SQL = f"""{ROWS_SQL}, m0 AS (SELECT station, CAST(date_trunc('month', date) AS DATE) AS month, count(value) AS numeric_days, avg(value) AS mm FROM rw GROUP BY 1, 2),
m1 AS (SELECT station, month, numeric_days, CASE WHEN numeric_days >= 4 THEN mm END AS month_mean FROM m0), mon AS (SELECT *, round(month_mean - avg(month_mean) OVER (PARTITION BY station, month(month)), 9) AS month_anomaly FROM m1)"""


def monthly(spark, sf):
    return nw.monthly_means(rows(spark, sf), min_days=4).withColumn("month_anomaly", F.round("month_anomaly", 9))


@query("monthly_means", "N07", f"WITH {MON_SQL} SELECT station, month, numeric_days, {R('month_mean')} AS month_mean, {R('month_anomaly', 5)} AS month_anomaly FROM mon")
def _(spark, sf):
    m = monthly(spark, sf)
    return m.withColumn("month_mean", r6("month_mean")).withColumn("month_anomaly", r6("month_anomaly", 5))


RES_SQL = f"""{MON_SQL}, mv AS (SELECT station, month, month_anomaly AS a FROM mon WHERE month_anomaly IS NOT NULL),
res AS (SELECT x.station, x.month, any_value(x.a) AS a, count(y.a) AS other_count, CASE WHEN count(y.a) >= 5 THEN median(y.a) END AS reference FROM mv x LEFT JOIN mv y ON y.month = x.month AND y.station <> x.station GROUP BY 1, 2),
rs AS (SELECT *, a - reference AS residual FROM res)"""


def residuals(spark, sf):
    return nw.network_residuals(monthly(spark, sf), 5)


@query("network_residuals", "N08", f"WITH {RES_SQL} SELECT station, month, other_count, {R('reference', 5)} AS reference, {R('residual', 5)} AS residual FROM rs")
def _(spark, sf):
    return residuals(spark, sf).select("station", "month", "other_count", r6("reference", 5).alias("reference"), r6("residual", 5).alias("residual"))


@query("residual_scale", "N09", f"""WITH {RES_SQL}, m AS (SELECT station, median(residual) AS md FROM rs WHERE residual IS NOT NULL GROUP BY 1)
SELECT station, {R('greatest(1.4826 * median(abs(residual - md)), 0.1)', 5)} AS robust_scale FROM rs JOIN m USING (station) WHERE residual IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return nw.series_scale(residuals(spark, sf), "station", "residual", 0.1).withColumn("robust_scale", r6("robust_scale", 5))


def known(spark, sf):
    r = residuals(spark, sf)
    t = station_xy(spark, sf).select("station", F.when(F.col("lat") < 23, F.lit("1998-03-01")).otherwise("1999-01-01").cast("date").alias("transition_month"))
    return nw.known_date_shift(r, t, 12, 0.1, moderate=(0.5, 0.1), high=(1.5, 0.3))


KNOWN_SQL = f"""{RES_SQL}, {STATION_XY_SQL}, tr AS (SELECT station, CASE WHEN lat < 23 THEN DATE '1998-03-01' ELSE DATE '1999-01-01' END AS t FROM station_xy),
ks AS (SELECT rs.station, t, count(*) FILTER (WHERE month < t) AS pre_count, count(*) FILTER (WHERE month >= t) AS post_count, median(residual) FILTER (WHERE month < t) AS a, median(residual) FILTER (WHERE month >= t) AS b, median(residual) AS p FROM rs JOIN tr ON tr.station = rs.station WHERE residual IS NOT NULL GROUP BY 1, 2),
kd AS (SELECT ks.station, greatest(1.4826 * median(abs(residual - ks.a)) FILTER (WHERE month < ks.t), 0.1) AS sa, greatest(1.4826 * median(abs(residual - ks.b)) FILTER (WHERE month >= ks.t), 0.1) AS sb, greatest(1.4826 * median(abs(residual - ks.p)), 0.1) AS sp FROM rs JOIN ks ON ks.station = rs.station WHERE residual IS NOT NULL GROUP BY 1)"""


@query("known_date_shift", "N10", f"""WITH {KNOWN_SQL} SELECT ks.station, t AS transition_month, CAST(pre_count AS INTEGER) AS pre_count, CAST(post_count AS INTEGER) AS post_count, {R('CASE WHEN ok THEN b - a END', 5)} AS median_shift, {R('CASE WHEN ok THEN (b - a) / sp END', 5)} AS standardised_shift, {R('CASE WHEN ok THEN greatest(sa, sb) / least(sa, sb) END', 5)} AS scale_ratio
FROM (SELECT *, pre_count >= 12 AND post_count >= 12 AS ok FROM ks) ks JOIN kd ON kd.station = ks.station""")
def _(spark, sf):
    return known(spark, sf).select("station", "transition_month", "pre_count", "post_count", *[r6(c, 5).alias(c) for c in ("median_shift", "standardised_shift", "scale_ratio")])


@query("known_date_shift_class", "N10")
def _(spark, sf):
    return known(spark, sf).select("station", "ci_lower", "ci_upper", "shift_class")


def annual(spark, sf):
    return nw.annual_residuals(residuals(spark, sf), 6)


@query("annual_residuals", "N12", f"WITH {RES_SQL} SELECT station, CAST(year(month) AS INTEGER) AS year, count(residual) AS month_count, {R('median(residual)', 5)} AS annual_residual, count(residual) >= 6 AS valid FROM rs WHERE residual IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return annual(spark, sf).withColumn("annual_residual", r6("annual_residual", 5))


def scan(spark, sf):
    return nw.break_scan(annual(spark, sf), 2, 0.1, moderate=(0.5, 0.1), high=(1.5, 0.3))


SCAN_SQL = f"""{RES_SQL}, an AS (SELECT station, CAST(year(month) AS INTEGER) AS year, median(residual) AS v FROM rs WHERE residual IS NOT NULL GROUP BY 1, 2 HAVING count(residual) >= 6),
ai AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY year) AS i, count(*) OVER (PARTITION BY station) AS n FROM an), md AS (SELECT station, median(v) AS m FROM an GROUP BY 1), sc AS (SELECT station, greatest(1.4826 * median(abs(v - m)), 0.1) AS s FROM an JOIN md USING (station) GROUP BY 1),
sp AS (SELECT a.station, a.i, a.year, a.n, median(b.v) FILTER (WHERE b.i > a.i) - median(b.v) FILTER (WHERE b.i <= a.i) AS d FROM ai a JOIN ai b ON b.station = a.station WHERE a.n >= 4 AND a.i BETWEEN 2 AND a.n - 2 GROUP BY 1, 2, 3, 4),
bs AS (SELECT sp.*, s, row_number() OVER (PARTITION BY sp.station ORDER BY abs(d / s) DESC, i) AS rk FROM sp JOIN sc ON sc.station = sp.station),
tot AS (SELECT station, any_value(n) AS n FROM ai GROUP BY 1)"""


@query("break_scan", "N11", f"""WITH {SCAN_SQL} SELECT t.station, CAST(t.n AS INTEGER) AS valid_years, CAST(CASE WHEN t.n >= 4 THEN t.n - 3 ELSE 0 END AS INTEGER) AS split_count, b.year AS break_after_year, CAST(b.i AS INTEGER) AS left_years, {R('b.d', 5)} AS break_shift, {R('b.d / b.s', 5)} AS standardised_shift FROM tot t LEFT JOIN bs b ON b.station = t.station AND rk = 1""")
def _(spark, sf):
    return scan(spark, sf).select("station", "valid_years", "split_count", "break_after_year", "left_years", r6("break_shift", 5).alias("break_shift"), r6("standardised_shift", 5).alias("standardised_shift"))


@query("signal_status", "N11 N13")
def _(spark, sf):
    return nw.combined_signal(known(spark, sf), scan(spark, sf))


STAT_SQL = f"""{COMP_SQL}, {STATION_XY_SQL}, st AS (SELECT station, CASE WHEN lat < 22 THEN 'high' WHEN lat < 24 THEN 'moderate' ELSE 'none' END AS signal_status FROM station_xy),
lg AS (SELECT n.network, st.station, CASE n.network WHEN 'all_stations' THEN true WHEN 'without_high_signal' THEN signal_status <> 'high' ELSE signal_status NOT IN ('high', 'moderate') END AS member FROM st, (SELECT unnest(['all_stations', 'without_high_signal', 'stable_only']) AS network) n)"""


def _status(spark, sf):
    return station_xy(spark, sf).select("station", F.when(F.col("lat") < 22, "high").when(F.col("lat") < 24, "moderate").otherwise("none").alias("signal_status"))


@query("network_membership", "N06", f"""WITH {STAT_SQL} SELECT station, bool_or(member) FILTER (WHERE network = 'all_stations') AS all_stations, bool_or(member) FILTER (WHERE network = 'without_high_signal') AS without_high_signal, bool_or(member) FILTER (WHERE network = 'stable_only') AS stable_only FROM lg GROUP BY 1""")
def _(spark, sf):
    return nw.membership_wide(nw.network_membership(_status(spark, sf)))


@query("network_usability", "N06", f"""WITH {STAT_SQL} SELECT network, season, count(*) AS station_count, count(*) FILTER (WHERE complete) AS complete_stations, count(*) FILTER (WHERE complete) >= greatest(3, ceil(count(*) * 0.5::DOUBLE)) AS usable FROM lg JOIN comp USING (station) WHERE member GROUP BY 1, 2""")
def _(spark, sf):
    return nw.network_usability(nw.network_membership(_status(spark, sf)), completeness(spark, sf), 3, 0.5)
