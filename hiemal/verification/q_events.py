"""Area diagnostics, event catalogues and event comparisons."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import area, climatology as k, events as ev
from ..session import cut_lineage, stage_table
from .q_climate import BASE, FIRST, LAST, NATION_SQL, SD_SQL, national, series, t8
from .q_quality import KM
from .registry import GRID_DAILY_SQL, R, STATION_XY_SQL, grid_daily, query, r6, station_xy, table

# ---------------------------------------------------------------- flagged station days and weights
FLAG_SQL = f"""{SD_SQL}, s15 AS (SELECT station, (slot - 1 - o + 366) % 366 + 1 AS slot, tmin AS x FROM sd, (SELECT unnest(range(-15, 16)) AS o) offs WHERE year BETWEEN {FIRST} AND {LAST}),
a15 AS (SELECT station, slot, list(x ORDER BY x) AS a FROM s15 GROUP BY 1, 2 HAVING count(*) >= 5), t15 AS (SELECT station, slot, {t8('a', 0.3)} AS p30, {t8('a', 0.1)} AS p10 FROM a15),
flg AS (SELECT sd.station, sd.date, year(sd.date) - CASE WHEN month(sd.date) <= 2 THEN 1 ELSE 0 END AS season, sd.tmin AS value, coalesce(tmin < p30, false) AS cold, coalesce(tmin < p10, false) AS severe, CASE WHEN tmin < p30 THEN p30 - tmin END AS deficit, true AS eligible
  FROM sd LEFT JOIN t15 ON t15.station = sd.station AND t15.slot = sd.slot WHERE month(sd.date) IN (12, 1, 2))"""


def flagged(spark, sf):
    s = series(spark, sf)
    thr = k.calendar_thresholds(s.filter(BASE), ["station"], "tmin", "slot", 15, {"p30": 0.3, "p10": 0.1}, min_obs=5)
    j = s.filter(F.month("date").isin(12, 1, 2)).join(thr.select("station", "slot", "p30", "p10"), ["station", "slot"], "left")
    cold = k.cold_flag(F.col("tmin"), F.col("p30"))
    return j.select("station", "date", cal.season_year(F.col("date")).alias("season"), F.col("tmin").alias("value"), cold.alias("cold"),
                    k.cold_flag(F.col("tmin"), F.col("p10")).alias("severe"), k.deficit(F.col("tmin"), F.col("p30"), cold).alias("deficit"), F.lit(True).alias("eligible"))


PTS_SQL = f"""{STATION_XY_SQL}, pts AS (SELECT i AS id, 20.0::DOUBLE + (i // 20 + 0.5) * 0.2 AS lat, 88.0::DOUBLE + (i % 20 + 0.5) * 0.2 AS lon, cos(radians(20.0::DOUBLE + (i // 20 + 0.5) * 0.2)) * pow(radians(0.2::DOUBLE) * 6371.0088, 2) AS area FROM (SELECT unnest(range(0, 600)) AS i)),
pd AS (SELECT a.id, b.station, a.lat, a.lon, a.area, row_number() OVER (PARTITION BY a.id ORDER BY {KM}, b.station) AS rk FROM pts a, station_xy b), pn AS (SELECT id, station, lat, lon, area FROM pd WHERE rk = 1)"""
W_SQL = PTS_SQL + """, ca AS (SELECT station, sum(area) AS ar FROM pn GROUP BY 1), wts AS (SELECT x.station, coalesce(ar, 0) AS cell_area, coalesce(ar, 0) / (SELECT sum(area) FROM pn) AS weight FROM station_xy x LEFT JOIN ca ON ca.station = x.station)"""


def points(spark, sf):
    return area.nearest_station(area.region_points(spark, 20.0, 26.0, 88.0, 92.0, 0.2), station_xy(spark, sf), 800.0)


def weights(spark, sf):
    return area.area_weights(points(spark, sf), station_xy(spark, sf))


@query("area_weights", "E01 E02", f"WITH {W_SQL} SELECT station, {R('cell_area', 4)} AS cell_area, {R('weight', 8)} AS weight FROM wts")
def _(spark, sf):
    return weights(spark, sf).select("station", r6("cell_area", 4).alias("cell_area"), r6("weight", 8).alias("weight"))


@query("area_weight_issues", "E02", f"""WITH {W_SQL}, n AS (SELECT station FROM station_xy WHERE lat > 20.5 UNION ALL SELECT -1)
SELECT 'sum_not_one' AS issue, CAST(NULL AS VARCHAR) AS station, {R('sum(weight) * 2')} AS value FROM wts HAVING abs(sum(weight) * 2 - 1) > 1e-6
UNION ALL SELECT CASE WHEN n.station IS NULL THEN 'not_in_network' WHEN w.station IS NULL THEN 'no_weight' ELSE 'weight_not_positive' END, CAST(coalesce(n.station, w.station) AS VARCHAR), {R('w.weight * 2')} FROM wts w FULL OUTER JOIN n ON n.station = w.station WHERE n.station IS NULL OR w.station IS NULL OR w.weight <= 0""")
def _(spark, sf):
    w = weights(spark, sf).withColumn("weight", F.col("weight") * 2)
    n = station_xy(spark, sf).filter("lat > 20.5").select("station").unionByName(spark.range(1).select((F.col("id") - 1).alias("station")))
    return area.weight_issues(w, n).withColumn("value", r6("value"))


DAILY_SQL = f"""{FLAG_SQL}, {W_SQL}, dly AS (SELECT date, CAST(any_value(season) AS INTEGER) AS season, count(*) AS observed_count, count(*) FILTER (WHERE cold) AS cold_count, count(*) FILTER (WHERE severe) AS severe_count, sum(weight) AS observed_area, coalesce(sum(weight) FILTER (WHERE cold), 0) AS cold_area, coalesce(sum(weight) FILTER (WHERE severe), 0) AS severe_area,
  CASE WHEN sum(weight) <> 0 THEN sum(value * weight) / sum(weight) END AS weighted_mean, min(value) AS lowest_value, coalesce(sum(deficit * weight) FILTER (WHERE cold), 0) AS weighted_deficit, coalesce(sum(weight) FILTER (WHERE value <= 10), 0) AS mild_area,
  round(sum(weight), 9) >= 0.1 AND count(*) >= 2 AS usable, round(sum(weight), 9) >= 0.1 AND count(*) >= 2 AND round(coalesce(sum(weight) FILTER (WHERE cold), 0), 9) >= 0.065 AS cold_day FROM flg JOIN wts USING (station) GROUP BY 1)"""


def daily(spark, sf, w=None, flags=None):
    d = area.area_diagnostics(flags if flags is not None else flagged(spark, sf), w if w is not None else weights(spark, sf), 0.1, 2, 0.065, {"mild": F.col("value") <= 10})
    return d.withColumn("season", cal.season_year(F.col("date")))


@query("daily_area_diagnostics", "E04", f"""WITH {DAILY_SQL} SELECT date, season, observed_count, cold_count, severe_count, {R('observed_area')} AS observed_area, {R('cold_area')} AS cold_area, {R('severe_area')} AS severe_area, {R('weighted_mean')} AS weighted_mean, lowest_value, {R('weighted_deficit')} AS weighted_deficit, {R('mild_area')} AS mild_area, usable, cold_day FROM dly""")
def _(spark, sf):
    d = daily(spark, sf)
    return d.select("date", "season", "observed_count", "cold_count", "severe_count", "lowest_value", "usable", "cold_day", *[r6(c).alias(c) for c in ("observed_area", "cold_area", "severe_area", "weighted_mean", "weighted_deficit", "mild_area")])


@query("daily_count_diagnostics", "E03", f"""WITH {FLAG_SQL}, g AS (SELECT date, count(*) FILTER (WHERE station >= 5) AS eligible_count, count(*) FILTER (WHERE station >= 5 AND value < 45) AS observed_count, count(*) FILTER (WHERE station >= 5 AND value < 45 AND cold) AS cold_count, count(*) FILTER (WHERE station >= 5 AND value < 45 AND severe) AS severe_count,
  min(value) FILTER (WHERE station >= 5 AND value < 45) AS lowest_value, {R('sum(deficit) FILTER (WHERE station >= 5 AND value < 45 AND cold)')} AS total_deficit FROM flg GROUP BY 1)
SELECT *, {R('CASE WHEN eligible_count <> 0 THEN observed_count / eligible_count END')} AS observed_fraction, {R('CASE WHEN observed_count <> 0 THEN cold_count / observed_count END')} AS cold_fraction,
  coalesce(observed_count >= 3 AND observed_count / eligible_count >= 0.8, false) AS usable, coalesce(observed_count >= 3 AND observed_count / eligible_count >= 0.8 AND cold_count / observed_count >= 0.4, false) AS candidate FROM g""")
def _(spark, sf):
    f = flagged(spark, sf).withColumn("eligible", F.col("station") >= 5).withColumn("value", F.when(F.col("value") < 45, F.col("value")))
    c = area.count_diagnostics(f, 0.8, 3, 0.4)
    return c.withColumn("total_deficit", r6("total_deficit")).withColumn("observed_fraction", r6("observed_fraction")).withColumn("cold_fraction", r6("cold_fraction"))


@query("weighted_anomaly", "E05", f"""WITH {SD_SQL}, {W_SQL}, c AS (SELECT station, slot365, avg(tmin) AS m FROM sd WHERE year BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2), a AS (SELECT sd.station, sd.date, tmin - m AS a FROM sd LEFT JOIN c ON c.station = sd.station AND c.slot365 = sd.slot365),
g AS (SELECT date, sum(a * weight) FILTER (WHERE a IS NOT NULL) AS s, sum(weight) FILTER (WHERE a IS NOT NULL) AS w FROM a JOIN wts USING (station) GROUP BY 1)
SELECT date, {R('w')} AS observed_weight, {R('CASE WHEN round(w, 9) >= 0.12 THEN s / w END')} AS mean_anomaly FROM g""")
def _(spark, sf):
    a = k.calendar_anomaly(series(spark, sf), ["station"], "tmin", "slot365", 0, BASE)
    w = area.weighted_anomaly(a, weights(spark, sf), "anomaly", 0.12)
    return w.select("date", r6("observed_weight").alias("observed_weight"), r6("mean_anomaly").alias("mean_anomaly"))


# ---------------------------------------------------------------- scenarios, runs, catalogue
SCENARIOS = [
    {"id": "PRIMARY", "column": "cold_area", "share": 0.065, "min_days": 3},
    {"id": "LOWER", "column": "cold_area", "share": 0.055, "min_days": 3},
    {"id": "HIGHER", "column": "cold_area", "share": 0.075, "min_days": 3},
    {"id": "SHORT", "column": "cold_area", "share": 0.065, "min_days": 2},
    {"id": "BRIDGED", "column": "cold_area", "share": 0.065, "min_days": 3, "marginal": 0.05},
    {"id": "SEVERE", "column": "severe_area", "share": 0.02, "min_days": 2},
]
_SC = ", ".join(f"('{s['id']}', '{s['column']}', {s['share']}::DOUBLE, {s['min_days']}, {s.get('marginal', 'NULL')}::DOUBLE)" for s in SCENARIOS)
SWEEP_SQL = f"""{DAILY_SQL}, scn(scenario, col, share, min_days, marginal) AS (VALUES {_SC}),
w0 AS (SELECT scenario, min_days, marginal, date, season, usable, round(CASE col WHEN 'cold_area' THEN cold_area ELSE severe_area END, 9) AS area_share, usable AND round(CASE col WHEN 'cold_area' THEN cold_area ELSE severe_area END, 9) >= share AS base_day FROM dly, scn),
w1 AS (SELECT *, coalesce(usable AND NOT base_day AND area_share >= marginal AND lag(base_day) OVER w AND lead(base_day) OVER w AND date - lag(date) OVER w = 1 AND lead(date) OVER w - date = 1, false) AS bridge_day FROM w0 WINDOW w AS (PARTITION BY scenario, season ORDER BY date)),
w2 AS (SELECT *, base_day OR bridge_day AS candidate_day FROM w1),
w3 AS (SELECT *, CASE WHEN candidate_day THEN date - CAST(row_number() OVER (PARTITION BY scenario, season, candidate_day ORDER BY date) AS INTEGER) END AS isl FROM w2),
w4 AS (SELECT *, CASE WHEN candidate_day THEN count(*) OVER (PARTITION BY scenario, season, candidate_day, isl) ELSE 0 END AS candidate_run_length FROM w3),
w5 AS (SELECT *, candidate_day AND candidate_run_length >= min_days AS qualifying FROM w4),
w6 AS (SELECT *, CASE WHEN qualifying THEN dense_rank() OVER (PARTITION BY scenario, season, qualifying ORDER BY isl) END AS event_seq, CASE WHEN qualifying THEN row_number() OVER (PARTITION BY scenario, season, qualifying, isl ORDER BY date) END AS event_day FROM w5),
evd AS (SELECT *, CASE WHEN qualifying THEN scenario || '_' || CAST(season AS VARCHAR) || '_' || lpad(CAST(event_seq AS VARCHAR), 2, '0') END AS event_id FROM w6)"""


def swept(spark, sf):
    """All rule sets over the materialised daily table, which they read several times."""
    return ev.sweep(cut_lineage(daily(spark, sf)), SCENARIOS)


@query("scenario_sweep_days", "E06 E07 E08", f"WITH {SWEEP_SQL} SELECT scenario, date, season, {R('area_share', 7)} AS area_share, base_day, bridge_day, candidate_day, candidate_run_length, qualifying, CAST(event_day AS INTEGER) AS event_day, event_id FROM evd")
def _(spark, sf):
    return swept(spark, sf).select("scenario", "date", "season", r6("area_share", 7).alias("area_share"), "base_day", "bridge_day", "candidate_day", "candidate_run_length", "qualifying", "event_day", "event_id")


METRICS = {"cold_area": ["min", "max", "mean", "sum"], "weighted_deficit": ["sum"], "weighted_mean": ["min"], "cold_count": ["max"], "mild_area": ["sum"]}
CAT_SQL = f"""{SWEEP_SQL}, pdy AS (SELECT e.event_id, e.event_day, e.season, d.* EXCLUDE (season) FROM evd e JOIN dly d USING (date) WHERE e.scenario = 'PRIMARY' AND e.event_id IS NOT NULL),
cat0 AS (SELECT season, event_id, min(date) AS start_date, max(date) AS end_date, count(*) AS duration_days, min(cold_area) AS min_cold_area, max(cold_area) AS max_cold_area, avg(cold_area) AS mean_cold_area, sum(cold_area) AS sum_cold_area, sum(weighted_deficit) AS sum_weighted_deficit, min(weighted_mean) AS min_weighted_mean, max(cold_count) AS max_cold_count, sum(mild_area) AS sum_mild_area FROM pdy GROUP BY 1, 2),
pk AS (SELECT event_id, date AS peak_date FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(cold_area, 9) DESC, cold_count DESC, date) AS rk FROM pdy) WHERE rk = 1),
cat AS (SELECT cat0.*, peak_date, CASE WHEN duration_days = 3 THEN 'short' WHEN duration_days >= 6 THEN 'persistent' ELSE 'intermediate' END AS duration_group FROM cat0 JOIN pk USING (event_id))"""


DAY_COLUMNS = ["observed_count", "cold_count", "severe_count", "observed_area", "cold_area", "severe_area", "weighted_mean", "lowest_value", "weighted_deficit", "mild_area"]


def primary_days(spark, sf, d=None):
    d = d if d is not None else daily(spark, sf)
    return ev.sweep(d, SCENARIOS[:1], keep=DAY_COLUMNS).filter("event_id IS NOT NULL")


def primary_plan(spark, sf, d=None):
    return ev.catalogue(primary_days(spark, sf, d), ["season"], METRICS, "cold_area", "cold_count")


def primary(spark, sf, d=None):
    """The catalogue as a materialised stage: later steps read it several times."""
    return cut_lineage(primary_plan(spark, sf, d))


def daily_and_primary(spark, sf):
    """The daily table and the catalogue made from it, both materialised: the days are worked out once."""
    d = cut_lineage(daily(spark, sf))
    return d, primary(spark, sf, d)


@query("event_catalogue_area_weighted", "E09 E10", f"""WITH {CAT_SQL} SELECT season, event_id, start_date, end_date, duration_days, peak_date, duration_group, max_cold_count, {', '.join(R(c) + ' AS ' + c for c in ('min_cold_area', 'max_cold_area', 'mean_cold_area', 'sum_cold_area', 'sum_weighted_deficit', 'min_weighted_mean', 'sum_mild_area'))} FROM cat""")
def _(spark, sf):
    c = primary_plan(spark, sf)
    return c.select("season", "event_id", "start_date", "end_date", "duration_days", "peak_date", "duration_group", "max_cold_count",
                    *[r6(x).alias(x) for x in ("min_cold_area", "max_cold_area", "mean_cold_area", "sum_cold_area", "sum_weighted_deficit", "min_weighted_mean", "sum_mild_area")])


MEM_SQL = f"""{CAT_SQL}, mem AS (SELECT f.*, e.event_id, e.event_day, coalesce(e.event_id IS NOT NULL AND f.cold, false) AS participates FROM flg f LEFT JOIN (SELECT * FROM evd WHERE scenario = 'PRIMARY' AND event_id IS NOT NULL) e ON e.date = f.date)"""


def members(spark, sf, flags=None, d=None):
    return ev.with_membership(flags if flags is not None else flagged(spark, sf), primary_days(spark, sf, d))


@query("event_membership", "E13", f"WITH {MEM_SQL} SELECT station, date, event_id, participates FROM mem")
def _(spark, sf):
    return members(spark, sf).select("station", "date", "event_id", "participates")


@query("event_footprint", "E11", f"WITH {MEM_SQL} SELECT event_id, count(*) AS station_count, {R('sum(weight)')} AS footprint_area FROM (SELECT DISTINCT event_id, station FROM mem WHERE participates) JOIN wts USING (station) GROUP BY 1")
def _(spark, sf):
    return ev.footprint(members(spark, sf), weights(spark, sf)).withColumn("footprint_area", r6("footprint_area"))


@query("event_footprint_shape", "E29", f"""WITH {MEM_SQL}, h AS (SELECT DISTINCT event_id, station FROM mem WHERE participates)
SELECT event_id, {R('sum(lat * area) / sum(area)')} AS centroid_lat, {R('sum(lon * area) / sum(area)')} AS centroid_lon, {R('max(lon * cos(radians(lat)) * 111.195) - min(lon * cos(radians(lat)) * 111.195)', 4)} AS east_west_km, {R('max(lat * 111.195) - min(lat * 111.195)', 4)} AS north_south_km FROM h JOIN pn USING (station) GROUP BY 1""")
def _(spark, sf):
    s = ev.footprint_shape(members(spark, sf), points(spark, sf))
    return s.select("event_id", r6("centroid_lat").alias("centroid_lat"), r6("centroid_lon").alias("centroid_lon"), r6("east_west_km", 4).alias("east_west_km"), r6("north_south_km", 4).alias("north_south_km"))


@query("station_participation", "E12", f"""WITH {MEM_SQL} SELECT m.event_id, m.station, count(*) AS cold_days, min(date) AS first_cold_date, max(date) AS last_cold_date, min(value) AS lowest_value, {R('sum(deficit)')} AS total_deficit, {R('count(*) * any_value(weight)')} AS weighted_days, {R('count(*) / any_value(duration_days)')} AS share_of_event
FROM mem m JOIN cat USING (event_id) JOIN wts ON wts.station = m.station WHERE participates GROUP BY 1, 2""")
def _(spark, sf):
    f, w = stage_table(flagged(spark, sf)), stage_table(weights(spark, sf))
    d = cut_lineage(daily(spark, sf, w, f))
    p = ev.participation(members(spark, sf, f, d), primary(spark, sf, d), w)
    return p.select("event_id", "station", "cold_days", "first_cold_date", "last_cold_date", "lowest_value", *[r6(c).alias(c) for c in ("total_deficit", "weighted_days", "share_of_event")])


@query("catalogue_issues", "E14", f"""WITH {CAT_SQL}, e AS (SELECT * FROM pdy WHERE day(date) <> 10), p AS (SELECT event_id, count(*) AS n, min(date) AS a, max(date) AS b, min(round(cold_area, 9)) AS low FROM e GROUP BY 1), j AS (SELECT coalesce(p.event_id, cat.event_id) AS event_id, n, a, b, low, start_date, end_date, duration_days FROM p FULL OUTER JOIN cat ON cat.event_id = p.event_id)
SELECT event_id, 'missing_side' AS issue FROM j WHERE n IS NULL UNION ALL SELECT event_id, 'not_contiguous' FROM j WHERE b - a + 1 <> n UNION ALL SELECT event_id, 'catalogue_differs' FROM j WHERE a <> start_date OR b <> end_date OR duration_days <> n
UNION ALL SELECT event_id, 'too_short' FROM j WHERE n < 3 UNION ALL SELECT event_id, 'below_threshold' FROM j WHERE low < 0.07""")
def _(spark, sf):
    d = cut_lineage(primary_days(spark, sf))
    return ev.catalogue_issues(d.filter(F.dayofmonth("date") != 10), ev.catalogue(d, ["season"], {}, "cold_area", "cold_count"), 3, 0.07)


@query("season_summary", "E15", f"""WITH {CAT_SQL}, s AS (SELECT unnest(range(1993, 2003)) AS season)
SELECT CAST(s.season AS INTEGER) AS season, count(event_id) AS event_count, CAST(coalesce(sum(duration_days), 0) AS BIGINT) AS event_day_count, coalesce(max(duration_days), 0) AS longest_event, {R('avg(duration_days)')} AS mean_duration FROM s LEFT JOIN cat ON cat.season = s.season GROUP BY 1""")
def _(spark, sf):
    seasons = spark.range(1993, 2003).select(F.col("id").cast("int").alias("season"))
    return ev.season_summary(primary(spark, sf), seasons, ["season"]).withColumn("mean_duration", r6("mean_duration"))


CMP_SQL = f"""{CAT_SQL}, pe AS (SELECT DISTINCT event_id, season, date FROM evd WHERE scenario = 'PRIMARY' AND event_id IS NOT NULL), oe AS (SELECT DISTINCT scenario, event_id AS oid, season, date FROM evd WHERE scenario <> 'PRIMARY' AND event_id IS NOT NULL),
np AS (SELECT event_id, count(*) AS pn FROM pe GROUP BY 1), no AS (SELECT scenario, oid, count(*) AS mn FROM oe GROUP BY 1, 2),
mm AS (SELECT oe.scenario, pe.event_id, oe.oid, count(*) AS x FROM pe JOIN oe ON oe.season = pe.season AND oe.date = pe.date GROUP BY 1, 2, 3),
m2 AS (SELECT mm.*, pn, mn, x / (pn + mn - x) AS jac, count(*) OVER (PARTITION BY mm.scenario, mm.event_id) AS k, row_number() OVER (PARTITION BY mm.scenario, mm.event_id ORDER BY x DESC, x / (pn + mn - x) DESC, x / pn DESC, mm.oid) AS rk FROM mm JOIN np ON np.event_id = mm.event_id JOIN no ON no.scenario = mm.scenario AND no.oid = mm.oid),
cmp AS (SELECT s.scenario, np.event_id, np.pn AS primary_duration, coalesce(oid, '') AS matching_event_id, coalesce(k, 0) AS overlapping_events, coalesce(x, 0) AS intersection_days, coalesce(mn, 0) AS matching_duration, coalesce(x / np.pn, 0) AS primary_overlap, coalesce(x / mn, 0) AS matching_overlap, coalesce(jac, 0) AS jaccard,
  coalesce(x = np.pn AND x = mn, false) AS exact_match, coalesce(x / np.pn >= 0.5, false) AS reproduced FROM np CROSS JOIN (SELECT DISTINCT scenario FROM oe) s LEFT JOIN m2 ON m2.scenario = s.scenario AND m2.event_id = np.event_id AND rk = 1)"""


def compared(spark, sf, days=None):
    days = (days if days is not None else swept(spark, sf)).filter("event_id IS NOT NULL")
    return ev.compare_sets(days.filter("scenario = 'PRIMARY'"), days.filter("scenario <> 'PRIMARY'"), by=["scenario"])


@query("event_set_comparison", "E16", f"WITH {CMP_SQL} SELECT scenario, event_id, primary_duration, matching_event_id, overlapping_events, intersection_days, matching_duration, {R('primary_overlap')} AS primary_overlap, {R('matching_overlap')} AS matching_overlap, {R('jaccard')} AS jaccard, exact_match, reproduced FROM cmp")
def _(spark, sf):
    c = compared(spark, sf)
    for x in ("primary_overlap", "matching_overlap", "jaccard"):
        c = c.withColumn(x, r6(x))
    return c


def _scenario_catalogue(spark, sf, days, name):
    e = days.filter((F.col("scenario") == name) & F.col("event_id").isNotNull())
    return ev.catalogue(e.withColumn("one", F.lit(1)), ["season"], {"area_share": ["max"]}, "area_share", "one")


@query("signature_difference", "E17", f"""WITH {SWEEP_SQL}, a AS (SELECT min(date) AS start_date, max(date) AS end_date, count(*) AS duration_days FROM evd WHERE scenario = 'PRIMARY' AND event_id IS NOT NULL GROUP BY event_id), b AS (SELECT min(date) AS start_date, max(date) AS end_date, count(*) AS duration_days FROM evd WHERE scenario = 'BRIDGED' AND event_id IS NOT NULL GROUP BY event_id)
SELECT *, 'first_only' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second_only' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(spark, sf):
    d = swept(spark, sf)
    return ev.signature_difference(_scenario_catalogue(spark, sf, d, "PRIMARY"), _scenario_catalogue(spark, sf, d, "BRIDGED"))


ROBUST_SQL = f"""{CMP_SQL}, rob AS (SELECT event_id, count(DISTINCT scenario) AS scenarios_tested, count(*) FILTER (WHERE reproduced) AS scenarios_reproduced, count(*) FILTER (WHERE exact_match) AS exact_matches, avg(primary_overlap) AS mo, min(primary_overlap) AS lo, avg(jaccard) AS mj,
  count(*) FILTER (WHERE reproduced) / count(DISTINCT scenario) AS rf FROM cmp GROUP BY 1), robc AS (SELECT *, CASE WHEN rf >= 0.8 THEN 'high' WHEN rf >= 0.5 THEN 'moderate' ELSE 'low' END AS robustness_class FROM rob)"""


@query("event_robustness", "E18", f"WITH {ROBUST_SQL} SELECT event_id, scenarios_tested, scenarios_reproduced, exact_matches, {R('mo')} AS mean_overlap, {R('lo')} AS lowest_overlap, {R('mj')} AS mean_jaccard, {R('rf')} AS robust_fraction, robustness_class FROM robc")
def _(spark, sf):
    r = ev.robustness(compared(spark, sf))
    for x in ("mean_overlap", "lowest_overlap", "mean_jaccard", "robust_fraction"):
        r = r.withColumn(x, r6(x))
    return r


RANKED = ("duration_days", "max_cold_area", "sum_cold_area", "sum_weighted_deficit")


@query("event_strength_ranks", "E19", f"""WITH {CAT_SQL}, r AS (SELECT event_id, {', '.join(f"rank() OVER (ORDER BY round({m}::DOUBLE, 8) DESC) AS {m}_rank" for m in RANKED)} FROM cat), s AS (SELECT *, {' + '.join(m + '_rank' for m in RANKED)} AS rank_sum FROM r) SELECT *, rank() OVER (ORDER BY rank_sum) AS strength_rank FROM s""")
def _(spark, sf):
    c = primary(spark, sf)
    c = c.select("event_id", *[F.round(F.col(m).cast("double"), 8).alias(m) for m in RANKED])
    return ev.strength_ranks(c, list(RANKED)).drop(*RANKED)


@query("frozen_event_days", "E20", f"""WITH {ROBUST_SQL}, f AS (SELECT cat.event_id, start_date, end_date, robustness_class, CAST(start_date - 10 AS DATE) AS window_start, CAST(end_date + 10 AS DATE) AS window_end FROM cat LEFT JOIN robc USING (event_id))
SELECT event_id, start_date, end_date, robustness_class, window_start, window_end, CAST(d AS DATE) AS date, CAST(CAST(d AS DATE) - start_date AS INTEGER) AS "offset" FROM (SELECT *, unnest(generate_series(window_start, window_end, INTERVAL 1 DAY)) AS d FROM f)""")
def _(spark, sf):
    dl = cut_lineage(daily(spark, sf))
    d = ev.sweep(dl, SCENARIOS)
    fr = ev.freeze(ev.catalogue(primary_days(spark, sf, dl), ["season"], {}, "cold_area", "cold_count"), ev.robustness(compared(spark, sf, d)))
    return ev.event_days(fr, 10, 10, ["robustness_class", "window_start", "window_end"])


@query("overlap_flags", "E21", f"""WITH {SWEEP_SQL}, a AS (SELECT event_id, min(date) AS s, max(date) AS e FROM evd WHERE scenario = 'PRIMARY' AND event_id IS NOT NULL GROUP BY 1), b AS (SELECT event_id, min(date) AS s, max(date) AS e FROM evd WHERE scenario = 'SEVERE' AND event_id IS NOT NULL GROUP BY 1)
SELECT event_id, s AS start_date, EXISTS (SELECT 1 FROM b WHERE a.s <= b.e AND a.e >= b.s) AS overlaps FROM a""")
def _(spark, sf):
    d = swept(spark, sf)
    return ev.overlap_flags(_scenario_catalogue(spark, sf, d, "PRIMARY"), _scenario_catalogue(spark, sf, d, "SEVERE")).select("event_id", "start_date", "overlaps")


@query("pure_events_and_days", "E21 E28", f"""WITH {SWEEP_SQL}, a AS (SELECT DISTINCT date FROM evd WHERE scenario = 'SHORT' AND event_id IS NOT NULL), b AS (SELECT DISTINCT date FROM evd WHERE scenario = 'SEVERE' AND event_id IS NOT NULL)
SELECT coalesce(a.date, b.date) AS date, CASE WHEN b.date IS NULL THEN 'first_only' WHEN a.date IS NULL THEN 'second_only' ELSE 'shared' END AS day_class FROM a FULL OUTER JOIN b ON a.date = b.date""")
def _(spark, sf):
    d = swept(spark, sf)
    return ev.day_differences(_scenario_catalogue(spark, sf, d, "SHORT"), _scenario_catalogue(spark, sf, d, "SEVERE"))


@query("event_lag_coverage", "E22", f"""WITH {CAT_SQL}, l AS (SELECT event_id, start_date, end_date, g AS lag, CAST(start_date + CAST(g AS INTEGER) AS DATE) AS date FROM cat, (SELECT unnest(range(-45, 16)) AS g)), c AS (SELECT *, CASE WHEN lag < -10 THEN 'extended_precursor_minus45_to_minus11' WHEN lag < 0 THEN 'synoptic_precursor_minus10_to_minus1' WHEN lag < end_date - start_date + 1 THEN 'event_period' ELSE 'post_event' END AS lag_class FROM l)
SELECT event_id, lag_class, count(*) AS day_count, count(d.date) AS available_count, count(*) = count(d.date) AS complete FROM c LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 300000) d ON d.date = c.date GROUP BY 1, 2""")
def _(spark, sf):
    lags = ev.event_lags(primary(spark, sf), -45, 15)
    have = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.to_date("o_orderdate").alias("date"))
    return ev.lag_coverage(lags, have)


# ---------------------------------------------------------------- sign reversals and episodes
REV_SQL = f"""{NATION_SQL}, sr AS (SELECT date, avg(y) OVER w - 25.45 AS u, x, count(y) OVER w AS n FROM nat WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND CURRENT ROW)),
r0 AS (SELECT date, round(u, 9) AS u, x, round(u, 9) > 0 AS pos, row_number() OVER (ORDER BY date) AS n FROM sr WHERE n = 15),
r1 AS (SELECT *, CASE WHEN pos THEN n - row_number() OVER (PARTITION BY pos ORDER BY date) END AS run FROM r0), r2 AS (SELECT *, CASE WHEN pos THEN row_number() OVER (PARTITION BY pos, run ORDER BY date) END AS atn FROM r1),
r3 AS (SELECT *, sum(CASE WHEN atn = 8 THEN 1 ELSE 0 END) OVER (ORDER BY date) AS done, u < 0 AND lag(u) OVER (ORDER BY date) >= 0 AND date - lag(date) OVER (ORDER BY date) = 1 AND month(date) IN (11, 12, 1, 2, 3) AS c,
  min(CASE WHEN atn = 4 THEN date END) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM r2),
r4 AS (SELECT *, row_number() OVER (PARTITION BY done ORDER BY date) AS k FROM r3 WHERE c AND nx <= make_date(year(date) + CASE WHEN month(date) <= 4 THEN 0 ELSE 1 END, 4, 30)),
rev AS (SELECT date AS central_date, u AS central_value FROM r4 WHERE k = 1)"""


def reversal_series(spark, sf):
    n = k.trailing_mean(national(spark, sf), [], "date", "y", 15, "u").filter("u IS NOT NULL")
    return n.select("date", F.round(F.col("u") - 25.45, 9).alias("u"), "x")


@query("sign_reversals", "E23", f"WITH {REV_SQL} SELECT central_date, {R('central_value')} AS central_value FROM rev")
def _(spark, sf):
    return ev.sign_reversals(reversal_series(spark, sf), "u", 8, 4).withColumn("central_value", r6("central_value"))


@query("reversal_attributes", "E24", f"""WITH {REV_SQL}, ng AS (SELECT date, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY u < 0 ORDER BY date) AS g, u < 0 AS neg FROM r0), ln AS (SELECT min(date) AS central_date, count(*) AS n FROM ng WHERE neg GROUP BY g)
SELECT rev.central_date, {R('any_value(central_value)')} AS central_value, any_value(ln.n) AS negative_run_days, {R('min(r0.u) FILTER (WHERE r0.date >= rev.central_date)')} AS lowest_next, {R('avg(r0.x) FILTER (WHERE r0.date <= rev.central_date)')} AS mean_previous
FROM rev LEFT JOIN ln USING (central_date) JOIN r0 ON r0.date BETWEEN rev.central_date - 10 AND rev.central_date + 10 GROUP BY 1""")
def _(spark, sf):
    s = reversal_series(spark, sf)
    a = ev.reversal_attributes(ev.sign_reversals(s, "u", 8, 4), s, "u", "x")
    return a.select("central_date", "negative_run_days", *[r6(c).alias(c) for c in ("central_value", "lowest_next", "mean_previous")])


@query("nearest_reference_dates", "E25", f"""WITH {REV_SQL}, rf AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS reference_date FROM orders), j AS (SELECT reference_date, central_date, row_number() OVER (PARTITION BY reference_date ORDER BY abs(central_date - reference_date), central_date) AS rk FROM rf, rev)
SELECT reference_date, central_date AS nearest_date, CAST(central_date - reference_date AS INTEGER) AS offset_days, central_date = reference_date AS exact_match, abs(central_date - reference_date) <= 1 AS within_1_day, abs(central_date - reference_date) <= 2 AS within_2_days FROM j WHERE rk = 1""")
def _(spark, sf):
    ref = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("reference_date")).distinct()
    return ev.nearest_dates(ref, ev.sign_reversals(reversal_series(spark, sf), "u", 8, 4))


@query("index_episodes", "E26", f"""WITH {GRID_DAILY_SQL}, g AS (SELECT time, lon, avg(t) AS v FROM grid GROUP BY 1, 2), c AS (SELECT lon, quantile_cont(v, 0.6) AS q FROM g GROUP BY 1), f AS (SELECT g.*, q, year(time) AS yr FROM g JOIN c USING (lon) WHERE v > q),
i AS (SELECT *, time - CAST(row_number() OVER (PARTITION BY lon, yr ORDER BY time) AS INTEGER) AS isl FROM f), r AS (SELECT *, count(*) OVER (PARTITION BY lon, yr, isl) AS n FROM i), k AS (SELECT *, dense_rank() OVER (PARTITION BY lon, yr ORDER BY isl) AS event_seq, row_number() OVER (PARTITION BY lon, yr, isl ORDER BY v DESC, time) AS rk FROM r WHERE n >= 3)
SELECT lon, CAST(yr AS INTEGER) AS year, event_seq, min(time) AS start_date, max(time) AS end_date, count(*) AS duration_days, {R('avg(v)')} AS mean_value, {R('max(v)')} AS max_value, {R('sum(v - q)')} AS excess_sum, min(CASE WHEN rk = 1 THEN time END) AS peak_date FROM k GROUP BY 1, 2, 3""")
def _(spark, sf):
    g = grid_daily(spark, sf).groupBy("time", "lon").agg(F.avg("t").alias("v"))
    c = g.groupBy("lon").agg(F.percentile("v", 0.6).alias("q"))
    d = g.join(c, "lon").withColumn("year", F.year("time"))
    e = ev.episodes(d, ["lon", "year"], "v", "q", 3, "time")
    return e.withColumn("mean_value", r6("mean_value")).withColumn("max_value", r6("max_value")).withColumn("excess_sum", r6("excess_sum"))


@query("period_summary", "E27", f"""WITH {CAT_SQL} SELECT CAST(floor((season - 1995) / 3.0) * 3 + 1995 AS INTEGER) AS period, count(*) AS event_count, {R('avg(duration_days)')} AS mean_duration, {R('median(duration_days)')} AS median_duration, count(*) FILTER (WHERE duration_days >= 6) AS persistent_events, count(*) FILTER (WHERE duration_days = 3) AS short_events FROM cat GROUP BY 1""")
def _(spark, sf):
    from ..functions.numeric import decade_bin
    p = ev.period_summary(primary(spark, sf), decade_bin(F.col("season"), 1995, 3))
    return p.withColumn("mean_duration", r6("mean_duration")).withColumn("median_duration", r6("median_duration"))


SUB_SQL = f"""{FLAG_SQL}, {STATION_XY_SQL}, sx AS (SELECT * FROM station_xy WHERE lat < 24), pts AS (SELECT i AS id, 20.0::DOUBLE + (i // 20 + 0.5) * 0.2 AS lat, 88.0::DOUBLE + (i % 20 + 0.5) * 0.2 AS lon, cos(radians(20.0::DOUBLE + (i // 20 + 0.5) * 0.2)) AS area FROM (SELECT unnest(range(0, 600)) AS i)),
pd AS (SELECT a.id, b.station, a.area, row_number() OVER (PARTITION BY a.id ORDER BY {KM}, b.station) AS rk FROM pts a, sx b), wts AS (SELECT station, sum(area) / (SELECT sum(area) FROM pd WHERE rk = 1) AS weight FROM pd WHERE rk = 1 GROUP BY 1),
d AS (SELECT date, CAST(any_value(season) AS INTEGER) AS season, coalesce(round(sum(weight), 9) >= 0.1 AND count(*) >= 2 AND round(coalesce(sum(weight) FILTER (WHERE cold), 0), 9) >= 0.065, false) AS f FROM flg JOIN wts USING (station) GROUP BY 1),
i AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY season ORDER BY date) AS INTEGER) AS isl FROM d WHERE f)
SELECT season, min(date) AS start_date, max(date) AS end_date, count(*) AS duration_days FROM i GROUP BY season, isl HAVING count(*) >= 3"""


@query("sub_network_catalogue", "E28", f"WITH {SUB_SQL}")
def _(spark, sf):
    st = station_xy(spark, sf).filter("lat < 24")
    w = area.area_weights(area.nearest_station(area.region_points(spark, 20.0, 26.0, 88.0, 92.0, 0.2), st, 800.0), st)
    d = ev.assign_runs(daily(spark, sf, w), ["season"], "cold_day", 3).filter("qualifying")
    return d.groupBy("season", "event_seq").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("duration_days")).drop("event_seq")
