"""Quality control."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import climatology as k, quality as qc
from ..plans.nearest import nearest_k
from ..session import stage_table
from .q_climate import BASE, FIRST, LAST, SD_SQL, S365, moments_sql, series
from .q_reconcile import RECONCILED_SQL, collapsed, reconciled
from .registry import R, STATION_DAILY_SQL, STATION_XY_SQL, query, r6, station_daily, station_xy

KEYS = ["station", "date"]

# ---------------------------------------------------------------- first pass and ledgers
PASS_SQL = f"""{RECONCILED_SQL}, {STATION_DAILY_SQL}, fp_in AS (SELECT r.*, r.selected_value AS tmin, s.tmax / 2 AS tmax, coalesce(c.duplicate_status, '') AS duplicate_status
  FROM reconciled r JOIN station_daily s ON s.station = r.station AND s.date = r.date LEFT JOIN (SELECT * FROM collapsed WHERE source_no = 0) c ON c.station = r.station AND c.date = r.date),
fp0 AS (SELECT *, tmin IS NULL AS tmin_missing, tmax IS NULL AS tmax_missing, coalesce(tmin = 0, false) AS tmin_zero, coalesce(tmin = 0 AND month(date) IN (12, 1, 2), false) AS tmin_zero_season,
  coalesce(tmin NOT BETWEEN 2 AND 40, false) AS tmin_physical_range, coalesce(tmax NOT BETWEEN 0 AND 48, false) AS tmax_physical_range, coalesce(tmax - tmin < 0, false) AS tmax_lt_tmin,
  coalesce(abs(tmax - tmin) <= 1e-9, false) AS dtr_zero, coalesce(tmax - tmin > 30, false) AS dtr_high, contains(duplicate_status, 'conflict') AS duplicate_conflict,
  contains(reconciliation_status, 'numeric_conflict') AS source_numeric_conflict, contains(reconciliation_status, 'conflicting_duplicate') AS source_duplicate_conflict FROM fp_in),
fp1 AS (SELECT *, tmin_physical_range OR tmax_physical_range OR tmax_lt_tmin OR duplicate_conflict AS critical, tmin_zero_season OR source_numeric_conflict OR source_duplicate_conflict AS high,
   tmin_zero OR dtr_zero OR dtr_high AS soft FROM fp0),
fp AS (SELECT *, critical OR high OR soft AS need, CASE WHEN critical THEN 'critical' WHEN high THEN 'high' WHEN soft THEN 'review' ELSE 'none' END AS priority,
  CASE WHEN critical OR high OR soft THEN 'review_required' WHEN tmin_missing OR tmax_missing THEN 'pass_with_missing_data' ELSE 'pass_stage1' END AS status,
  concat_ws(';', CASE WHEN tmin_missing THEN 'TMIN_MISSING' END, CASE WHEN tmax_missing THEN 'TMAX_MISSING' END, CASE WHEN tmin_zero THEN 'TMIN_ZERO' END, CASE WHEN tmin_physical_range THEN 'TMIN_PHYSICAL_RANGE' END,
   CASE WHEN tmax_physical_range THEN 'TMAX_PHYSICAL_RANGE' END, CASE WHEN tmax_lt_tmin THEN 'TMAX_LT_TMIN' END, CASE WHEN dtr_zero THEN 'DTR_ZERO' END, CASE WHEN dtr_high THEN 'DTR_HIGH' END,
   CASE WHEN duplicate_conflict THEN 'OLD_DUPLICATE_CONFLICT' END, CASE WHEN source_numeric_conflict THEN 'SOURCE_NUMERIC_CONFLICT' END) AS flag_codes FROM fp1)"""


def passed(spark, sf):
    r = reconciled(spark, sf).join(station_daily(spark, sf).select("station", "date", (F.col("tmax") / 2).alias("tmax")), KEYS)
    r = r.join(collapsed(spark, sf, 0).select("station", "date", "duplicate_status"), KEYS, "left").withColumn("tmin", F.col("selected_value"))
    return qc.first_pass(r, (2.0, 40.0), (0.0, 48.0), 30.0)


@query("first_pass_flags", "Q01 Q02", f"""WITH {PASS_SQL} SELECT station, date, flag_codes, CAST(CASE WHEN flag_codes = '' THEN 0 ELSE len(string_split(flag_codes, ';')) END AS INTEGER) AS flag_count, priority, status, tmin_zero_season, source_duplicate_conflict FROM fp""")
def _(spark, sf):
    return passed(spark, sf).select("station", "date", "flag_codes", "flag_count", "priority", "status", "tmin_zero_season", "source_duplicate_conflict")


def _pl(x):
    return f"coalesce({x} BETWEEN 2 AND 40 AND abs({x}) > 1e-9 AND (tmax IS NULL OR tmax - {x} BETWEEN 0.5 AND 30), false)"


def _alt(x):
    return f"({_pl(x)} AND (tmin IS NULL OR abs({x} - tmin) > 1e-6))"


def _swap(default):
    return f"CASE WHEN {_alt('new_value')} THEN 'select_new_tmin' WHEN {_alt('old_value')} THEN 'select_old_tmin' ELSE '{default}' END"


DEC_SQL = f"""{PASS_SQL}, led AS (SELECT *, 'VALUE|' || CAST(station AS VARCHAR) || '|' || strftime(date, '%Y-%m-%d') AS review_id,
  CASE WHEN tmax_lt_tmin OR dtr_zero THEN 'check_pair' WHEN tmin_physical_range OR tmax_physical_range THEN 'check_value' WHEN tmin_zero THEN 'verify_zero' WHEN duplicate_conflict OR source_numeric_conflict THEN 'choose_source' ELSE 'keep_unless_evidence' END AS recommended_action,
  CASE WHEN tmin_physical_range AND tmax_physical_range THEN 'set_both_missing' WHEN tmax_lt_tmin THEN {_swap('set_both_missing')} WHEN dtr_zero THEN {_swap('set_both_missing')}
   WHEN tmin_physical_range OR tmin_zero THEN {_swap('set_tmin_missing')} WHEN tmax_physical_range THEN 'set_tmax_missing'
   WHEN duplicate_conflict THEN CASE WHEN {_pl('new_value')} THEN 'select_new_tmin' ELSE 'set_tmin_missing' END
   WHEN source_numeric_conflict OR source_duplicate_conflict THEN CASE WHEN {_pl('new_value')} THEN 'select_new_tmin' WHEN {_pl('old_value')} THEN 'select_old_tmin' ELSE 'set_tmin_missing' END ELSE 'keep' END AS decision
  FROM fp WHERE need)"""


def ledger(spark, sf):
    return qc.automatic_decisions(qc.review_ledger(passed(spark, sf), KEYS), (2.0, 40.0))


@query("review_ledger", "Q03 Q04", f"WITH {DEC_SQL} SELECT review_id, recommended_action, decision, 'completed' AS review_status FROM led")
def _(spark, sf):
    return ledger(spark, sf).select("review_id", "recommended_action", "decision", "review_status")


@query("ledger_issues", "Q05", f"""WITH {DEC_SQL}, b AS (SELECT review_id, CASE WHEN priority = 'high' THEN 'guess' ELSE decision END AS decision, CASE WHEN month(date) = 1 THEN 'pending' ELSE 'completed' END AS review_status, CASE WHEN day(date) = 5 THEN '' ELSE 'auto' END AS reviewer FROM led),
d AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE decision = 'set_tmax_missing')
SELECT review_id, 'pending' AS issue FROM d WHERE review_status <> 'completed' UNION ALL SELECT review_id, 'invalid_decision' FROM d WHERE decision = 'guess'
UNION ALL SELECT review_id, 'missing_reviewer' FROM d WHERE reviewer = '' UNION ALL SELECT review_id, 'duplicate_review_id' FROM d GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    b = ledger(spark, sf).select("review_id", F.when(F.col("priority") == "high", "guess").otherwise(F.col("decision")).alias("decision"),
                                 F.when(F.month("date") == 1, "pending").otherwise("completed").alias("review_status"),
                                 F.when(F.dayofmonth("date") == 5, "").otherwise("auto").alias("reviewer"), F.lit("x").alias("decision_reason"))
    return qc.ledger_issues(b.unionByName(b.filter("decision = 'set_tmax_missing'")))


#: The decisions come from the flagged rows that they are joined with; both are read once.
ONCE_SQL = DEC_SQL.replace(" fp AS (", " fp AS MATERIALIZED (").replace(" led AS (", " led AS MATERIALIZED (")


@query("value_decisions_applied", "Q06", f"""WITH {ONCE_SQL}, j AS (SELECT fp.station, fp.date, fp.tmin, fp.tmax, coalesce(led.decision, 'not_reviewed') AS decision, led.old_value AS ov, led.new_value AS nv FROM fp LEFT JOIN led ON led.station = fp.station AND led.date = fp.date),
x AS (SELECT *, CASE WHEN decision IN ('set_tmin_missing', 'set_both_missing') THEN NULL WHEN decision = 'select_old_tmin' THEN ov WHEN decision = 'select_new_tmin' THEN nv ELSE tmin END AS tmin_clean,
  CASE WHEN decision IN ('set_tmax_missing', 'set_both_missing') THEN NULL ELSE tmax END AS tmax_clean FROM j)
SELECT station, date, decision, {R('tmin_clean')} AS tmin_clean, {R('tmax_clean')} AS tmax_clean, tmin IS DISTINCT FROM tmin_clean AS tmin_changed, tmax IS DISTINCT FROM tmax_clean AS tmax_changed FROM x""")
def _(spark, sf):
    out = qc.apply_value_decisions(passed(spark, sf), ledger(spark, sf), KEYS)
    return out.select("station", "date", "decision", r6("tmin_clean").alias("tmin_clean"), r6("tmax_clean").alias("tmax_clean"), "tmin_changed", "tmax_changed")


@query("date_decisions_applied", "Q07", f"""WITH {SD_SQL}, base AS (SELECT station, date, tmin FROM sd WHERE day(date) <= 28),
dec AS (SELECT station, date, tmin + 100 AS tmin, CASE WHEN tmin < 10 THEN 'replace_existing' WHEN tmin < 40 THEN 'insert_corrected_date' ELSE 'reject_row' END AS date_decision FROM sd WHERE day(date) >= 28)
SELECT station, date, {R('tmin')} AS tmin, 'original' AS row_origin FROM base b WHERE NOT EXISTS (SELECT 1 FROM dec d WHERE d.station = b.station AND d.date = b.date AND d.date_decision = 'replace_existing')
UNION ALL SELECT station, date, {R('tmin')}, 'replaced' FROM dec WHERE date_decision = 'replace_existing'
UNION ALL SELECT d.station, d.date, {R('d.tmin')}, CASE WHEN b.station IS NULL THEN 'inserted' ELSE 'insert_collision' END FROM dec d LEFT JOIN base b ON b.station = d.station AND b.date = d.date WHERE date_decision = 'insert_corrected_date'""")
def _(spark, sf):
    s = series(spark, sf).select("station", "date", "tmin")
    what = F.when(F.col("tmin") < 10, "replace_existing").when(F.col("tmin") < 40, "insert_corrected_date").otherwise("reject_row")
    dec = s.filter(F.dayofmonth("date") >= 28).select("station", "date", (F.col("tmin") + 100).alias("tmin"), what.alias("date_decision"))
    out = qc.apply_date_decisions(s.filter(F.dayofmonth("date") <= 28), dec, KEYS, ["tmin"])
    return out.withColumn("tmin", r6("tmin"))


# ---------------------------------------------------------------- climatological and temporal
@query("baseline_coverage", "Q08", f"""WITH {SD_SQL} SELECT station, min(date) FILTER (WHERE c) AS first_date, max(date) FILTER (WHERE c) AS last_date, count(*) FILTER (WHERE c) AS observation_count, count(DISTINCT year) FILTER (WHERE c) AS year_count,
  count(DISTINCT year) FILTER (WHERE c) >= 4 AS eligible FROM (SELECT *, date BETWEEN DATE '1995-06-01' AND DATE '1999-12-31' AND tmin < 12 AS c FROM sd) GROUP BY 1""")
def _(spark, sf):
    s = series(spark, sf).withColumn("tmin", F.when(F.col("tmin") < 12, F.col("tmin")))
    return qc.baseline_coverage(s, "station", "tmin", "1995-06-01", "1999-12-31", 4)


ROB_SQL = f"""{SD_SQL}, rs AS (SELECT station, (slot - 1 - o + 366) % 366 + 1 AS slot, tmin AS x FROM sd, (SELECT unnest(range(-15, 16)) AS o) offs WHERE year BETWEEN {FIRST} AND {LAST}),
rm AS (SELECT station, slot, count(*) AS n, median(x) AS med, quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.99) AS p99 FROM rs GROUP BY 1, 2 HAVING count(*) >= 10),
ry AS (SELECT station, count(DISTINCT year) AS ny FROM sd WHERE year BETWEEN {FIRST} AND {LAST} GROUP BY 1 HAVING count(DISTINCT year) >= 3),
rob AS (SELECT rm.station, CAST(rm.slot AS INTEGER) AS slot, any_value(n) AS n, any_value(med) AS med, median(abs(x - med)) AS mad, any_value(p01) AS p01, any_value(p99) AS p99 FROM rm JOIN rs ON rs.station = rm.station AND rs.slot = rm.slot JOIN ry ON ry.station = rm.station GROUP BY 1, 2)"""


def robust(spark, sf):
    return k.robust_calendar(series(spark, sf).filter(BASE), ["station"], "tmin", "slot", 15, 3, 10, 1.0)


@query("robust_calendar", "Q09", f"""WITH {ROB_SQL} SELECT r.station, slot, CAST(n AS INTEGER) AS clim_n, CAST(ny AS INTEGER) AS clim_years, {R('med')} AS clim_median, {R('mad')} AS clim_mad, {R('greatest(1.4826 * mad, 1.0)')} AS clim_scale, {R('p01')} AS clim_p01, {R('p99')} AS clim_p99
FROM rob r JOIN ry ON ry.station = r.station""")
def _(spark, sf):
    r = robust(spark, sf)
    return r.select("station", "slot", "clim_n", "clim_years", *[r6(c).alias(c) for c in ("clim_median", "clim_mad", "clim_scale", "clim_p01", "clim_p99")])


OUT_SQL = f"""{ROB_SQL}, outl AS (SELECT sd.station, sd.date, sd.tmin - med AS anomaly, (sd.tmin - med) / greatest(1.4826 * mad, 1.0) AS robust_z, med IS NULL AS climatology_unavailable,
  coalesce(round(abs(sd.tmin - med), 9) >= 18 AND round(abs((sd.tmin - med) / greatest(1.4826 * mad, 1.0)), 9) >= 1.2, false) AS climatological_outlier FROM sd LEFT JOIN rob ON rob.station = sd.station AND rob.slot = sd.slot)"""


def outliers(spark, sf):
    return qc.climatological_outliers(series(spark, sf), robust(spark, sf), ["station", "slot"], "tmin", 18.0, 1.2)


@query("climatological_outliers", "Q10 Q19", f"WITH {OUT_SQL} SELECT station, date, {R('anomaly')} AS anomaly, {R('robust_z')} AS robust_z, climatology_unavailable, climatological_outlier FROM outl")
def _(spark, sf):
    return outliers(spark, sf).select("station", "date", r6("anomaly").alias("anomaly"), r6("robust_z").alias("robust_z"), "climatology_unavailable", "climatological_outlier")


TEMP_SQL = f"""{SD_SQL}, tmp AS (SELECT s.station, s.date, s.tmin, p.tmin AS pv, n.tmin AS nv FROM sd s LEFT JOIN sd p ON p.station = s.station AND p.date = s.date - 1 LEFT JOIN sd n ON n.station = s.station AND n.date = s.date + 1)"""


@query("temporal_checks", "Q11 Q12", f"""WITH {TEMP_SQL} SELECT station, date, {R('pv')} AS previous_value, {R('nv')} AS next_value, {R('tmin - pv')} AS daily_change, coalesce(abs(tmin - pv) >= 25, false) AS large_daily_change,
  coalesce(abs(tmin - pv) >= 12 AND abs(tmin - nv) >= 12 AND abs(pv - nv) <= 8, false) AS isolated_spike FROM tmp""")
def _(spark, sf):
    t = qc.temporal_checks(series(spark, sf), "station", "tmin", 25.0, 12.0, 8.0)
    return t.select("station", "date", *[r6(c).alias(c) for c in ("previous_value", "next_value", "daily_change")], "large_daily_change", "isolated_spike")


@query("flat_lines", "Q13", f"""WITH {SD_SQL}, a AS (SELECT station, date, round(tmin / 10) AS v FROM sd), b AS (SELECT *, CASE WHEN v = lag(v) OVER w AND date - lag(date) OVER w = 1 THEN 0 ELSE 1 END AS nw FROM a WINDOW w AS (PARTITION BY station ORDER BY date)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY station ORDER BY date) AS run FROM b)
SELECT station, date, count(*) OVER (PARTITION BY station, run) AS identical_run_length, count(*) OVER (PARTITION BY station, run) >= 3 AS flat_line FROM c""")
def _(spark, sf):
    s = series(spark, sf).select("station", "date", (F.col("tmin") / 10).alias("v"))
    return qc.flat_lines(s, "station", "v", 3, 0).select("station", "date", "identical_run_length", "flat_line")


# ---------------------------------------------------------------- spatial
KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
NET_SQL = f"""{STATION_XY_SQL}, pairs AS (SELECT a.station AS id, b.station AS neighbour, {KM} AS km FROM station_xy a JOIN station_xy b ON a.station <> b.station),
net AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, neighbour) AS rk FROM pairs WHERE km <= 250) WHERE rk <= 5)"""


def network(spark, sf):
    xy = station_xy(spark, sf).select(F.col("station").alias("id"), "lat", "lon")
    return nearest_k(xy, xy, 5, 250.0, exclude_self=True)


@query("neighbour_network", "Q14", f"WITH {NET_SQL} SELECT id, neighbour, {R('km', 4)} AS distance_km, CAST(rk AS INTEGER) AS neighbour_rank FROM net")
def _(spark, sf):
    return network(spark, sf).withColumn("distance_km", r6("distance_km", 4))


SPAT_SQL = f"""{OUT_SQL}, {NET_SQL}, cand AS (SELECT station, date, anomaly FROM outl WHERE climatological_outlier OR anomaly IS NULL),
met AS (SELECT c.station, c.date, c.anomaly, o.anomaly AS na FROM cand c JOIN net ON net.id = c.station JOIN outl o ON o.station = net.neighbour AND o.date = c.date WHERE o.anomaly IS NOT NULL),
m1 AS (SELECT station, date, count(*) AS n, median(na) AS med, min(na) AS mn, max(na) AS mx, avg(CASE WHEN sign(na) = sign(anomaly) AND sign(anomaly) <> 0 THEN 1.0 ELSE 0.0 END) AS ss FROM met GROUP BY 1, 2),
m2 AS (SELECT met.station, met.date, median(abs(na - med)) AS mad FROM met JOIN m1 ON m1.station = met.station AND m1.date = met.date GROUP BY 1, 2),
sp0 AS (SELECT c.station, c.date, c.anomaly AS a, CAST(coalesce(n, 0) AS INTEGER) AS n, med, mn, mx, ss, mad, greatest(1.4826 * mad, 1.0) AS sc, c.anomaly - med AS res FROM cand c LEFT JOIN m1 ON m1.station = c.station AND m1.date = c.date LEFT JOIN m2 ON m2.station = c.station AND m2.date = c.date),
sp AS (SELECT *, a IS NOT NULL AND n >= 2 AND coalesce(abs(res) >= 20 AND abs(res / sc) >= 2, false) AS spatial_outlier,
  a IS NOT NULL AND n >= 2 AND coalesce(sign(a) = sign(med) AND a <> 0 AND abs(med) >= 1 AND abs(res) <= 22 AND ss >= 0.5, false) AS regional_support FROM sp0)"""


def spatial(spark, sf):
    # candidates and neighbours both read the outliers: the calendar behind them is made once
    o = stage_table(outliers(spark, sf).select("station", "date", "tmin", "anomaly", "climatological_outlier"))
    cand = o.filter("climatological_outlier OR anomaly IS NULL").select("station", "date", "anomaly", F.col("tmin").alias("value"), F.lit("raw").alias("source"))
    return qc.spatial_metrics(cand, network(spark, sf), o.select("station", "date", "anomaly"), min_neighbours=2, min_scale=1.0, residual_limit=20.0, z_limit=2.0,
                              support_median=1.0, support_residual=22.0, support_share=0.5, cold_target=-1.0, cold_neighbour=-0.5)


@query("spatial_consistency", "Q15", f"""WITH {SPAT_SQL} SELECT station, date, n AS neighbour_count, {R('med')} AS neighbour_median, {R('mad')} AS neighbour_mad, {R('mn')} AS neighbour_min, {R('mx')} AS neighbour_max, {R('ss')} AS same_sign_fraction, {R('res')} AS spatial_residual, {R('res / sc')} AS spatial_z,
  spatial_outlier, regional_support, regional_support AND coalesce(a <= -1 AND med <= -0.5, false) AS cold_support, a IS NOT NULL AND n < 2 AS insufficient_neighbours FROM sp""")
def _(spark, sf):
    s = spatial(spark, sf)
    return s.select("station", "date", "neighbour_count", *[r6(c).alias(c) for c in ("neighbour_median", "neighbour_mad", "neighbour_min", "neighbour_max", "same_sign_fraction", "spatial_residual", "spatial_z")],
                    "spatial_outlier", "regional_support", "cold_support", "insufficient_neighbours")


@query("spatial_decisions", "Q16 Q19", f"""WITH {SPAT_SQL}, d AS (SELECT sp.*, CASE WHEN spatial_outlier THEN 'set_missing_spatial_outlier' WHEN regional_support AND coalesce(a <= -1 AND med <= -0.5, false) THEN 'keep_regional_cold_signal' WHEN regional_support THEN 'keep_regional_signal'
  WHEN a IS NOT NULL AND n < 2 THEN 'keep_insufficient_neighbours' WHEN a IS NULL THEN 'keep_spatial_evidence_unavailable' ELSE 'keep_spatially_inconclusive' END AS spatial_decision FROM sp)
SELECT d.station, d.date, spatial_decision, {R("CASE WHEN spatial_decision <> 'set_missing_spatial_outlier' THEN sd.tmin END")} AS value_clean, CASE WHEN spatial_decision = 'set_missing_spatial_outlier' THEN 'qc_set_missing_spatial_outlier' ELSE 'raw' END AS source_clean,
  spatial_decision = 'set_missing_spatial_outlier' AS value_changed FROM d JOIN sd ON sd.station = d.station AND sd.date = d.date""")
def _(spark, sf):
    return qc.spatial_decision(spatial(spark, sf)).select("station", "date", "spatial_decision", r6("value_clean").alias("value_clean"), "source_clean", "value_changed")


@query("tmax_screen", "Q17", f"""WITH {SD_SQL}, a AS (SELECT *, CASE WHEN tmax NOT BETWEEN 0 AND 95 THEN 'physical_range' WHEN tmax < tmin THEN 'tmax_below_cleaned_tmin' END AS r, CASE WHEN tmax BETWEEN 0 AND 95 AND tmax >= tmin THEN tmax END AS x FROM sd),
b AS (SELECT a.*, x - c.m AS dep, coalesce(abs((x - c.m) / nullif(c.s, 0)) > 2.2, false) AS o FROM a LEFT JOIN {moments_sql('x', 7, 'a')} c ON c.station = a.station AND c.slot365 = a.slot365),
d AS (SELECT date, median(dep) AS md, count(dep) AS nd FROM b WHERE NOT o GROUP BY 1),
e AS (SELECT b.*, md, nd, coalesce(r, CASE WHEN o THEN 'climatological_outlier' WHEN nd >= 10 AND round(abs(dep - md), 9) > 40 THEN 'spatial_departure' END) AS reason FROM b LEFT JOIN d ON d.date = b.date)
SELECT station, date, {R('CASE WHEN NOT o THEN x END')} AS tmax_screened, reason, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason = 'spatial_departure' THEN 'flagged_retained' ELSE 'rejected' END AS decision FROM e""")
def _(spark, sf):
    s = qc.screen_maximum(series(spark, sf), "slot365", BASE, (0.0, 95.0), 7, 2.2, 10, 40.0)
    return s.select("station", "date", r6("tmax_screened").alias("tmax_screened"), "reason", "decision")


@query("quality_summary", "Q18", f"""WITH {PASS_SQL} SELECT station, CAST(year(date) AS INTEGER) AS year, status, count(*) AS row_count, count(*) FILTER (WHERE tmin_zero) AS tmin_zero_count, count(*) FILTER (WHERE dtr_high) AS dtr_high_count, count(*) FILTER (WHERE duplicate_conflict) AS duplicate_conflict_count FROM fp GROUP BY 1, 2, 3""")
def _(spark, sf):
    return qc.status_summary(passed(spark, sf).withColumn("year", F.year("date")), ["station", "year"], ["tmin_zero", "dtr_high", "duplicate_conflict"], "status")
