"""Gridded fields."""
from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import climatology as k, grid as g, grid_kernels as gk
from .q_events import CAT_SQL, primary
from .registry import GRID_DAILY_SQL, GRID_MONTHLY_SQL, R, grid_daily, grid_monthly, query, r6, table

COS = "cos(radians(lat))"


def wm(x, cond="true"):
    return f"sum({x} * {COS}) FILTER (WHERE {x} IS NOT NULL AND {cond}) / nullif(sum({COS}) FILTER (WHERE {x} IS NOT NULL AND {cond}), 0)"


def rounded(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, r6(c, digits))
    return df


@query("standardised_coordinates", "G01", """WITH a AS (SELECT CAST(l_shipdate AS DATE) AS time, 20.0::DOUBLE + l_suppkey % 6 AS lat, -180.0::DOUBLE + 45 * (l_partkey % 13) AS rl, l_quantity AS t, l_orderkey * 10 + l_linenumber AS r FROM lineitem),
b AS (SELECT *, ((rl % 360) + 360) % 360 AS lon FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY time, lat, lon ORDER BY rl, t, r) AS k FROM b) SELECT time, lat, lon, t, r FROM c WHERE k = 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("valid_time"), (F.lit(20.0) + F.col("l_suppkey") % 6).alias("latitude"),
                                             (F.lit(-180.0) + 45 * (F.col("l_partkey") % 13)).alias("lon"), F.col("l_quantity").alias("t"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("r"))
    return g.standardise(li.withColumnRenamed("latitude", "lat"))


@query("collapsed_versions", "G02", f"""WITH a AS (SELECT CAST(l_shipdate AS DATE) AS time, l_suppkey % 6 AS lat, l_linenumber AS ver, avg(CASE WHEN l_quantity > 25 THEN l_quantity END) AS t FROM lineitem GROUP BY 1, 2, 3)
SELECT time, lat, {R('arg_min(t, ver) FILTER (WHERE t IS NOT NULL)')} AS t FROM a GROUP BY 1, 2""")
def _(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("time"), (F.col("l_suppkey") % 6).alias("lat"), F.col("l_linenumber").alias("ver")).agg(
        F.avg(F.when(F.col("l_quantity") > 25, F.col("l_quantity"))).alias("t"))
    return rounded(g.collapse_versions(a, ["time", "lat"], "ver", ["t"]), "t")


@query("nearest_level_box", "G03", f"""WITH {GRID_MONTHLY_SQL}, b AS (SELECT time, min(abs(level - 700) * 10000 + level) % 10000 AS lv FROM gridm GROUP BY 1)
SELECT gridm.time, level, lat, lon, {R('t')} AS t FROM gridm JOIN b ON b.time = gridm.time AND b.lv = level WHERE lat BETWEEN 30 AND 45 AND lon BETWEEN 60 AND 210""")
def _(spark, sf):
    return g.nearest_level(grid_monthly(spark, sf), 700).filter(g.box(30, 45, 60, 210)).select("time", "level", "lat", "lon", r6("t").alias("t"))


BOXES = {"west": (25.0, 40.0, 0.0, 120.0), "east": (30.0, 50.0, 150.0, 330.0)}


@query("box_means_masked", "G04 G12 G24", f"""WITH {GRID_DAILY_SQL}, b(box, a, b, c, d) AS (VALUES ('west', 25, 40, 0, 120), ('east', 30, 50, 150, 330))
SELECT time, box, {R(wm('t'))} AS box_mean, {R(wm('t', 'NOT z > 60000'))} AS masked_mean, {R(f'sum(CASE WHEN z > 60000 THEN {COS} ELSE 0 END) / sum({COS})')} AS masked_fraction FROM grid JOIN b ON lat BETWEEN a AND b AND lon BETWEEN c AND d GROUP BY 1, 2""")
def _(spark, sf):
    m = g.box_means(grid_daily(spark, sf), ["time"], "t", BOXES, F.col("z") > 60000)
    return rounded(m, "box_mean", "masked_mean", "masked_fraction")


@query("cap_mean", "G05", f"""WITH {GRID_MONTHLY_SQL}, z AS (SELECT time, level, lat, avg(z) AS z FROM gridm WHERE lat >= 35 GROUP BY 1, 2, 3) SELECT time, level, {R('sum(z * ' + COS + ') / sum(' + COS + ')', 4)} AS z FROM z GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(g.cap_mean(grid_monthly(spark, sf).filter("lat >= 35"), ["time", "level"], "z"), "z", digits=4)


@query("daily_means_complete", "G06", f"""SELECT user_id AS station, CAST(ts AS DATE) AS date, count(*) AS sample_count, {R('avg(value)')} AS value FROM events GROUP BY 1, 2 HAVING count(*) = 2""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("station"), "ts", "value")
    return rounded(g.daily_means(e, ["station"], "ts", ["value"], 2), "value")


@query("day_night_windows", "G07", f"""SELECT event_type, CAST(ts AS DATE) AS date, {R('avg(value) FILTER (WHERE hour(ts) < 12)')} AS value_day, {R('sum(value) FILTER (WHERE hour(ts) < 12)')} AS value_day_sum, count(value) FILTER (WHERE hour(ts) < 12) AS hours_day,
 {R('avg(value) FILTER (WHERE hour(ts) >= 12)')} AS value_night, {R('sum(value) FILTER (WHERE hour(ts) >= 12)')} AS value_night_sum, count(value) FILTER (WHERE hour(ts) >= 12) AS hours_night, {R('sum(value)')} AS value_utcday_sum, {R('avg(value) FILTER (WHERE hour(ts) = 6)')} AS value_at_06 FROM events GROUP BY 1, 2""")
def _(spark, sf):
    w = g.day_night_windows(table(spark, sf, "events"), ["event_type"], "ts", ["value"], ["value"], at={"value": 6})
    return rounded(w, "value_day", "value_day_sum", "value_night", "value_night_sum", "value_utcday_sum", "value_at_06")


@query("coarsened_blocks", "G08", f"""WITH {GRID_MONTHLY_SQL}, b AS (SELECT time, level, CAST(floor(round((lat - 25) / 5) / 2) AS BIGINT) AS block_i, CAST(floor(round(lon / 30) / 2) AS BIGINT) AS block_j, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, avg(t) AS t FROM gridm GROUP BY 1, 2, 3, 4)
SELECT time, level, block_i, block_j, {R('lat')} AS lat, {R('lon')} AS lon, {R('t')} AS t FROM b WHERE n = 4""")
def _(spark, sf):
    return rounded(g.coarsen(grid_monthly(spark, sf), ["time", "level"], "t", 2, 25.0, 5.0, 0.0, 30.0), "lat", "lon", "t")


TER_SQL = """ter AS (SELECT 24.0::DOUBLE + CAST(p_partkey % 541 AS DOUBLE) / 20 AS lat, CAST(p_partkey % 739 AS DOUBLE) / 2 AS lon, p_size * 60.0::DOUBLE AS elevation FROM part),
cel AS (SELECT DISTINCT lat, lon FROM grid), el AS (SELECT c.lat, c.lon, avg(elevation) AS elevation FROM cel c LEFT JOIN ter t ON abs(c.lat - t.lat) <= 2.5 AND abs(c.lon - t.lon) <= 2.5 GROUP BY 1, 2)"""


def elevations(spark, sf):
    p = F.col("p_partkey")
    ter = table(spark, sf, "part").select((F.lit(24.0) + (p % 541).cast("double") / 20).alias("lat"), ((p % 739).cast("double") / 2).alias("lon"), (F.col("p_size") * F.lit(60.0)).alias("elevation"))
    return g.cell_elevation(grid_daily(spark, sf).select("lat", "lon").distinct(), ter, 2.5)


@query("terrain_masks", "G09 G10 G11", f"""WITH {GRID_DAILY_SQL}, {TER_SQL}, m AS (SELECT *, coalesce(elevation, -1e9) > 1500 AS mask850, coalesce(elevation, -1e9) > 2000 AS mask700 FROM el)
SELECT lat, lon, {R('elevation')} AS elevation, mask850, mask700, mask850 OR coalesce(lag(mask850) OVER r, false) OR coalesce(lead(mask850) OVER r, false) OR coalesce(lag(mask850) OVER c, false) OR coalesce(lead(mask850) OVER c, false) AS dilated FROM m WINDOW r AS (PARTITION BY lat ORDER BY lon), c AS (PARTITION BY lon ORDER BY lat)""")
def _(spark, sf):
    e = elevations(spark, sf)
    e = e.withColumn("mask850", g.below_ground(F.lit(850), F.col("elevation"), 1500.0, 2000.0)).withColumn("mask700", g.below_ground(F.lit(700), F.col("elevation"), 1500.0, 2000.0))
    return rounded(g.dilate(e, "mask850"), "elevation")


@query("level_difference", "G13", f"""WITH {GRID_MONTHLY_SQL} SELECT time, lat, lon, {R('max(z) FILTER (WHERE level = 500) - max(z) FILTER (WHERE level = 850)')} AS thickness FROM gridm WHERE level IN (500, 850) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(g.level_difference(grid_monthly(spark, sf), "z", 500, 850, "thickness"), "thickness")


@query("box_series", "G14", f"""WITH {GRID_MONTHLY_SQL} SELECT time, """ + ", ".join(
    R(wm(v, f"lat BETWEEN {b[0]} AND {b[1]} AND lon BETWEEN {b[2]} AND {b[3]} AND level = {lv}"), 5) + f" AS {n}_{v}_{lv}" for n, b in BOXES.items() for v in ("t", "u") for lv in (850, 250)) + " FROM gridm GROUP BY 1")
def _(spark, sf):
    s = g.box_series(grid_monthly(spark, sf), BOXES, ["t", "u"], [850, 250])
    return rounded(s, *[c for c in s.columns if c != "time"], digits=5)


def _deriv(f, x, w):
    xl, xr, fl, fr = f"lag({x}) OVER {w}", f"lead({x}) OVER {w}", f"lag({f}) OVER {w}", f"lead({f}) OVER {w}"
    return f"""CASE WHEN {xl} IS NULL THEN ({fr} - {f}) / ({xr} - {x}) WHEN {xr} IS NULL THEN ({f} - {fl}) / ({x} - {xl}) ELSE
 (pow({x} - {xl}, 2) * {fr} + (pow({xr} - {x}, 2) - pow({x} - {xl}, 2)) * {f} - pow({xr} - {x}, 2) * {fl}) / (({x} - {xl}) * ({xr} - {x}) * ({xr} - {xl})) END"""


@query("advection", "G15", f"""WITH {GRID_MONTHLY_SQL}, d AS (SELECT *, {_deriv('t', 'lon', 'a')} AS gx, {_deriv('t', 'lat', 'b')} AS gy FROM gridm WINDOW a AS (PARTITION BY time, level, lat ORDER BY lon), b AS (PARTITION BY time, level, lon ORDER BY lat))
SELECT time, level, lat, lon, {R('-(u * gx * 180.0::DOUBLE / pi() / 6.371e6 / cos(radians(lat)) + v * gy * 180.0::DOUBLE / pi() / 6.371e6) * 86400')} AS advection FROM d""")
def _(spark, sf):
    a = g.advection(grid_monthly(spark, sf), ["time", "level"])
    return a.select("time", "level", "lat", "lon", r6("advection").alias("advection"))


@query("jet_core", "G16 G18", f"""WITH {GRID_MONTHLY_SQL}, z AS (SELECT time, level, lat, avg(u) AS u FROM gridm GROUP BY 1, 2, 3), a AS (SELECT *, row_number() OVER (PARTITION BY time, level ORDER BY round(u, 9) DESC, lat) AS k, row_number() OVER (PARTITION BY time, level ORDER BY abs(lat - 41), lat) AS n FROM z)
SELECT time, level, max(CASE WHEN k = 1 THEN lat END) AS jet_lat, {R('max(u)')} AS jet_speed, {R('max(CASE WHEN n = 1 THEN u END)')} AS u_near_41 FROM a GROUP BY 1, 2""")
def _(spark, sf):
    m = grid_monthly(spark, sf)
    near = g.at_nearest_latitude(m, ["time", "level"], 41.0, "u").select("time", "level", F.col("u").alias("u_near_41"))
    return rounded(g.jet_core(m, ["time", "level"], "u").join(near, ["time", "level"]), "jet_speed", "u_near_41")


@query("field_minimum", "G17", f"""WITH {GRID_DAILY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY round(z, 9), lat, lon) AS k FROM grid WHERE lon BETWEEN 0 AND 180) SELECT time, {R('z')} AS minimum, lat AS min_lat, lon AS min_lon, 90 - lat AS displacement FROM r WHERE k = 1""")
def _(spark, sf):
    return rounded(g.minimum_location(grid_daily(spark, sf).filter("lon BETWEEN 0 AND 180"), ["time"], "z"), "minimum")


@query("polar_cap_index", "G19", f"""WITH {GRID_MONTHLY_SQL}, h AS (SELECT time, level, strftime(time, '%m-%d') AS md, sum(z * {COS}) / sum({COS}) AS z FROM (SELECT time, level, lat, avg(z) AS z FROM gridm GROUP BY 1, 2, 3) GROUP BY 1, 2), c AS (SELECT md, level, avg(z) AS m, stddev_samp(z) AS s FROM h GROUP BY 1, 2), x AS (SELECT h.time, h.level, -(z - m) / nullif(s, 0) AS i FROM h JOIN c ON c.md = h.md AND c.level = h.level)
SELECT time, level, {R('i', 5)} AS cap_index, coalesce(round(i, 9) <= -1, false) AS weak, coalesce(round(i, 9) <= -2, false) AS very_weak, coalesce(i < 0, false) AS negative, {R('avg(i) OVER (PARTITION BY time)', 5)} AS level_mean FROM x""")
def _(spark, sf):
    h = g.cap_mean(grid_monthly(spark, sf), ["time", "level"], "z").withColumn("month_day", F.date_format("time", "MM-dd"))
    p = g.polar_cap_index(h, k.month_day_climatology(h, ["level"], "z", "month_day"), "z")
    return p.select("time", "level", r6("cap_index", 5).alias("cap_index"), "weak", "very_weak", "negative", r6("level_mean", 5).alias("level_mean"))


INTERP_SQL = f"""{GRID_MONTHLY_SQL}, tg AS (SELECT unnest([28.0, 30.0, 37.5, 39.5, 46.0, 48.0]::DOUBLE[]) AS target_lat), ip AS (SELECT time, lon, target_lat, arg_max(z, lat) FILTER (WHERE lat <= target_lat) AS zl, max(lat) FILTER (WHERE lat <= target_lat) AS la, arg_min(z, lat) FILTER (WHERE lat >= target_lat) AS zu, min(lat) FILTER (WHERE lat >= target_lat) AS lb FROM (SELECT * FROM gridm WHERE level = 500), tg GROUP BY 1, 2, 3),
iz AS (SELECT time, lon, target_lat, CASE WHEN lb - la = 0 THEN zl ELSE zl + (target_lat - la) / nullif(lb - la, 0) * (zu - zl) END AS z FROM ip)"""


@query("interpolated_latitudes", "G20", f"WITH {INTERP_SQL} SELECT time, lon, target_lat, {R('z')} AS z FROM iz")
def _(spark, sf):
    m = grid_monthly(spark, sf).filter("level = 500")
    return rounded(g.interpolate_latitude(m, ["time", "lon"], [28.0, 30.0, 37.5, 39.5, 46.0, 48.0], "z"), "z")


@query("blocking_index", "G21 G22", f"""WITH {INTERP_SQL}, w AS (SELECT time, lon, {', '.join(f"max(z) FILTER (WHERE target_lat = {x}) AS z{str(x).replace('.', '_')}" for x in (28.0, 30.0, 37.5, 39.5, 46.0, 48.0))} FROM iz GROUP BY 1, 2),
l AS (SELECT time, lon, coalesce((z37_5 - z28_0) / 9.5 > 0 AND (z46_0 - z37_5) / 8.5 < -10, false) OR coalesce((z39_5 - z30_0) / 9.5 > 0 AND (z48_0 - z39_5) / 8.5 < -10, false) AS b FROM w WHERE lon BETWEEN 30 AND 300),
r AS (SELECT time, CAST(round(lon / 30) AS INTEGER) - row_number() OVER (PARTITION BY time ORDER BY lon) AS gp FROM l WHERE b), s AS (SELECT time, max(n) * 30.0::DOUBLE AS wd FROM (SELECT time, gp, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT l.time, {R('avg(CASE WHEN b THEN 1.0 ELSE 0.0 END)')} AS blocking_fraction, coalesce(any_value(wd), 0) AS widest_span, coalesce(any_value(wd), 0) >= 60 AS sector_block_day FROM l LEFT JOIN s ON s.time = l.time GROUP BY 1""")
def _(spark, sf):
    b = g.blocking(grid_monthly(spark, sf).filter("level = 500"), "z", 37.5, 28.0, 46.0, [0.0, 2.0], (30.0, 300.0), -10.0, 60.0, 30.0)
    return rounded(b, "blocking_fraction")


@query("high_pressure_index", "G23", f"""WITH {GRID_DAILY_SQL}, i AS (SELECT time, strftime(time, '%m-%d') AS md, {wm('z')} AS bm, max(z) AS bx FROM grid WHERE lat BETWEEN 35 AND 50 AND lon BETWEEN 60 AND 180 GROUP BY 1), c AS (SELECT md, avg(bm) AS m, stddev_samp(bm) AS s FROM i GROUP BY 1)
SELECT time, {R('bm', 4)} AS box_mean, {R('bx', 4)} AS box_max, {R('(bm - m) / nullif(s, 0)', 5)} AS zscore FROM i JOIN c USING (md)""")
def _(spark, sf):
    i = g.high_pressure_index(grid_daily(spark, sf), "z", (35.0, 50.0, 60.0, 180.0)).withColumn("month_day", F.date_format("time", "MM-dd"))
    z = k.standardise(i, k.month_day_climatology(i, [], "box_mean", "month_day"), ["month_day"], "box_mean")
    return z.select("time", r6("box_mean", 4).alias("box_mean"), r6("box_max", 4).alias("box_max"), r6("zscore", 5).alias("zscore"))


@query("smoothed_field", "G25", f"""WITH {GRID_MONTHLY_SQL}, ws AS (SELECT k, exp(-k * k / 2.0) / sum(exp(-k * k / 2.0)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS k)),
la AS (SELECT time, level, lat, row_number() OVER (PARTITION BY time, level ORDER BY lat) - 1 AS i, count(*) OVER (PARTITION BY time, level) AS n FROM (SELECT DISTINCT time, level, lat FROM gridm)),
lo AS (SELECT time, level, lon, row_number() OVER (PARTITION BY time, level ORDER BY lon) - 1 AS i, count(*) OVER (PARTITION BY time, level) AS n FROM (SELECT DISTINCT time, level, lon FROM gridm)),
py AS (SELECT time, level, lat, least(greatest(i + k, 0), n - 1) AS i, sum(w) AS w FROM la, ws GROUP BY 1, 2, 3, 4), px AS (SELECT time, level, lon, least(greatest(i + k, 0), n - 1) AS i, sum(w) AS w FROM lo, ws GROUP BY 1, 2, 3, 4),
cell AS (SELECT time, level, la.i AS iy, lo.i AS ix, t FROM gridm JOIN la USING (time, level, lat) JOIN lo USING (time, level, lon) WHERE t IS NOT NULL)
SELECT time, level, py.lat, px.lon, {R('CASE WHEN sum(CASE WHEN t IS NOT NULL THEN py.w * px.w ELSE 0 END) > 0.25 THEN sum(py.w * px.w * t) / sum(CASE WHEN t IS NOT NULL THEN py.w * px.w ELSE 0 END) END')} AS smoothed
FROM py JOIN px USING (time, level) LEFT JOIN cell ON cell.time = py.time AND cell.level = py.level AND cell.iy = py.i AND cell.ix = px.i GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return rounded(gk.smooth(grid_monthly(spark, sf), ["time", "level"], "t", 1.0), "smoothed")


def flux(spark, sf):
    return gk.wave_flux(grid_monthly(spark, sf), ["time", "level"], "z", "u", "v", min_speed=0.1, lat_range=(25.0, 50.0))


@query("wave_activity_flux", "G26")
def _(spark, sf):
    return flux(spark, sf)


REGIONS = {"upstream": (25.0, 50.0, 0.0, 150.0), "downstream": (25.0, 50.0, 150.0, 330.0)}


@query("region_flux_metrics", "G27")
def _(spark, sf):
    return g.region_flux_metrics(flux(spark, sf), ["time", "level"], REGIONS)


RF_SQL = f"""{GRID_MONTHLY_SQL}, b(region, a, b, c, d) AS (VALUES ('upstream', 25, 50, 0, 150), ('downstream', 25, 50, 150, 330)), m AS (SELECT time, level, region, {wm('u')} AS mean_fx, {wm('v')} AS mean_fy, {wm('sqrt(u * u + v * v)')} AS mean_magnitude, {wm('t')} AS mean_divergence, avg(CASE WHEN u > 0 THEN 1.0 ELSE 0.0 END) AS ef, avg(CASE WHEN (u - v) / sqrt(2) > 0 THEN 1.0 ELSE 0.0 END) AS sf, avg(CASE WHEN t < 0 THEN 1.0 ELSE 0.0 END) AS cf
 FROM gridm JOIN b ON lat BETWEEN a AND b AND lon BETWEEN c AND d GROUP BY 1, 2, 3)"""


def _wind_metrics(spark, sf):
    m = grid_monthly(spark, sf).withColumnsRenamed({"u": "fx", "v": "fy", "t": "divergence"})
    return g.region_flux_metrics(m, ["time", "level"], REGIONS)


@query("region_vector_metrics", "G27", f"WITH {RF_SQL} SELECT time, level, region, {R('mean_fx', 5)} AS mean_fx, {R('mean_fy', 5)} AS mean_fy, {R('mean_magnitude', 5)} AS mean_magnitude, {R('mean_divergence', 5)} AS mean_divergence, {R('ef', 5)} AS eastward_fraction, {R('sf', 5)} AS southeastward_fraction, {R('cf', 5)} AS convergence_fraction, {R('sqrt(mean_fx * mean_fx + mean_fy * mean_fy) / mean_magnitude', 5)} AS coherence FROM m")
def _(spark, sf):
    m = _wind_metrics(spark, sf)
    return rounded(m, *[c for c in m.columns if c not in ("time", "level", "region")], digits=5)


@query("region_metrics_wide", "G38", f"WITH {RF_SQL} SELECT time, " + ", ".join(R(f"max(mean_fx) FILTER (WHERE level = {lv} AND region = '{r}')", 5) + f" AS {r}_{lv}" for r in REGIONS for lv in (850, 250)) + " FROM m GROUP BY 1")
def _(spark, sf):
    names = [f"{r}_{lv}" for r in REGIONS for lv in (850, 250)]
    w = g.metrics_wide(_wind_metrics(spark, sf), ["time"], F.concat_ws("_", "region", F.col("level").cast("string")), names, "mean_fx")
    return rounded(w, *names, digits=5)


# ---------------------------------------------------------------- waves
BAND_SQL = f"""{GRID_DAILY_SQL}, bd AS (SELECT time, lon, {wm('v')} AS v FROM grid WHERE lat BETWEEN 30 AND 45 GROUP BY 1, 2)"""


def band(spark, sf):
    return g.latitude_band_mean(grid_daily(spark, sf), "v", 30.0, 45.0)


@query("latitude_band_mean", "G28", f"WITH {BAND_SQL} SELECT time, lon, {R('v')} AS v FROM bd")
def _(spark, sf):
    return rounded(band(spark, sf), "v")


@query("wave_envelope", "G28", f"""WITH {BAND_SQL}, ix AS (SELECT time, lon, v, row_number() OVER (PARTITION BY time ORDER BY lon) - 1 AS j, count(*) OVER (PARTITION BY time) AS n FROM bd),
tr AS (SELECT time, lon, v, k, n, 2 * pi() * k * j / n AS th FROM ix, (SELECT unnest(range(2, 5)) AS k)), co AS (SELECT time, k, sum(v * cos(th)) AS a, sum(v * sin(th)) AS b, count(v) AS m FROM tr GROUP BY 1, 2),
wv AS (SELECT time, lon, sum(2.0 / n * (a * cos(th) + b * sin(th))) AS re, sum(2.0 / n * (a * sin(th) - b * cos(th))) AS im, bool_and(m = n) AS whole FROM tr JOIN co USING (time, k) GROUP BY 1, 2)
SELECT time, lon, {R('CASE WHEN whole THEN sqrt(re * re + im * im) END')} AS envelope, {R('CASE WHEN whole THEN re END')} AS wave, CASE WHEN whole AND sqrt(re * re + im * im) > 1e-6 THEN abs({R('atan2(im, re)', 4)}) * CASE WHEN {R('atan2(im, re)', 4)} < 0 AND {R('atan2(im, re)', 4)} > -3.1416 THEN -1 ELSE 1 END END AS phase FROM wv""")
def _(spark, sf):
    w = gk.band_wave(band(spark, sf), ["time"], "v", 2, 4)
    # no phase where there is no wave; half a turn is written as pi
    phase = F.when(F.col("phase") <= -3.1416, -F.col("phase")).otherwise(F.col("phase"))
    w = rounded(w.withColumn("phase", F.when(F.col("envelope") > 1e-6, F.col("phase"))), "phase", digits=4).withColumn("phase", phase)
    return rounded(w, "envelope", "wave")


@query("recurrent_wave_metric", "G29")
def _(spark, sf):
    b = k.centred_mean(band(spark, sf), ["lon"], "time", "v", 2, "v_filtered")
    return gk.band_wave(b.filter("v_filtered IS NOT NULL"), ["time"], "v_filtered", 2, 4)


SECTORS = {"west": (0.0, 150.0), "east": (180.0, 330.0)}
SEC_SQL = f"""{BAND_SQL}, bv AS (SELECT time, lon, abs(v) AS v, strftime(time, '%m-%d') AS md FROM bd), cl AS (SELECT md, lon, quantile_cont(v, 0.9) AS p90 FROM bv GROUP BY 1, 2), se(sector, a, b) AS (VALUES ('west', 0, 150), ('east', 180, 330)),
sm AS (SELECT sector, time, bv.md, avg(v) AS sector_mean, max(v) AS sector_max, avg(CASE WHEN v > p90 THEN 1.0 ELSE 0.0 END) AS hf FROM bv JOIN cl ON cl.md = bv.md AND cl.lon = bv.lon JOIN se ON bv.lon BETWEEN a AND b GROUP BY 1, 2, 3), sc AS (SELECT sector, md, avg(round(sector_mean, 9)) AS m, stddev_samp(round(sector_mean, 9)) AS s, quantile_cont(round(sector_mean, 9), 0.9) AS p90 FROM sm GROUP BY 1, 2),
sec AS (SELECT sm.sector, time, sm.md AS month_day, round(sector_mean, 9) AS sector_mean, sector_max, hf, p90, (round(sector_mean, 9) - m) / nullif(s, 0) AS st, round(sector_mean, 9) > p90 AS high_day FROM sm JOIN sc ON sc.sector = sm.sector AND sc.md = sm.md)"""


def sectors(spark, sf):
    w = band(spark, sf).withColumn("v", F.abs("v")).withColumn("month_day", F.date_format("time", "MM-dd"))
    return g.sector_metrics(w, k.month_day_climatology(w, ["lon"], "v", "month_day", quantiles=True), SECTORS, "v")


@query("sector_metrics", "G30", f"""WITH {SEC_SQL} SELECT sector, time, {R('sector_mean', 5)} AS sector_mean, {R('sector_max', 5)} AS sector_max, {R('hf', 5)} AS high_cell_fraction, {R('p90', 5)} AS sector_p90 FROM sec""")
def _(spark, sf):
    s = sectors(spark, sf)
    return rounded(s.select("sector", "time", "sector_mean", "sector_max", "high_cell_fraction", "sector_p90"), "sector_mean", "sector_max", "high_cell_fraction", "sector_p90", digits=5)


@query("sector_episode_days", "G30 E26")
def _(spark, sf):
    return g.sector_episodes(sectors(spark, sf), 2).select("sector", "time", "high_day", "episode")


@query("envelope_peaks", "G31")
def _(spark, sf):
    s = sectors(spark, sf).withColumn("year", F.year("time")).withColumn("limit", F.lit(0.5))
    return gk.peaks(s, ["sector", "year"], "time", "sector_mean", "limit", 4)


# ---------------------------------------------------------------- pressure validity, composites
@query("surface_validity", "G32", f"""WITH {GRID_DAILY_SQL}, {TER_SQL}, j AS (SELECT g.time, g.lat, g.lon, 1000 + u AS msl, t, elevation, lv.level FROM grid g JOIN el USING (lat, lon), (SELECT unnest([850, 925, 1000]) AS level) lv),
s AS (SELECT *, msl * exp(-coalesce(elevation, 0) / (287.05::DOUBLE / 9.80665::DOUBLE * (t + 273.15 + 0.0065 * coalesce(elevation, 0) / 2))) AS sp FROM j) SELECT time, level, {R(f'sum(CASE WHEN level < sp THEN {COS} ELSE 0 END) / sum({COS})')} AS valid_fraction FROM s GROUP BY 1, 2""")
def _(spark, sf):
    d = grid_daily(spark, sf).join(elevations(spark, sf), ["lat", "lon"]).withColumn("msl", F.lit(1000) + F.col("u")).withColumn("level", F.explode(F.array(*map(F.lit, (850, 925, 1000)))))
    return rounded(g.surface_validity(d, ["time"], "level", "msl", "t", "elevation"), "valid_fraction")


GA_SQL = f"""gclim AS (SELECT strftime(time, '%m-%d') AS month_day, lat, lon, avg(t) AS c FROM grid GROUP BY 1, 2, 3), ga AS (SELECT g.time, g.lat, g.lon, t - c AS a, u, v FROM grid g JOIN gclim ON month_day = strftime(time, '%m-%d') AND gclim.lat = g.lat AND gclim.lon = g.lon)"""
LAG_SQL = f"""{CAT_SQL}, {GRID_DAILY_SQL}, {GA_SQL}, lg AS (SELECT event_id, duration_group, season, CAST(start_date + CAST(o AS INTEGER) AS DATE) AS time, CAST(o AS INTEGER) AS lag FROM cat, (SELECT unnest(range(-3, 4)) AS o)), ea AS (SELECT lg.event_id, lg.duration_group, lg.season, lag, lat, lon, round(a, 9) AS a, u, v FROM lg JOIN ga USING (time))"""


def anomalies(spark, sf):
    d = grid_daily(spark, sf)
    return k.grid_anomaly(d, k.grid_climatology(d, ["lat", "lon"], ["t"]), ["lat", "lon"], ["t"]).withColumn("t_anom", F.round("t_anom", 9))


def lags(spark, sf):
    from ..operators.events import event_lags
    return event_lags(primary(spark, sf), -3, 3, ["duration_group", "season"])


@query("lag_composite", "G33", f"WITH {LAG_SQL} SELECT lag, lat, lon, {R('avg(a)')} AS composite, count(a) AS event_count FROM ea GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(g.lag_composite(anomalies(spark, sf), lags(spark, sf), ["lat", "lon"], "t_anom"), "composite")


def _event_fields(spark, sf):
    lg = lags(spark, sf).select("event_id", "duration_group", "season", "lag", F.col("date").alias("time"))
    return lg.join(anomalies(spark, sf), "time")


@query("sign_agreement", "G34", f"""WITH {LAG_SQL}, m AS (SELECT lag, lat, lon, round(avg(a), 12) AS m, count(a) AS n FROM ea GROUP BY 1, 2, 3), s AS (SELECT ea.lag, ea.lat, ea.lon, any_value(m) AS m, any_value(n) AS n, avg(CASE WHEN sign(a) = sign(m) THEN 1.0 ELSE 0.0 END) AS g FROM ea JOIN m ON m.lag = ea.lag AND m.lat = ea.lat AND m.lon = ea.lon GROUP BY 1, 2, 3)
SELECT lag, lat, lon, {R('m')} AS composite, n AS event_count, {R('g')} AS agreement, g >= 0.55 AS agree_55, g >= 0.6 AS agree_60, g >= 0.67 AS agree_67 FROM s""")
def _(spark, sf):
    return rounded(g.sign_agreement(_event_fields(spark, sf), ["lag", "lat", "lon"], "t_anom"), "composite", "agreement")


@query("direction_agreement", "G35", f"""WITH {LAG_SQL}, m AS (SELECT lag, lat, lon, avg(u) AS mx, avg(v) AS my FROM ea GROUP BY 1, 2, 3)
SELECT ea.lag, ea.lat, ea.lon, {R('any_value(mx)')} AS mean_x, {R('any_value(my)')} AS mean_y, {R('CASE WHEN any_value(mx) <> 0 OR any_value(my) <> 0 THEN avg(CASE WHEN round(u * mx + v * my, 12) > 0 THEN 1.0 ELSE 0.0 END) END')} AS agreement FROM ea JOIN m ON m.lag = ea.lag AND m.lat = ea.lat AND m.lon = ea.lon GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(g.direction_agreement(_event_fields(spark, sf), ["lag", "lat", "lon"], "u", "v"), "mean_x", "mean_y", "agreement")


@query("group_composites", "G36", f"""WITH {LAG_SQL}, c AS (SELECT lag, lon, duration_group AS d, avg(a) AS m, count(a) AS n FROM ea GROUP BY 1, 2, 3)
SELECT lag, lon, {R("max(m) FILTER (WHERE d = 'short')")} AS short_mean, {R("max(m) FILTER (WHERE d = 'intermediate')")} AS intermediate_mean, max(n) FILTER (WHERE d = 'short') AS short_count, max(n) FILTER (WHERE d = 'intermediate') AS intermediate_count, {R("max(m) FILTER (WHERE d = 'short') - max(m) FILTER (WHERE d = 'intermediate')")} AS difference FROM c GROUP BY 1, 2""")
def _(spark, sf):
    c = g.lag_composite(anomalies(spark, sf), lags(spark, sf), ["lon"], "t_anom", ["duration_group"])
    return rounded(g.group_difference_composite(c, ["lag", "lon"], "duration_group", "short", "intermediate"), "short_mean", "intermediate_mean", "difference")


IO_SQL = f"""{CAT_SQL}, {GRID_DAILY_SQL}, dd AS (SELECT DISTINCT CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS time FROM cat),
io AS (SELECT CAST(year(g.time) - CASE WHEN month(g.time) <= 2 THEN 1 ELSE 0 END AS INTEGER) AS season, lat, lon, t, dd.time IS NOT NULL AS ins FROM grid g LEFT JOIN dd ON dd.time = g.time WHERE month(g.time) IN (12, 1, 2))"""


def inside_outside(spark, sf):
    from ..operators.events import event_days
    dd = event_days(primary(spark, sf)).select(F.col("date").alias("time")).distinct().withColumn("inside", F.lit(True))
    d = grid_daily(spark, sf).filter(F.month("time").isin(12, 1, 2)).join(dd, "time", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    return g.inside_outside(d.withColumn("season", F.year("time") - F.when(F.month("time") <= 2, 1).otherwise(0)), ["season", "lat", "lon"], "t", F.col("inside"))


@query("inside_outside_means", "G37", f"WITH {IO_SQL} SELECT season, lat, lon, {R('avg(t)')} AS all_mean, {R('avg(t) FILTER (WHERE ins)')} AS inside_mean, {R('avg(t) FILTER (WHERE NOT ins)')} AS outside_mean, count(t) FILTER (WHERE ins) AS inside_count FROM io GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(inside_outside(spark, sf), "all_mean", "inside_mean", "outside_mean")
