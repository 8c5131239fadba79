"""Event-aligned analysis, resampling and testing."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.single import attach
from ..functions import calendar as cal
from ..operators import align as al, climatology as k, events as ev, rank_tests as rt, resample as rs
from .q_climate import NATION_SQL, national
from .q_events import CAT_SQL, DAILY_SQL, REV_SQL, SWEEP_SQL, daily_and_primary, primary, reversal_series, swept
from .q_grid import IO_SQL, LAG_SQL, SEC_SQL, _event_fields, inside_outside, rounded, sectors
from .registry import GRID_DAILY_SQL, R, grid_daily, query, r6, table

REPS = 10_000
COV_SQL = "nat AS (SELECT date, avg(tmax) AS x, avg(tmin) AS y FROM sd GROUP BY 1), cov AS (SELECT date, CAST(year(date) - CASE WHEN month(date) <= 6 THEN 1 ELSE 0 END AS INTEGER) AS season_y, strftime(date, '%m-%d') AS month_day, round(x, 9) - 54 AS x, round(y, 9) - 25.4 AS y FROM nat)"


def cov(spark, sf):
    n = national(spark, sf)
    return n.select("date", cal.season_year(F.col("date"), 6).alias("season_y"), "month_day", (F.round("x", 9) - 54).alias("x"), (F.round("y", 9) - 25.4).alias("y"))


def boot(src: str, keys: str, value: str, block: str = "season", draw: str | None = None, sums: str | None = None) -> str:
    """CTEs bl, pl, bs, dr: the hash plan and the replicate draws per key."""
    sums = sums or f"sum({value}) AS s, count({value}) AS n"
    draw = draw or "sum(w * s) / nullif(sum(w * n), 0)"
    ks = keys + ", " if keys else ""
    return f"""bl AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS i FROM (SELECT DISTINCT {block} AS b FROM {src} WHERE {value} IS NOT NULL)),
pl AS (SELECT r AS rep, CAST('0x' || substr(md5('42:' || CAST(r AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT count(*) FROM bl) AS i, count(*) AS w FROM (SELECT unnest(range({REPS})) AS r) a, (SELECT unnest(range((SELECT count(*) FROM bl))) AS j) b GROUP BY 1, 2),
bs AS (SELECT {ks}i, {sums} FROM {src} JOIN bl ON {block} = b WHERE {value} IS NOT NULL GROUP BY {ks}i), dr0 AS (SELECT {ks}rep, {draw} AS d FROM bs JOIN pl USING (i) GROUP BY {ks}rep), dr AS (SELECT * FROM dr0 WHERE d IS NOT NULL)"""


BOOT_OUT = (f"{R('quantile_cont(d, 0.025)', 5)} AS ci_low, {R('quantile_cont(d, 0.975)', 5)} AS ci_high, count(*) AS n_valid, "
            + R("least(1.0, 2.0 * (least(count(*) FILTER (WHERE round(d, 12) <= 0), count(*) FILTER (WHERE round(d, 12) >= 0)) + 1) / (count(*) + 1))") + " AS p_value")


MAP_OUT = BOOT_OUT.replace("DOUBLE, 5)", "DOUBLE, 3)")


def boot_cols(df, keys, digits=5):
    return df.select(*keys, r6("ci_low", digits).alias("ci_low"), r6("ci_high", digits).alias("ci_high"), "n_valid", r6("p_value").alias("p_value"))


# ---------------------------------------------------------------- alignment
AL_SQL = f"""{CAT_SQL}, {COV_SQL}, al AS (SELECT event_id, season, duration_group, duration_days, 'onset' AS align, CAST(o AS INTEGER) AS lag, CAST(start_date + CAST(o AS INTEGER) AS DATE) AS date FROM cat, (SELECT unnest(range(-10, 6)) AS o) UNION ALL SELECT event_id, season, duration_group, duration_days, 'end', CAST(o AS INTEGER), CAST(end_date + CAST(o AS INTEGER) AS DATE) FROM cat, (SELECT unnest(range(-5, 6)) AS o)),
ar AS (SELECT al.*, x, y FROM al JOIN cov USING (date))"""
KEEP = ["season", "duration_group", "duration_days"]


def aligned(spark, sf):
    return al.aligned_rows(cov(spark, sf).select("date", "x", "y"), primary(spark, sf), (-10, 5), (-5, 5), KEEP)


@query("aligned_lag_means", "A01 A02", f"WITH {AL_SQL} SELECT align, duration_group, lag, {R('avg(x)')} AS x_mean, count(x) AS x_count, {R('avg(y)')} AS y_mean, count(y) AS y_count FROM ar GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(al.lag_means(aligned(spark, sf), ["x", "y"], ["duration_group"]), "x_mean", "y_mean")


@query("event_window_means", "A03", f"""WITH {AL_SQL}, w("window", a, f, t) AS (VALUES ('pre', 'onset', -7, -1), ('first3', 'onset', 0, 2), ('last2', 'end', -1, 0))
SELECT event_id, season, duration_group, duration_days, "window", {R('avg(x)')} AS x, {R('avg(y)')} AS y, count(*) AS day_count FROM ar JOIN w ON a = align AND lag BETWEEN f AND t GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    w = al.window_means(aligned(spark, sf), {"pre": ("onset", -7, -1), "first3": ("onset", 0, 2), "last2": ("end", -1, 0)}, ["x", "y"], KEEP)
    return rounded(w, "x", "y")


@query("own_day_means", "A04", f"WITH {CAT_SQL}, {COV_SQL} SELECT event_id, season, {R('avg(x)')} AS x, {R('avg(y)')} AS y, count(*) AS day_count FROM cat JOIN cov ON cov.date BETWEEN start_date AND end_date GROUP BY 1, 2")
def _(spark, sf):
    return rounded(al.own_day_means(cov(spark, sf), primary(spark, sf), ["x", "y"], ["season"]), "x", "y")


LC_SQL = f"""{AL_SQL}, lf AS (SELECT season, align, lag, 'x' AS variable, x AS value FROM ar UNION ALL SELECT season, align, lag, 'y', y FROM ar), {boot('lf', 'align, variable, lag', 'value')}"""


def bands(spark, sf):
    long = al.long_form(aligned(spark, sf), ["season", "align", "lag"], ["x", "y"])
    return rs.bootstrap_mean(long, ["align", "variable", "lag"], "value", "season", REPS, 42)


@query("lag_bands", "A05 B01 B02 B03", f"WITH {LC_SQL} SELECT align, variable, lag, {BOOT_OUT} FROM dr GROUP BY 1, 2, 3")
def _(spark, sf):
    return boot_cols(bands(spark, sf), ["align", "variable", "lag"])


@query("sustained_lead", "A06", f"""WITH {LC_SQL}, ci AS (SELECT align, variable, lag, round(quantile_cont(d, 0.025), 5) AS lo, round(quantile_cont(d, 0.975), 5) AS hi FROM dr WHERE align = 'onset' AND lag <= 0 GROUP BY 1, 2, 3), s AS (SELECT *, CASE WHEN lo > 0 THEN 1 WHEN hi < 0 THEN -1 ELSE 0 END AS sg FROM ci),
z AS (SELECT s.*, f.sg AS s0 FROM s JOIN (SELECT align, variable, sg FROM s WHERE lag = 0) f ON f.align = s.align AND f.variable = s.variable), b AS (SELECT align, variable, max(lag) FILTER (WHERE sg <> s0 OR sg = 0) AS stop, min(lag) AS lo, any_value(s0) AS s0 FROM z GROUP BY 1, 2)
SELECT align, variable, CAST(CASE WHEN s0 = 0 THEN NULL WHEN stop IS NULL THEN lo ELSE stop + 1 END AS INTEGER) AS lead_lag, CAST(CASE WHEN s0 <> 0 THEN s0 END AS INTEGER) AS lead_sign FROM b""")
def _(spark, sf):
    b = bands(spark, sf).filter("align = 'onset'").withColumn("ci_low", F.round("ci_low", 5)).withColumn("ci_high", F.round("ci_high", 5))
    return al.sustained_lead(b, ["align", "variable"])


DIFF_DRAW = "sum(w * sa) / nullif(sum(w * na), 0) - sum(w * sb) / nullif(sum(w * nb), 0)"
CT_SQL = f"""{CAT_SQL}, {COV_SQL}, om AS (SELECT event_id, season, duration_group, avg(x) AS x, avg(y) AS y FROM cat JOIN cov ON cov.date BETWEEN start_date AND end_date GROUP BY 1, 2, 3), lf AS (SELECT season, duration_group AS g, 'x' AS variable, x AS value FROM om UNION ALL SELECT season, duration_group, 'y', y FROM om),
{boot('lf', 'variable', 'value', draw=DIFF_DRAW, sums="coalesce(sum(value) FILTER (WHERE g <> 'short'), 0) AS sa, count(value) FILTER (WHERE g <> 'short') AS na, coalesce(sum(value) FILTER (WHERE g = 'short'), 0) AS sb, count(value) FILTER (WHERE g = 'short') AS nb")}"""


@query("type_contrasts", "A07 B04", f"WITH {CT_SQL} SELECT variable, {BOOT_OUT}, (SELECT count(*) FROM om WHERE duration_group <> 'short') AS n_a, (SELECT count(*) FROM om WHERE duration_group = 'short') AS n_b FROM dr GROUP BY 1")
def _(spark, sf):
    m = al.own_day_means(cov(spark, sf), primary(spark, sf), ["x", "y"], ["season", "duration_group"])
    short = F.col("duration_group") == "short"
    d = rs.bootstrap_difference(al.long_form(m, ["season", "duration_group"], ["x", "y"]), ["variable"], "value", "season", ~short, short, REPS, 42)
    return boot_cols(d, ["variable", "n_a", "n_b"])


@query("joined_covariates", "A08", f"""WITH {NATION_SQL}, {GRID_DAILY_SQL}, b AS (SELECT time AS date, avg(t) AS box_t FROM grid WHERE lat <= 35 GROUP BY 1), c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, 1 AS has_order FROM orders)
SELECT nat.date, {R('y')} AS y, {R('box_t')} AS box_t, {R('box_t - p.pt')} AS box_t_tend, has_order FROM nat LEFT JOIN b USING (date) LEFT JOIN (SELECT CAST(date + 1 AS DATE) AS date, box_t AS pt FROM b) p USING (date) LEFT JOIN c USING (date)""")
def _(spark, sf):
    b = grid_daily(spark, sf).filter("lat <= 35").groupBy(F.col("time").alias("date")).agg(F.avg("t").alias("box_t"))
    b = k.tendency(b, [], "date", "box_t", "box_t_tend")
    c = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.lit(1).alias("has_order")).distinct()
    return rounded(al.join_families(national(spark, sf).select("date", "y"), [b, c]), "y", "box_t", "box_t_tend")


@query("window_features", "A09")
def _(spark, sf):
    from ..operators import grid as g, grid_kernels as gk
    s = sectors(spark, sf).withColumn("year", F.year("time")).withColumn("limit", F.lit(0.3))
    pk = gk.peaks(s, ["sector", "year"], "time", "sector_mean", "limit", 3)
    d = g.sector_episodes(sectors(spark, sf), 2).join(pk, ["sector", "time"]).select(
        "sector", F.col("time").alias("date"), F.col("sector_mean").alias("value"), "standardised", F.col("sector_p90").alias("limit"), "high_day", "episode", "is_peak")
    have = d.groupBy("date").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    c = primary(spark, sf)
    full = ev.event_days(c, 10, 0).join(have, "date", "left").groupBy("event_id").agg(F.count_if(F.col("n").isNull()).alias("gap")).filter("gap = 0")
    return al.window_features(d, c.join(full.select("event_id"), "event_id", "left_semi"), {"pre10": (-10, -1), "first3": (0, 2)}, ["season"])


# ---------------------------------------------------------------- bootstrap, slopes, leave one out
@query("map_bootstrap", "B05 B03", f"""WITH {LAG_SQL}, {boot('ea', 'lat, lon, lag', 'a')} SELECT lat, lon, lag, {MAP_OUT} FROM dr GROUP BY 1, 2, 3""")
def _(spark, sf):
    return boot_cols(rs.bootstrap_mean(_event_fields(spark, sf), ["lat", "lon", "lag"], "t_anom", "season", REPS, 42), ["lat", "lon", "lag"], 3)


@query("map_group_difference", "B05 B04", f"""WITH {LAG_SQL}, {boot('ea', 'lat, lon, lag', 'a', draw=DIFF_DRAW, sums="coalesce(sum(a) FILTER (WHERE duration_group <> 'short'), 0) AS sa, count(a) FILTER (WHERE duration_group <> 'short') AS na, coalesce(sum(a) FILTER (WHERE duration_group = 'short'), 0) AS sb, count(a) FILTER (WHERE duration_group = 'short') AS nb")}
SELECT lat, lon, lag, {MAP_OUT} FROM dr GROUP BY 1, 2, 3""")
def _(spark, sf):
    short = F.col("duration_group") == "short"
    d = rs.bootstrap_difference(_event_fields(spark, sf), ["lat", "lon", "lag"], "t_anom", "season", ~short, short, REPS, 42)
    return boot_cols(d.filter("n_valid > 0"), ["lat", "lon", "lag"], 3)


@query("duration_trend", "B12", f"""WITH {SWEEP_SQL}, trd AS (SELECT scenario, season, event_id, count(*) AS d FROM evd WHERE event_id IS NOT NULL GROUP BY 1, 2, 3), {boot('trd', 'scenario', 'd', draw='(sum(w*n)*sum(w*xy) - sum(w*x)*sum(w*yv)) / nullif(round(sum(w*n)*sum(w*xx) - pow(sum(w*x), 2), 9), 0)', sums='count(*) AS n, sum(season / 10.0::DOUBLE - 199.5) AS x, sum(d)::DOUBLE AS yv, sum(pow(season / 10.0::DOUBLE - 199.5, 2)) AS xx, sum((season / 10.0::DOUBLE - 199.5) * d) AS xy')}, ob AS (SELECT scenario, {R('regr_slope(d, season / 10.0::DOUBLE)', 5)} AS observed FROM trd GROUP BY 1)
SELECT scenario, any_value(observed) AS observed, {R('quantile_cont(d, 0.025)', 4)} AS ci_low, {R('quantile_cont(d, 0.975)', 4)} AS ci_high FROM dr JOIN ob USING (scenario) GROUP BY 1""")
def _(spark, sf):
    c = swept(spark, sf).filter("event_id IS NOT NULL").groupBy("scenario", "season", "event_id").agg(F.count(F.lit(1)).cast("double").alias("d"))
    s = rs.bootstrap_slope(c, ["scenario"], F.col("season") - 1995, "d", "season", REPS, 42)
    return s.select("scenario", r6("observed", 5).alias("observed"), r6("ci_low", 4).alias("ci_low"), r6("ci_high", 4).alias("ci_high"))


@query("leave_one_season_out", "B13", f"""WITH {LAG_SQL}, b AS (SELECT lat, lon, lag, season, sum(a) AS s, count(a) AS n FROM ea GROUP BY 1, 2, 3, 4), t AS (SELECT lat, lon, lag, sum(s) AS ts, sum(n) AS tn FROM b GROUP BY 1, 2, 3), j AS (SELECT b.*, round(ts / tn, 12) AS f, round(s / n, 12) AS o, CASE WHEN tn > n THEN round((ts - s) / (tn - n), 12) END AS r, ts, tn FROM b JOIN t USING (lat, lon, lag))
SELECT lat, lon, lag, {R('max(ts / tn)')} AS mean, count(*) AS block_count, {R('avg(CASE WHEN r IS NOT NULL THEN CASE WHEN sign(r) = sign(f) THEN 1.0 ELSE 0.0 END END)')} AS loo_sign_stability, {R('avg(CASE WHEN sign(o) = sign(f) THEN 1.0 ELSE 0.0 END)')} AS same_sign_fraction, {R('avg(s / n)')} AS block_equal_mean, {R('min(r)')} AS loo_low, {R('max(r)')} AS loo_high FROM j GROUP BY 1, 2, 3""")
def _(spark, sf):
    lo = rs.leave_one_out(_event_fields(spark, sf), ["lat", "lon", "lag"], "t_anom", "season")
    return rounded(lo, "mean", "loo_sign_stability", "same_sign_fraction", "block_equal_mean", "loo_low", "loo_high")


# ---------------------------------------------------------------- sign flips and false discovery
FLIP_SQL = f"""{IO_SQL}, df AS (SELECT lat, lon, season, avg(t) FILTER (WHERE ins) - avg(t) FILTER (WHERE NOT ins) AS d FROM io GROUP BY 1, 2, 3), dn AS (SELECT lat, lon, d, row_number() OVER (PARTITION BY lat, lon ORDER BY season) - 1 AS i, count(*) OVER (PARTITION BY lat, lon) AS n FROM df WHERE d IS NOT NULL), ob AS (SELECT lat, lon, any_value(n) AS n, abs(sum(d)) AS o, sum(abs(d)) AS tot, avg(d) AS m FROM dn GROUP BY 1, 2),
fl AS (SELECT dn.lat, dn.lon, p, abs(sum(CASE WHEN (p >> CAST(i AS INTEGER)) & 1 = 1 THEN -d ELSE d END)) AS f FROM dn, (SELECT CAST(unnest(range(0, 1024)) AS INTEGER) AS p) WHERE p < pow(2, n) GROUP BY 1, 2, 3), pv AS (SELECT ob.lat, ob.lon, any_value(n) AS n, any_value(m) AS m, least(1, avg(CASE WHEN f >= o - 1e-9 * tot THEN 1.0 ELSE 0.0 END)) AS p FROM fl JOIN ob ON ob.lat = fl.lat AND ob.lon = fl.lon GROUP BY 1, 2)"""


def flips(spark, sf):
    d = inside_outside(spark, sf).select("lat", "lon", "season", (F.col("inside_mean") - F.col("outside_mean")).alias("d")).filter("d IS NOT NULL")
    return rs.sign_flip(d, ["lat", "lon"], "season", "d")


@query("inside_outside_sign_flip", "B06 B07 B24", f"""WITH {FLIP_SQL}, rk AS (SELECT *, round(p, 9) * count(*) OVER (PARTITION BY lat) / (rank() OVER (PARTITION BY lat ORDER BY round(p, 9)) + count(*) OVER (PARTITION BY lat, round(p, 9)) - 1) AS raw FROM pv)
SELECT lat, lon, CAST(n AS INTEGER) AS block_count, {R('m')} AS mean_difference, {R('p')} AS p_value, {R('least(1, min(raw) OVER (PARTITION BY lat ORDER BY round(p, 9) RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS q_value FROM rk""")
def _(spark, sf):
    f = flips(spark, sf).withColumn("p_value", F.round("p_value", 9))
    return rounded(rs.benjamini_hochberg(f, ["lat"], "p_value"), "mean_difference", "p_value", "q_value")


BH_SQL = """t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, CASE WHEN l_quantity > 3 THEN l_extendedprice / 120000 END AS p FROM lineitem)"""


def _bh(part, out):
    w = f"PARTITION BY {part}" if part else ""
    return f"""least(1, min(p * cnt / rk) OVER ({w} ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("false_discovery_by_family", "B07 B08", f"""WITH {BH_SQL}, a AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag) AS cnt, rank() OVER (PARTITION BY l_returnflag ORDER BY p) + count(*) OVER (PARTITION BY l_returnflag, p) - 1 AS rk FROM t WHERE p IS NOT NULL),
b AS (SELECT *, {_bh('l_returnflag', '')} AS qf FROM a), g0 AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, p, qf, count(*) OVER () AS cnt, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rk FROM b), g AS (SELECT *, {_bh('', '')} AS qa FROM g0)
SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, {R('qf')} AS q_family, {R('qa')} AS q_all FROM g UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, NULL, NULL FROM t WHERE p IS NULL""")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", F.when(F.col("l_quantity") > 3, F.col("l_extendedprice") / 120000).alias("p"))
    q = rs.benjamini_hochberg(rs.benjamini_hochberg(t, ["l_returnflag"], "p", "q_family"), [], "p", "q_all")
    return rounded(q.drop("p"), "q_family", "q_all")


# ---------------------------------------------------------------- rank correlation
@query("spearman_by_customer_segment", "B09 B10", f"""WITH t AS (SELECT c_nationkey, c_acctbal AS x, n.tot AS y, n.cnt AS z FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS tot, count(*) AS cnt FROM orders GROUP BY 1) n ON n.o_custkey = c_custkey),
r AS (SELECT c_nationkey, {', '.join(f"rank() OVER (PARTITION BY c_nationkey ORDER BY round({c}, 2)) + (count(*) OVER (PARTITION BY c_nationkey, round({c}, 2)) - 1) / 2.0::DOUBLE AS r{c}" for c in 'xyz')} FROM t), g AS (SELECT c_nationkey, count(*) AS n, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM r GROUP BY 1)
SELECT c_nationkey, n, {R('xy')} AS rho, {R('(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))')} AS partial_rho FROM g""")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"), F.count(F.lit(1)).alias("z"))
    t = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.round("c_acctbal", 2).alias("x")).join(o, "c_custkey")
    s = rs.spearman(t, ["c_nationkey"], "x", "y")
    p = rs.partial_spearman(t, ["c_nationkey"], "x", "y", "z").select("c_nationkey", F.col("rho").alias("partial_rho"))
    return rounded(s.join(p, "c_nationkey"), "rho", "partial_rho")


def window_table(spark, sf):
    return al.window_means(aligned(spark, sf), {"pre": ("onset", -7, -1), "first3": ("onset", 0, 2)}, ["x", "y"], KEEP)


def weighted_spearman(keys: str, columns: list[str], src: str) -> str:
    """CTEs of the partial rank correlation rho of the first two of ``columns`` in ``src`` under each replicate of pl (by keys and rep; n events)."""
    third = columns[2:]
    ranks = ", ".join(f"sum(w) OVER (PARTITION BY {keys}, rep ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (sum(w) OVER (PARTITION BY {keys}, rep, {c}) - 1) / 2.0::DOUBLE AS r_{c}" for c in columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cov = ", ".join(f"sum(w * r_{a} * r_{b}) / sum(w) - sum(w * r_{a}) / sum(w) * (sum(w * r_{b}) / sum(w)) AS c_{a}_{b}" for a, b in pairs)
    a, b = columns[:2]
    if third:
        z = third[0]
        top, x, y = f"c_{a}_{b} - c_{a}_{z} * c_{b}_{z} / c_{z}_{z}", f"c_{a}_{a} - c_{a}_{z} * c_{a}_{z} / c_{z}_{z}", f"c_{b}_{b} - c_{b}_{z} * c_{b}_{z} / c_{z}_{z}"
    else:
        top, x, y = f"c_{a}_{b}", f"c_{a}_{a}", f"c_{b}_{b}"
    return f"""rr AS (SELECT {keys}, rep, w, {ranks} FROM {src} JOIN bl ON season = b JOIN pl USING (i)), cv AS (SELECT {keys}, rep, sum(w) AS n, {cov} FROM rr GROUP BY {keys}, rep),
rho AS (SELECT {keys}, rep, n, CASE WHEN n > 3 AND {x} > 1e-12 * c_{a}_{a} AND {y} > 1e-12 * c_{b}_{b} THEN ({top}) / sqrt(({x}) * ({y})) END AS d FROM cv)"""


RANK_OUT = f"""{R('max(d) FILTER (WHERE rep = -1)', 5)} AS observed, {R('stddev_samp(d) FILTER (WHERE rep >= 0)', 5)} AS se, {R('quantile_cont(d, 0.025) FILTER (WHERE rep >= 0)', 5)} AS ci_low, {R('quantile_cont(d, 0.975) FILTER (WHERE rep >= 0)', 5)} AS ci_high,
count(d) FILTER (WHERE rep >= 0) AS n_valid, CAST(max(n) FILTER (WHERE rep = -1) AS BIGINT) AS n, {R('least(1.0, 2.0 * (least(count(*) FILTER (WHERE rep >= 0 AND round(d, 12) <= 0), count(*) FILTER (WHERE rep >= 0 AND round(d, 12) >= 0)) + 1) / (count(d) FILTER (WHERE rep >= 0) + 1))')} AS p_value"""
PLANS_SQL = f"""bl AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS i FROM (SELECT DISTINCT season AS b FROM ev)),
pl AS (SELECT r AS rep, CAST('0x' || substr(md5('42:' || CAST(r AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT count(*) FROM bl) AS i, count(*)::DOUBLE AS w FROM (SELECT unnest(range({REPS})) AS r), (SELECT unnest(range((SELECT count(*) FROM bl))) AS j) GROUP BY 1, 2 UNION ALL SELECT -1, i, 1.0 FROM bl)"""
SPEARMAN_SQL = f"""WITH {AL_SQL}, wn("window", a, f, t) AS (VALUES ('pre', 'onset', -7, -1), ('first3', 'onset', 0, 2)),
ev AS MATERIALIZED (SELECT * FROM (SELECT "window" AS win, event_id, season, duration_days::DOUBLE AS d, avg(x) AS x, avg(y) AS y FROM ar JOIN wn ON a = align AND lag BETWEEN f AND t GROUP BY 1, 2, 3, 4) WHERE x IS NOT NULL AND y IS NOT NULL), {PLANS_SQL}, {weighted_spearman('win', ['d', 'x', 'y'], 'ev')},
pr AS MATERIALIZED (SELECT win, event_id, r_d, r_x, r_y, row_number() OVER (PARTITION BY win ORDER BY event_id || ':') AS i FROM (SELECT win, event_id, {', '.join(f"rank() OVER (PARTITION BY win ORDER BY {c}) + (count(*) OVER (PARTITION BY win, {c}) - 1) / 2.0::DOUBLE AS r_{c}" for c in 'dxy')} FROM ev)),
pm AS (SELECT win, p, r_x, r_y, row_number() OVER (PARTITION BY win, p ORDER BY md5('42:' || CAST(p AS VARCHAR) || ':' || event_id)) AS i FROM pr, (SELECT unnest(range({REPS})) AS p)),
pc AS (SELECT win, p, corr(pr.r_d, pm.r_x) AS xy, corr(pr.r_d, pm.r_y) AS xz, corr(pm.r_x, pm.r_y) AS yz FROM pm JOIN pr USING (win, i) GROUP BY 1, 2),
ph AS (SELECT pc.win, count(*) FILTER (WHERE abs((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))) >= abs(rho.d) - 1e-9) AS hits FROM pc JOIN rho ON rho.win = pc.win AND rep = -1 GROUP BY 1)
SELECT win AS "window", {RANK_OUT}, {R(f'(any_value(hits) + 1.0) / {REPS + 1}')} AS p_permutation FROM rho JOIN ph USING (win) GROUP BY 1"""


@query("spearman_intervals", "B09 B10 B11", SPEARMAN_SQL)
def _(spark, sf):
    w = window_table(spark, sf).withColumn("d", F.col("duration_days").cast("double"))
    got = rt.spearman_interval(w, ["window"], ["d", "x", "y"], "season", permutations=10_000, row=["event_id"])
    return rounded(rounded(got.drop("n_le", "n_ge"), "observed", "se", "ci_low", "ci_high", digits=5), "p_value", "p_permutation")


# ---------------------------------------------------------------- matched nulls
@query("matched_onset_values", "B14", f"""WITH {CAT_SQL}, {COV_SQL}, p AS (SELECT month_day, list(x ORDER BY x) AS a FROM cov GROUP BY 1), j AS (SELECT r AS rep, a[CAST('0x' || substr(md5('7:' || CAST(r AS VARCHAR) || ':' || event_id), 1, 8) AS BIGINT) % len(a) + 1] AS v FROM cat JOIN p ON p.month_day = strftime(start_date, '%m-%d'), (SELECT unnest(range({REPS})) AS r))
SELECT CAST(rep AS INTEGER) AS rep, {R('avg(v)')} AS null_value, count(*) AS onset_count FROM j GROUP BY 1""")
def _(spark, sf):
    o = primary(spark, sf).withColumn("month_day", F.date_format("start_date", "MM-dd"))
    return rounded(rs.matched_values(o, cov(spark, sf), "x", REPS, 7), "null_value")


NULL_SQL = f"""{REV_SQL}, ss AS (SELECT min(y) AS lo, max(y) AS hi FROM (SELECT year(date) - CASE WHEN month(date) <= 6 THEN 1 ELSE 0 END AS y FROM r0)), c0 AS (SELECT strftime(central_date, '%Y%m%d') AS id, central_date AS date, year(central_date) - CASE WHEN month(central_date) <= 6 THEN 1 ELSE 0 END AS own FROM rev), c1 AS (SELECT id, date, s.s, s.s + CASE WHEN month(date) >= 7 THEN 0 ELSE 1 END AS y FROM c0, (SELECT unnest(range(lo, hi + 1)) AS s FROM ss) s WHERE s.s <> own),
c2 AS (SELECT id, date, CAST(least(make_date(y, month(date), 1) + INTERVAL (day(date) - 1) DAY, make_date(y, month(date), 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY) AS DATE) AS candidate FROM c1), c3 AS (SELECT c2.*, EXISTS (SELECT 1 FROM c0 WHERE abs(c0.date - c2.candidate) <= 20) AS taken FROM c2),
adm AS (SELECT id, date, candidate, false AS fallback FROM c3 WHERE NOT taken UNION ALL SELECT id, date, candidate, true FROM c3 WHERE id NOT IN (SELECT id FROM c3 WHERE NOT taken)),
nul AS (SELECT CAST(r AS INTEGER) AS rep, id, bool_or(fallback) AS fallback, list(candidate ORDER BY candidate)[CAST('0x' || substr(md5('9:' || CAST(any_value(r) AS VARCHAR) || ':' || id), 1, 8) AS BIGINT) % count(*) + 1] AS null_date FROM adm, (SELECT unnest(range({REPS})) AS r) GROUP BY 1, 2)"""


def reversal_dates(spark, sf):
    d = ev.sign_reversals(reversal_series(spark, sf), "u", 8, 4)
    return d.select(F.date_format("central_date", "yyyyMMdd").alias("id"), F.col("central_date").alias("date"))


def controls(spark, sf, dates):
    """(candidates, first season, last season): every season that the series has dates of."""
    y = cal.season_year(F.col("date"), 6)
    first, last = reversal_series(spark, sf).agg(F.min(y), F.max(y)).first()
    return rs.admissible_dates(dates, first, last, 20), first, last


@query("matched_control_dates", "B15", f"WITH {NULL_SQL} SELECT * FROM nul")
def _(spark, sf):
    return rs.null_dates(controls(spark, sf, reversal_dates(spark, sf))[0], REPS, 9)


PHASE_SQL = NULL_SQL.replace("WHERE s.s <> own)", "WHERE s.s <> own AND s.s % 2 = own % 2)").replace(
    "INTERVAL 1 DAY) AS DATE) AS candidate FROM c1)", "INTERVAL 1 DAY) AS DATE) + CAST(o AS INTEGER) AS candidate FROM c1, (SELECT unnest(range(-3, 4)) AS o))")


@query("matched_control_dates_in_phase", "B15", f"WITH {PHASE_SQL} SELECT rep, id, fallback, CAST(null_date AS DATE) AS null_date FROM nul")
def _(spark, sf):
    d = reversal_dates(spark, sf)
    _, first, last = controls(spark, sf, d)
    phases = spark.range(first, last + 1).select(F.col("id").cast("int").alias("season"), (F.col("id") % 2).alias("phase"))
    return rs.null_dates(rs.admissible_dates(d, first, last, 20, jitter=3, phases=phases), REPS, 9)


@query("redraw_diagnostics", "B25", f"""WITH {NULL_SQL}, n AS (SELECT c0.id, count(*) FILTER (WHERE NOT taken) AS a FROM c0 JOIN c3 ON c3.id = c0.id GROUP BY 1) SELECT id, a AS admissible, {R('a / (hi - lo)::DOUBLE')} AS admissible_share, {R('CASE WHEN a > 0 THEN (hi - lo)::DOUBLE / a END')} AS expected_draws, a = 0 AS always_fails FROM n, ss""")
def _(spark, sf):
    d = reversal_dates(spark, sf)
    candidates, first, last = controls(spark, sf, d)
    return rounded(rs.redraw_diagnostics(d, candidates, last - first), "admissible_share", "expected_draws")


@query("onset_count_null", "B16 B17", f"""WITH {NULL_SQL}, x AS (SELECT CAST(o_orderdate AS DATE) AS start_date, count(DISTINCT o_orderkey) AS k FROM orders GROUP BY 1), wd AS (SELECT DISTINCT rep, CAST(null_date + CAST(o AS INTEGER) AS DATE) AS start_date FROM nul, (SELECT unnest(range(21)) AS o)), hit AS (SELECT rep, sum(k) AS c FROM wd JOIN x USING (start_date) GROUP BY 1),
a AS (SELECT r.rep, coalesce(c, 0)::DOUBLE AS c FROM (SELECT DISTINCT rep FROM nul) r LEFT JOIN hit ON hit.rep = r.rep), ob AS (SELECT sum(k)::DOUBLE AS o FROM (SELECT DISTINCT CAST(central_date + CAST(d AS INTEGER) AS DATE) AS start_date FROM rev, (SELECT unnest(range(21)) AS d)) JOIN x USING (start_date))
SELECT o AS observed, count(*) AS n, {R('avg(c)')} AS null_mean, {R('quantile_cont(c, 0.025)')} AS null_p025, {R('quantile_cont(c, 0.975)')} AS null_p975, (SELECT min(k) FROM range(0, 100000) t(k) WHERE (SELECT count(*) FROM a WHERE c >= k) <= 0.05 * (SELECT count(*) FROM a)) AS critical_value, {R('(count(*) FILTER (WHERE c >= o) + 1) / (count(*) + 1)')} AS p_one_sided, {R('least(1.0, 2.0 * (least(count(*) FILTER (WHERE c <= o), count(*) FILTER (WHERE c >= o)) + 1) / (count(*) + 1))')} AS p_two_sided, {R('var_pop(c) / avg(c)')} AS dispersion FROM a, ob GROUP BY o""")
def _(spark, sf):
    d = reversal_dates(spark, sf)
    x = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("start_date"))
    nul = rs.null_dates(controls(spark, sf, d)[0], REPS, 9)
    c = rs.onsets_in_windows(x, nul, 0, 20, ["rep"], "null_date")
    c = nul.select("rep").distinct().join(c, "rep", "left").select("rep", F.coalesce("onset_count", F.lit(0)).alias("c"))
    ob = rs.onsets_in_windows(x, d, 0, 20).select(F.col("onset_count").cast("double").alias("o"))
    s = rs.null_summary(attach(c, ob), "c", F.col("o"))
    return rounded(s, "null_mean", "null_p025", "null_p975", "p_one_sided", "p_two_sided", "dispersion")


EXPO_SQL = f"""{CAT_SQL}, ref AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 498000), inn AS (SELECT DISTINCT CAST(unnest(generate_series(start_date + 1, end_date, INTERVAL 1 DAY)) AS DATE) AS date FROM cat WHERE duration_days > 1), rk AS (SELECT season, date, EXISTS (SELECT 1 FROM ref WHERE dly.date BETWEEN ref.date AND ref.date + 15) AS w FROM dly WHERE date NOT IN (SELECT date FROM inn))"""


def _ref(spark, sf):
    return table(spark, sf, "orders").filter("o_totalprice > 498000").select(F.to_date("o_orderdate").alias("date")).distinct()


@query("at_risk_exposure", "B19", f"WITH {EXPO_SQL} SELECT season, count(*) AS at_risk_days, count(*) FILTER (WHERE w) AS window_days FROM rk GROUP BY 1")
def _(spark, sf):
    return rs.exposure(*daily_and_primary(spark, sf), _ref(spark, sf), 0, 15)


@query("rate_ratio_interval", "B20")
def _(spark, sf):
    d, c = daily_and_primary(spark, sf)
    e = rs.exposure(d, c, _ref(spark, sf), 0, 15)
    w = rs.window_days(_ref(spark, sf), 0, 15).select(F.col("day").alias("start_date"), F.lit(True).alias("_w"))
    o = c.join(w, "start_date", "left").groupBy("season").agg(F.count("_w").alias("k"), F.count_if(F.col("_w").isNull()).alias("m"))
    t = e.join(o, "season", "left").agg(F.sum("window_days").alias("din"), F.sum(F.col("at_risk_days") - F.col("window_days")).alias("dout"), F.sum("k").alias("k"), F.sum("m").alias("m"))
    return rs.rate_ratio(t, "k", "din", "m", "dout")


@query("quiet_day_contrast", "B21", f"""WITH {CAT_SQL}, nr AS (SELECT DISTINCT CAST(unnest(generate_series(start_date - 6, end_date + 6, INTERVAL 1 DAY)) AS DATE) AS date FROM cat), q AS (SELECT season, avg(weighted_mean) AS qm, count(*) AS n FROM dly WHERE date NOT IN (SELECT date FROM nr) AND weighted_mean IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)
SELECT c.event_id, c.start_date AS date, c.season, {R('d.weighted_mean')} AS onset_value, {R('qm')} AS quiet_mean, n AS quiet_days, {R('d.weighted_mean - qm')} AS contrast FROM cat c JOIN dly d ON d.date = c.start_date JOIN q ON q.season = c.season""")
def _(spark, sf):
    return rounded(rs.quiet_contrast(*daily_and_primary(spark, sf), "weighted_mean", 6, 5), "onset_value", "quiet_mean", "contrast")


@query("minimum_detectable", "B22 B26", f"""WITH {CT_SQL}, ci AS (SELECT variable, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM dr GROUP BY 1), sd2 AS (SELECT variable, count(*) FILTER (WHERE g <> 'short') AS na, var_samp(value) FILTER (WHERE g <> 'short') AS va, count(*) FILTER (WHERE g = 'short') AS nb, var_samp(value) FILTER (WHERE g = 'short') AS vb, stddev_samp(value) AS s FROM lf GROUP BY 1)
SELECT variable, {R('(hi - lo) / (2 * 1.959963984540054::DOUBLE)', 5)} AS se, {R('(1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) * (hi - lo) / (2 * 1.959963984540054::DOUBLE)', 5)} AS detectable, {R('sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))', 5)} AS pooled_sd, {R('s', 5)} AS predictor_sd FROM ci JOIN sd2 USING (variable)""")
def _(spark, sf):
    m = al.own_day_means(cov(spark, sf), primary(spark, sf), ["x", "y"], ["season", "duration_group"])
    long, short = al.long_form(m, ["season", "duration_group"], ["x", "y"]), F.col("duration_group") == "short"
    d = rs.bootstrap_difference(long, ["variable"], "value", "season", ~short, short, REPS, 42)
    se, mde = rs.minimum_detectable(F.col("ci_low"), F.col("ci_high"))
    sd = long.groupBy("variable").agg(F.stddev_samp("value").alias("predictor_sd"))
    j = d.select("variable", se.alias("se"), mde.alias("detectable")).join(rs.pooled_sd(long, ["variable"], "value", ~short, short).drop("n_a", "n_b"), "variable").join(sd, "variable")
    return rounded(j, "se", "detectable", "pooled_sd", "predictor_sd", digits=5)


REG_SQL = f"""{NATION_SQL}, {GRID_DAILY_SQL}, rg AS (SELECT lat, lon, g.t AS yv, nat.x AS xv, nat.y AS zv FROM grid g JOIN nat ON nat.date = g.time), c AS (SELECT lat, lon, count(*) AS n, corr(xv, yv) AS r, stddev_pop(xv) AS sx, stddev_pop(yv) AS sy, corr(xv, zv) AS xz, corr(yv, zv) AS yz FROM rg GROUP BY 1, 2)"""


def _reg(spark, sf):
    return grid_daily(spark, sf).select(F.col("time").alias("date"), "lat", "lon", "t").join(national(spark, sf).select("date", "x", "y"), "date")


@query("cell_regression", "B23", f"""WITH {REG_SQL} SELECT lat, lon, n, {R('r * sy / sx', 5)} AS slope, {R('r', 5)} AS r, {R('r * sqrt((n - 2) / (1 - r * r))', 4)} AS t, {R('(r - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))', 5)} AS partial_r, {R('(r - xz * yz) / (1 - xz * xz) * sy / sx', 5)} AS partial_slope FROM c""")
def _(spark, sf):
    d = _reg(spark, sf)
    a = rs.cell_regression(d, ["lat", "lon"], "t", "x")
    b = rs.cell_regression(d, ["lat", "lon"], "t", "x", "y").select("lat", "lon", F.col("r").alias("partial_r"), F.col("slope").alias("partial_slope"))
    j = rounded(a.join(b, ["lat", "lon"]), "slope", "r", "partial_r", "partial_slope", digits=5)
    return j.select("lat", "lon", "n", "slope", "r", r6("t", 4).alias("t"), "partial_r", "partial_slope")


@query("cell_regression_p", "B23 B07")
def _(spark, sf):
    return rs.benjamini_hochberg(rs.cell_regression(_reg(spark, sf), ["lat", "lon"], "t", "x"), [], "p_value")
