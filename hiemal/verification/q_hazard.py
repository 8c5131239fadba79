"""Discrete-time hazard models."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as al, climatology as k, events as ev, hazard as hz, rank_tests as rt, resample as rs, validation as vl
from ..session import cut_lineage, stage_table
from .q_climate import national
from .q_events import SWEEP_SQL, _scenario_catalogue, primary, swept
from .q_grid import rounded
from .q_resample import AL_SQL, COV_SQL, DIFF_DRAW, KEEP, PLANS_SQL, RANK_OUT, REPS, aligned, cov, weighted_spearman
from .registry import R, query, r6, table

SC_SQL = f"""{SWEEP_SQL}, {COV_SQL}, sc AS (SELECT season, event_id, min(date) AS start_date, max(date) AS end_date, count(*) AS dur FROM evd WHERE scenario = 'SHORT' AND event_id IS NOT NULL GROUP BY 1, 2),
rs0 AS (SELECT event_id, season, start_date, end_date, CAST(g AS INTEGER) AS event_age, ln(g) AS log_age, CAST(start_date + CAST(g AS INTEGER) - 1 AS DATE) AS date, CASE WHEN g = dur THEN 1 ELSE 0 END AS terminates FROM sc, (SELECT unnest(range(2, 40)) AS g) WHERE g <= dur)"""


def short_events(spark, sf):
    c = _scenario_catalogue(spark, sf, swept(spark, sf), "SHORT").select("season", "event_id", "start_date", "end_date", "duration_days")
    return cut_lineage(c)


def risk(spark, sf, lead=0, cat=None):
    return hz.risk_set(cat if cat is not None else short_events(spark, sf), cov(spark, sf), ["x", "y"], [], 2, lead)


def hazard_rows(spark, sf):
    """The risk set as a written stage: fits read it many times."""
    c = cov(spark, sf).select("date", "x", "y", (F.col("x") * 0.3 - F.col("y")).alias("xy"))
    return cut_lineage(hz.censor_season_end(hz.risk_set(short_events(spark, sf), c, ["x", "y", "xy"], [], 2)))


@query("risk_set", "H01 H02", f"""WITH {SC_SQL}, c AS (SELECT *, month(end_date) = 2 AND month(CAST(end_date + 1 AS DATE)) <> 2 AND date = end_date AS fin FROM rs0)
SELECT event_id, season, event_age, {R('log_age')} AS log_age, c.date, terminates, CASE WHEN fin THEN 0 ELSE terminates END AS terminates_censored, NOT fin AS kept_without_final, NOT (month(start_date) = 12 AND day(start_date) = 1) AS kept_without_left, {R('x', 5)} AS x, {R('y', 5)} AS y FROM c LEFT JOIN cov USING (date)""")
def _(spark, sf):
    r = risk(spark, sf)
    key = ["event_id", "event_age"]
    c = hz.censor_season_end(r).select(*key, F.col("terminates").alias("terminates_censored"))
    f = hz.censor_season_end(r, "drop_final").select(*key, F.lit(True).alias("kept_without_final"))
    left = hz.censor_season_end(r, "drop_left_truncated").select(*key, F.lit(True).alias("kept_without_left"))
    j = r.join(c, key).join(f, key, "left").join(left, key, "left")
    return rounded(rounded(j.select(*key, "season", "log_age", "date", "terminates", "terminates_censored", F.coalesce("kept_without_final", F.lit(False)).alias("kept_without_final"),
                            F.coalesce("kept_without_left", F.lit(False)).alias("kept_without_left"), "x", "y"), "log_age"), "x", "y", digits=5)


@query("lead_risk_set", "H03", f"""WITH {SC_SQL} SELECT event_id, event_age, r.date, terminates, {R('c.x', 5)} AS x, {R('c.y', 5)} AS y FROM rs0 r LEFT JOIN cov c ON c.date = r.date - 2""")
def _(spark, sf):
    return rounded(risk(spark, sf, 2).select("event_id", "event_age", "date", "terminates", "x", "y"), "x", "y", digits=5)


@query("standardised_risk_set", "H04", f"""WITH {SC_SQL}, r AS (SELECT rs0.*, x, y FROM rs0 JOIN cov USING (date)), a AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx FROM r), t AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx FROM r WHERE season < 1998)
SELECT event_id, event_age, {R('(x - a.mx) / a.sx', 5)} AS x_full, {R('(x - t.mx) / t.sx', 5)} AS x_training FROM r, a, t""")
def _(spark, sf):
    r = cut_lineage(risk(spark, sf))
    a = hz.standardise(r, ["x"]).select("event_id", "event_age", r6("x_z", 5).alias("x_full"))
    t = hz.standardise(r, ["x"], F.col("season") < 1998).select("event_id", "event_age", r6("x_z", 5).alias("x_training"))
    return a.join(t, ["event_id", "event_age"])


def newton(keys: str, steps: int = 30) -> str:
    """CTEs for logistic fits of t on v and a with weights w, for every ``keys`` of table d: Newton steps on the sums.

    fit holds the coefficients b0, b1, b2 and whether the last step was below 1e-10; keys with one class have no row.
    """
    det = "(s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02))"
    return f"""nw AS (SELECT {keys}, 0 AS it, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 1.0::DOUBLE AS move FROM d GROUP BY {keys} HAVING sum(w * t) > 0 AND sum(w * t) < sum(w)
  UNION ALL SELECT {keys}, it + 1, b0 + d0, b1 + d1, b2 + d2, greatest(abs(d0), abs(d1), abs(d2)) FROM (
    SELECT {keys}, it, b0, b1, b2, ((s11 * s22 - s12 * s12) * g0 + (s02 * s12 - s01 * s22) * g1 + (s01 * s12 - s02 * s11) * g2) / {det} AS d0,
      ((s12 * s02 - s01 * s22) * g0 + (s00 * s22 - s02 * s02) * g1 + (s01 * s02 - s00 * s12) * g2) / {det} AS d1,
      ((s01 * s12 - s11 * s02) * g0 + (s01 * s02 - s00 * s12) * g1 + (s00 * s11 - s01 * s01) * g2) / {det} AS d2 FROM (
      SELECT {keys}, it, b0, b1, b2, sum(w * (t - m)) AS g0, sum(w * (t - m) * v) AS g1, sum(w * (t - m) * a) AS g2, sum(w * m * (1 - m)) + 1e-10 AS s00, sum(w * m * (1 - m) * v) AS s01,
        sum(w * m * (1 - m) * a) AS s02, sum(w * m * (1 - m) * v * v) + 1e-10 AS s11, sum(w * m * (1 - m) * v * a) AS s12, sum(w * m * (1 - m) * a * a) + 1e-10 AS s22 FROM (
        SELECT {keys}, it, b0, b1, b2, t, w, v, a, 1 / (1 + exp(-greatest(-500, least(500, b0 + b1 * v + b2 * a)))) AS m FROM nw JOIN d USING ({keys}) WHERE it < {steps} AND move >= 1e-10)
      GROUP BY {keys}, it, b0, b1, b2))),
fit AS (SELECT {keys}, arg_max(b0, it) AS b0, arg_max(b1, it) AS b1, arg_max(b2, it) AS b2, arg_max(move, it) < 1e-10 AS conv FROM nw GROUP BY {keys})"""


def newton_many(keys: str, columns: list[str], steps: int = 30, tag: str = "") -> str:
    """As ``newton`` for any number of design columns: fit holds b0, b1, ..; the steps come from a Cholesky factor, one layer a number.

    ``tag`` ends the names of its tables (d, nw, fit), for a second fit in one statement."""
    k = len(columns) + 1
    x, bs = ["1", *columns], ", ".join(f"b{i}" for i in range(k))
    sums = [f"sum(w * (t - m) * {x[i]}) AS g{i}" for i in range(k)] + [f"sum(w * m * (1 - m) * {x[i]} * {x[j]}){' + 1e-10' if i == j else ''} AS s{j}_{i}" for j in range(k) for i in range(j + 1)]
    q = f"SELECT {keys}, it, {bs}, {', '.join(sums)} FROM (SELECT {keys}, it, {bs}, t, w, {', '.join(columns)}, 1 / (1 + exp(-greatest(-500, least(500, {' + '.join(f'b{i} * {x[i]}' for i in range(k))})))) AS m FROM nw{tag} JOIN d{tag} USING ({keys}) WHERE it < {steps} AND move >= 1e-10) GROUP BY {keys}, it, {bs}"
    layers = []
    for j in range(k):
        less = "".join(f" - l{j}_{m} * l{j}_{m}" for m in range(j))
        layers.append([f"sqrt(s{j}_{j}{less}) AS l{j}_{j}"])
        layers.append([f"(s{i}_{j}" + "".join(f" - l{i}_{m} * l{j}_{m}" for m in range(j)) + f") / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, k)] + [f"(g{j}" + "".join(f" - l{j}_{m} * f{m}" for m in range(j)) + f") / l{j}_{j} AS f{j}"])
    for i in reversed(range(k)):
        layers.append([f"(f{i}" + "".join(f" - l{m}_{i} * d{m}" for m in range(i + 1, k)) + f") / l{i}_{i} AS d{i}"])
    for layer in layers:
        q = f"SELECT *, {', '.join(layer)} FROM ({q})"
    zero = ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(k))
    return f"""nw{tag} AS (SELECT {keys}, 0 AS it, {zero}, 1.0::DOUBLE AS move FROM d{tag} GROUP BY {keys} HAVING sum(w * t) > 0 AND sum(w * t) < sum(w)
  UNION ALL SELECT {keys}, it + 1, {', '.join(f'b{i} + d{i}' for i in range(k))}, greatest({', '.join(f'abs(d{i})' for i in range(k))}) FROM ({q})),
fit{tag} AS (SELECT {keys}, {', '.join(f'arg_max(b{i}, it) AS b{i}' for i in range(k))}, arg_max(move, it) < 1e-10 AS conv FROM nw{tag} GROUP BY {keys})"""


@query("large_logistic_fit", "H05", f"""WITH RECURSIVE d AS (SELECT 1 AS one, l_quantity / 10 AS v, l_discount * 10 AS a, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS t, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL), {newton('one')}
SELECT term, {R('b', 4)} AS coefficient FROM (SELECT 'intercept' AS term, b0 AS b FROM fit UNION ALL SELECT 'q', b1 FROM fit UNION ALL SELECT 'd', b2 FROM fit)""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("terminates"), (F.col("l_quantity") / 10).alias("q"), (F.col("l_discount") * 10).alias("d"))
    got = hz.fit_large(d, ["q", "d"])
    return rounded(spark.createDataFrame([(a, float(b)) for a, b in got.items()], "term string, coefficient double"), "coefficient", digits=4)


MODELS = [("local", "x"), ("local", "y"), ("mixed", "xy")]


HAZARD_SQL = f"""{SC_SQL}, hz AS (SELECT season, log_age AS a, CASE WHEN month(end_date) = 2 AND month(CAST(end_date + 1 AS DATE)) <> 2 AND date = end_date THEN 0 ELSE terminates END AS t, x, y, x * 0.3 - y AS xy FROM rs0 LEFT JOIN cov USING (date)),
lo AS (SELECT 'local' AS family, 'x' AS predictor, x AS v, a, t, season FROM hz UNION ALL SELECT 'local', 'y', y, a, t, season FROM hz UNION ALL SELECT 'mixed', 'xy', xy, a, t, season FROM hz),
cm AS (SELECT * FROM lo WHERE v IS NOT NULL AND a IS NOT NULL), st AS (SELECT family, predictor, avg(v) AS mv, stddev_samp(v) AS sv, avg(a) AS ma, stddev_samp(a) AS sa FROM cm GROUP BY 1, 2),
zs AS (SELECT family, predictor, season, t::DOUBLE AS t, (v - mv) / sv AS v, (a - ma) / sa AS a FROM cm JOIN st USING (family, predictor)),
bl AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS i FROM (SELECT DISTINCT season AS b FROM hz))"""
PLAN_SQL = f"""pl AS (SELECT r AS rep, CAST('0x' || substr(md5('42:' || CAST(r AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT count(*) FROM bl) AS i, count(*)::DOUBLE AS w FROM (SELECT unnest(range({REPS})) AS r), (SELECT unnest(range((SELECT count(*) FROM bl))) AS j) GROUP BY 1, 2 UNION ALL SELECT -1, i, 1.0 FROM bl)"""
DESIGN_SQL = "d AS (SELECT family, predictor, rep, v, a, t, w FROM zs JOIN bl ON season = b JOIN pl USING (i))"
FITTED = f"WITH RECURSIVE {HAZARD_SQL}, {PLAN_SQL}, {DESIGN_SQL}, {newton('family, predictor, rep')}"
RATIO_SQL = f"""SELECT family, predictor, n_rows, n_terminations, {R('exp(o)', 5)} AS odds_ratio_per_sd, {R('exp(l)', 5)} AS ci_low, {R('exp(h)', 5)} AS ci_high, {R('least(1.0, 2.0 * (least(le, ge) + 1) / (n + 1))')} AS p_bootstrap, n AS n_boot_valid, bad AS n_not_converged, l > 0 OR h < 0 AS ci_excludes_one
FROM (SELECT family, predictor, max(b1) FILTER (WHERE rep = -1) AS o, quantile_cont(b1, 0.025) FILTER (WHERE rep >= 0) AS l, quantile_cont(b1, 0.975) FILTER (WHERE rep >= 0) AS h, count(*) FILTER (WHERE rep >= 0) AS n, count(*) FILTER (WHERE rep >= 0 AND NOT conv) AS bad,
  count(*) FILTER (WHERE rep >= 0 AND b1 <= 0) AS le, count(*) FILTER (WHERE rep >= 0 AND b1 >= 0) AS ge FROM fit GROUP BY 1, 2) JOIN (SELECT family, predictor, count(*) AS n_rows, CAST(sum(t) AS INTEGER) AS n_terminations FROM cm GROUP BY 1, 2) USING (family, predictor)"""


def ratios(df):
    return rounded(rounded(df, "odds_ratio_per_sd", "ci_low", "ci_high", digits=5), "p_bootstrap")


@query("hazard_odds_ratios", "H06 H07", f"{FITTED} {RATIO_SQL}")
def _(spark, sf):
    return ratios(hz.odds_ratios(hazard_rows(spark, sf), MODELS, ["log_age"], "season", REPS))


@query("hazard_family_scan", "H08 B08", f"""{FITTED}, od AS ({RATIO_SQL}), rf AS (SELECT *, p_bootstrap * count(*) OVER (PARTITION BY family) / (rank() OVER (PARTITION BY family ORDER BY p_bootstrap) + count(*) OVER (PARTITION BY family, p_bootstrap) - 1) AS f,
p_bootstrap * count(*) OVER () / (rank() OVER (ORDER BY p_bootstrap) + count(*) OVER (PARTITION BY p_bootstrap) - 1) AS g FROM od)
SELECT * EXCLUDE (f, g), {R('least(1.0, min(f) OVER (PARTITION BY family ORDER BY p_bootstrap DESC))', 5)} AS q_family, {R('least(1.0, min(g) OVER (ORDER BY p_bootstrap DESC))', 5)} AS q_all FROM rf""")
def _(spark, sf):
    return rounded(ratios(hz.family_scan(hazard_rows(spark, sf), MODELS, ["log_age"], "season", REPS)), "q_family", "q_all", digits=5)


@query("hazard_leave_one_out", "H09", f"""WITH RECURSIVE {HAZARD_SQL}, pl AS (SELECT o.i AS rep, x.i, 1.0 AS w FROM bl o JOIN bl x ON x.i <> o.i UNION ALL SELECT -1, i, 1.0 FROM bl), {DESIGN_SQL}, {newton('family, predictor, rep')},
f AS (SELECT *, max(b1) FILTER (WHERE rep = -1) OVER (PARTITION BY family, predictor) AS o FROM fit)
SELECT family, predictor, {R('exp(max(o))', 5)} AS odds_ratio, {R('exp(min(b1))', 5)} AS loo_low, {R('exp(max(b1))', 5)} AS loo_high, {R('avg(CASE WHEN sign(b1) = sign(o) THEN 1.0 ELSE 0.0 END)')} AS sign_stability, count(*) AS block_count FROM f WHERE rep >= 0 GROUP BY 1, 2""")
def _(spark, sf):
    got = hz.leave_block_out_ratios(hazard_rows(spark, sf), MODELS, ["log_age"], "season")
    return rounded(rounded(got, "odds_ratio", "loo_low", "loo_high", digits=5), "sign_stability")


def standardised(columns: list[str], keys: str) -> str:
    """CTEs zs (z-scores of ``columns`` in cm by ``keys``) and bl (numbered blocks of hz)."""
    return f"""st AS (SELECT {keys}, {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in columns)} FROM cm GROUP BY {keys}),
zs AS (SELECT {keys}, season, t::DOUBLE AS t, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in columns)} FROM cm JOIN st USING ({keys})),
bl AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS i FROM (SELECT DISTINCT season AS b FROM hz))"""


HZ_SQL = HAZARD_SQL.split(",\nlo AS")[0]
MULTI_SQL = f"""WITH RECURSIVE {HZ_SQL}, cm AS (SELECT 1 AS model, season, t, x, y, a FROM hz WHERE x IS NOT NULL AND y IS NOT NULL AND a IS NOT NULL), {standardised(['x', 'y', 'a'], 'model')}, {PLAN_SQL},
d AS (SELECT model, rep, x, y, a, t, w FROM zs JOIN bl ON season = b JOIN pl USING (i)), {newton_many('model, rep', ['x', 'y', 'a'])},
lf AS (SELECT rep, conv, unnest([{{'p': 'x', 'b': b1}}, {{'p': 'y', 'b': b2}}, {{'p': 'log_age', 'b': b3}}], recursive := true) FROM fit),
co AS (SELECT corr(x, y) AS xy, corr(x, a) AS xa, corr(y, a) AS ya FROM cm), de AS (SELECT *, 1 + 2 * xy * xa * ya - xy * xy - xa * xa - ya * ya AS det FROM co),
vi AS (SELECT unnest([{{'p': 'x', 'vif': (1 - ya * ya) / det}}, {{'p': 'y', 'vif': (1 - xa * xa) / det}}, {{'p': 'log_age', 'vif': (1 - xy * xy) / det}}], recursive := true) FROM de),
g AS (SELECT p, max(b) FILTER (WHERE rep = -1) AS o, quantile_cont(b, 0.025) FILTER (WHERE rep >= 0) AS l, quantile_cont(b, 0.975) FILTER (WHERE rep >= 0) AS h, count(*) FILTER (WHERE rep >= 0) AS n,
  count(*) FILTER (WHERE rep >= 0 AND b <= 0) AS le, count(*) FILTER (WHERE rep >= 0 AND b >= 0) AS ge FROM lf GROUP BY 1)
SELECT p AS predictor, {R('exp(o)', 5)} AS odds_ratio_per_sd, {R('exp(l)', 5)} AS ci_low, {R('exp(h)', 5)} AS ci_high, {R('least(1.0, 2.0 * (least(le, ge) + 1) / (n + 1))')} AS p_bootstrap, n AS n_boot_valid, {R('vif', 5)} AS vif FROM g JOIN vi USING (p)"""


@query("hazard_multivariable", "H10", MULTI_SQL)
def _(spark, sf):
    return rounded(ratios(hz.multivariable(hazard_rows(spark, sf), ["x", "y", "log_age"], "season", REPS)), "vif", digits=5)


@query("variance_inflation", "H10", f"""WITH {SC_SQL}, c AS (SELECT corr(x, y) AS r FROM rs0 JOIN cov USING (date)) SELECT p.predictor, {R('1 / (1 - r * r)')} AS vif FROM c, (SELECT unnest(['x', 'y']) AS predictor) p""")
def _(spark, sf):
    return rounded(hz.variance_inflation(risk(spark, sf), ["x", "y"]), "vif")


def predictions(spark, sf, candidates=("x", "y", "xy"), **kw):
    r = hazard_rows(spark, sf)
    return stage_table(vl.nested_predictions(r, list(candidates), ["log_age"], "season", F.concat_ws("|", "event_id", "event_age"), keep=["season"], **kw).filter("p_full IS NOT NULL"))


def validated(p):
    """Scores with their block intervals; a replicate draws the seasons that were predicted."""
    out = hz.scores(p, ["model"]).join(vl.score_intervals(p, ["model"], "season", REPS), "model")
    return rounded(out, *[c for c in out.columns if c not in ("model", "n")], digits=5)


def validation_sql(folds: str) -> str:
    """Scores of fixed predictors x and y beside log age, out of block; ``folds`` has (model, fold, season, trains) for every season of a fold."""
    eta = lambda b: f"1 / (1 + exp(-({b})))"
    return f"""WITH RECURSIVE {HZ_SQL}, rw AS (SELECT row_number() OVER (ORDER BY season, a, t, x, y) AS id, season, t::DOUBLE AS t, a, x, y FROM hz WHERE a IS NOT NULL AND t IS NOT NULL),
se AS (SELECT DISTINCT season FROM rw), fo AS ({folds}), cm AS (SELECT 1 AS one, * FROM rw WHERE x IS NOT NULL AND y IS NOT NULL),
st AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_samp(y) AS sy, avg(a) AS ma, stddev_samp(a) AS sa FROM cm), zs AS (SELECT id, season, t, (x - mx) / sx AS v, (y - my) / sy AS c, (a - ma) / sa AS a FROM rw, st),
d AS (SELECT model, fold, 'full' AS kind, v, c, a, t, 1.0::DOUBLE AS w FROM zs JOIN fo USING (season) WHERE trains AND v IS NOT NULL AND c IS NOT NULL UNION ALL SELECT model, fold, 'less', 0.0, 0.0, a, t, 1.0 FROM zs JOIN fo USING (season) WHERE trains),
{newton_many('model, fold, kind', ['v', 'c', 'a'])},
mn AS (SELECT model, fold, avg(v) FILTER (WHERE kind = 'full') AS mv, avg(c) FILTER (WHERE kind = 'full') AS mc, avg(t) FILTER (WHERE kind = 'less') AS pc FROM d GROUP BY 1, 2),
pr AS MATERIALIZED (SELECT model, season, id, t AS y, pc, {eta('l.b0 + l.b3 * a')} AS pa, {eta('f.b0 + f.b1 * coalesce(v, mv) + f.b2 * coalesce(c, mc) + f.b3 * a')} AS pf FROM zs JOIN fo USING (season) JOIN mn USING (model, fold)
  JOIN fit f USING (model, fold) JOIN fit l USING (model, fold) WHERE NOT trains AND f.kind = 'full' AND l.kind = 'less'),
rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY pf) + (count(*) OVER (PARTITION BY model, pf) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY model ORDER BY pa) + (count(*) OVER (PARTITION BY model, pa) - 1) / 2.0 AS ra FROM pr),
g AS (SELECT model, count(*) AS n, sum(y) AS p, sum(y * rf) AS sf, sum(y * ra) AS sa, avg(pow(y - pf, 2)) AS bf, avg(pow(y - pa, 2)) AS ba, avg(pow(y - pc, 2)) AS bc, sum(y) / sum(pf) AS oe FROM rk GROUP BY 1),
ps AS (SELECT model, season, row_number() OVER (PARTITION BY model ORDER BY season) - 1 AS i, count(*) OVER (PARTITION BY model) AS k FROM (SELECT DISTINCT model, season FROM pr)),
dw AS MATERIALIZED (SELECT model, season, r, count(*)::DOUBLE AS w FROM (SELECT model, r, CAST('0x' || substr(md5('42:' || CAST(r AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 8) AS BIGINT) % k AS i FROM (SELECT DISTINCT model, k FROM ps) q, unnest(range({REPS})) u(r), unnest(range(k)) s(j)) JOIN ps USING (model, i) GROUP BY 1, 2, 3),
oc AS MATERIALIZED (SELECT a.model, a.season AS sa, b.season AS sb, sum(CASE WHEN a.pf > b.pf THEN 1 WHEN a.pf = b.pf THEN 0.5 ELSE 0 END - CASE WHEN a.pa > b.pa THEN 1 WHEN a.pa = b.pa THEN 0.5 ELSE 0 END)::DOUBLE AS m FROM pr a JOIN pr b ON a.model = b.model AND a.y = 1 AND b.y = 0 GROUP BY 1, 2, 3),
bs AS (SELECT model, season, sum(y) AS p, count(*) AS n, sum(pow(y - pf, 2) - pow(y - pa, 2)) AS e FROM pr GROUP BY 1, 2),
dr AS (SELECT model, r, sum(w * p) AS p, sum(w * n) AS n, sum(w * e) AS e FROM dw JOIN bs USING (model, season) GROUP BY 1, 2),
da AS (SELECT x.model, x.r, sum(x.w * z.w * m) AS m FROM dw x JOIN oc ON x.model = oc.model AND x.season = sa JOIN dw z ON z.model = x.model AND z.r = x.r AND z.season = sb GROUP BY 1, 2),
iv AS (SELECT model, quantile_cont(e / n, 0.025) AS bl, quantile_cont(e / n, 0.975) AS bh, quantile_cont(coalesce(m, 0) / (p * (n - p)), 0.025) FILTER (WHERE p > 0 AND p < n) AS al, quantile_cont(coalesce(m, 0) / (p * (n - p)), 0.975) FILTER (WHERE p > 0 AND p < n) AS ah FROM dr LEFT JOIN da USING (model, r) GROUP BY 1),
d2 AS (SELECT model, ln(pf / (1 - pf)) AS v, y AS t, 1.0::DOUBLE AS w FROM pr),
{newton_many('model', ['v'], tag='2')}
SELECT model, n, {R('ba', 5)} AS brier_adjust, {R('bf', 5)} AS brier_full, {R('bc', 5)} AS brier_climatology, {R('oe', 5)} AS observed_over_expected, {R('1 - bf / bc', 5)} AS skill, {R('(sa - p * (p + 1) / 2) / (p * (n - p))', 5)} AS auc_adjust,
  {R('(sf - p * (p + 1) / 2) / (p * (n - p))', 5)} AS auc_full, {R('(sf - sa) / (p * (n - p))', 5)} AS auc_difference, {R('al', 5)} AS auc_diff_ci_low, {R('ah', 5)} AS auc_diff_ci_high, {R('bl', 5)} AS brier_diff_ci_low, {R('bh', 5)} AS brier_diff_ci_high, {R('b1', 5)} AS calibration_slope
FROM g JOIN iv USING (model) JOIN fit2 USING (model)"""


@query("cross_validated_scores", "H11 H14", validation_sql("SELECT 'all' AS model, f.season AS fold, s.season, s.season <> f.season AS trains FROM se f, se s"))
def _(spark, sf):
    # xy is a combination of x and y: the SQL fits the two alone
    return validated(predictions(spark, sf, select=False).withColumn("model", F.lit("all")))


@query("split_period_validation", "H13 H14", validation_sql("SELECT 'early' AS model, 0 AS fold, season, season < 1998 AS trains FROM se UNION ALL SELECT 'late', 0, season, season >= 1998 FROM se"))
def _(spark, sf):
    early, late = ((F.col("season") < 1998, "early"), (F.col("season") >= 1998, "late"))
    one, two = (validated(predictions(spark, sf, ("x", "y"), select=False, split=c).withColumn("model", F.lit(m))) for c, m in (early, late))
    return one.unionByName(two)


@query("nested_selection", "H12 H13")
def _(spark, sf):
    return predictions(spark, sf, excluded=["xy"]).groupBy("fold", F.concat_ws(",", "chosen").alias("chosen")).agg(F.count(F.lit(1)).alias("rows"))


@query("nested_selection_frequency", "H13")
def _(spark, sf):
    return vl.selection_frequency(predictions(spark, sf), ["x", "y", "xy"])


@query("split_period_scores", "H13 H14")
def _(spark, sf):
    return validated(predictions(spark, sf, split=F.col("season") < 1998).withColumn("model", F.lit("split")))


SCORE_SQL = """t AS (SELECT o_orderpriority AS model, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS y, o_totalprice / 510000 AS pf, (o_custkey % 97) / 97.0::DOUBLE AS pa, 0.3::DOUBLE AS pc FROM orders),
r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY pf) + (count(*) OVER (PARTITION BY model, pf) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY model ORDER BY pa) + (count(*) OVER (PARTITION BY model, pa) - 1) / 2.0 AS ra FROM t),
g AS (SELECT model, count(*) AS n, sum(y) AS p, sum(y * rf) AS sf, sum(y * ra) AS sa, avg(pow(y - pf, 2)) AS bf, avg(pow(y - pa, 2)) AS ba, avg(pow(y - pc, 2)) AS bc, sum(y) / sum(pf) AS oe FROM r GROUP BY 1)"""


@query("prediction_scores", "H11 H14", f"""WITH {SCORE_SQL} SELECT model, n, {R('ba')} AS brier_adjust, {R('bf')} AS brier_full, {R('bc')} AS brier_climatology, {R('oe')} AS observed_over_expected, {R('1 - bf / bc')} AS skill, {R('(sa - p * (p + 1) / 2) / (p * (n - p))')} AS auc_adjust, {R('(sf - p * (p + 1) / 2) / (p * (n - p))')} AS auc_full, {R('(sf - sa) / (p * (n - p))')} AS auc_difference FROM g""")
def _(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_orderstatus") == "F").cast("double").alias("y"), (F.col("o_totalprice") / 510000).alias("p_full"),
                                          ((F.col("o_custkey") % 97) / F.lit(97.0)).alias("p_adjust"), F.lit(0.3).alias("p_climatology"))
    s = hz.scores(t, ["model"])
    return rounded(s, "brier_adjust", "brier_full", "brier_climatology", "observed_over_expected", "skill", "auc_adjust", "auc_full", "auc_difference")


CONTROL_SQL = f"""WITH RECURSIVE {HZ_SQL}, cm AS (SELECT 'controlled' AS family, 'x' AS predictor, season, t, x AS v, a, y AS c FROM hz WHERE x IS NOT NULL AND y IS NOT NULL AND a IS NOT NULL),
{standardised(['v', 'a', 'c'], 'family, predictor')}, {PLAN_SQL}, d AS (SELECT family, predictor, rep, v, a, c, t, w FROM zs JOIN bl ON season = b JOIN pl USING (i)), {newton_many('family, predictor, rep', ['v', 'a', 'c'])} {RATIO_SQL}"""


@query("hazard_with_controls", "H15", CONTROL_SQL)
def _(spark, sf):
    return ratios(hz.odds_ratios(hazard_rows(spark, sf), [("controlled", "x")], ["log_age", "y"], "season", REPS))


CENSORED = "CASE WHEN month(end_date) = 2 AND month(CAST(end_date + 1 AS DATE)) <> 2 AND r.date = end_date"
VARIANT_SQL = f"""WITH RECURSIVE {SC_SQL}, ln AS (SELECT regr_slope(x, date_diff('day', DATE '1970-01-01', date)) AS bx, regr_intercept(x, date_diff('day', DATE '1970-01-01', date)) AS ax, regr_slope(y, date_diff('day', DATE '1970-01-01', date)) AS by_, regr_intercept(y, date_diff('day', DATE '1970-01-01', date)) AS ay FROM cov),
dt AS (SELECT date, x - (ax + bx * date_diff('day', DATE '1970-01-01', date)) AS x, y - (ay + by_ * date_diff('day', DATE '1970-01-01', date)) AS y FROM cov, ln),
fl AS (SELECT r.*, {CENSORED} THEN 0 ELSE terminates END AS cens, {CENSORED} THEN 1 ELSE 0 END AS fin FROM rs0 r),
hz AS (SELECT 'primary' AS variant, season, log_age AS a, cens AS t, x, y FROM fl LEFT JOIN cov USING (date) UNION ALL SELECT 'uncensored', season, log_age, terminates, x, y FROM fl LEFT JOIN cov USING (date)
 UNION ALL SELECT 'drop_final', season, log_age, terminates, x, y FROM fl LEFT JOIN cov USING (date) WHERE fin = 0 UNION ALL SELECT 'lead_1', season, log_age, cens, c.x, c.y FROM fl LEFT JOIN cov c ON c.date = fl.date - 1
 UNION ALL SELECT 'detrended', season, log_age, cens, x, y FROM fl LEFT JOIN dt USING (date)),
cm AS (SELECT * FROM (SELECT variant, 'local' AS family, 'x' AS predictor, season, t, x AS v, a FROM hz UNION ALL SELECT variant, 'local', 'y', season, t, y, a FROM hz) WHERE v IS NOT NULL AND a IS NOT NULL),
{standardised(['v', 'a'], 'variant, family, predictor')}, {PLAN_SQL}, d AS (SELECT variant, family, predictor, rep, v, a, t, w FROM zs JOIN bl ON season = b JOIN pl USING (i)), {newton('variant, family, predictor, rep')},
od AS ({RATIO_SQL.replace('SELECT family, predictor,', 'SELECT variant, family, predictor,').replace('GROUP BY 1, 2', 'GROUP BY 1, 2, 3').replace('USING (family, predictor)', 'USING (variant, family, predictor)')}),
ro AS (SELECT variant, family, predictor, sign(max(b1)) AS way FROM fit WHERE rep = -1 GROUP BY 1, 2, 3)
SELECT od.*, x.way = y.way AS same_direction FROM od JOIN ro x USING (variant, family, predictor) JOIN ro y ON y.variant = 'primary' AND y.family = od.family AND y.predictor = od.predictor"""


@query("hazard_variants", "H16 H02 H03 K15", VARIANT_SQL)
def _(spark, sf):
    cat = short_events(spark, sf)
    base = risk(spark, sf, cat=cat)
    det = k.detrend(cov(spark, sf), [], "date", ["x", "y"]).select("date", F.col("x_detrended").alias("x"), F.col("y_detrended").alias("y"))
    parts = {"primary": hz.censor_season_end(base), "uncensored": base, "drop_final": hz.censor_season_end(base, "drop_final"),
             "lead_1": hz.censor_season_end(risk(spark, sf, 1, cat)), "detrended": hz.censor_season_end(hz.risk_set(cat, det, ["x", "y"], [], 2))}
    u = None
    for name, p in parts.items():
        p = p.withColumn("variant", F.lit(name))
        u = p if u is None else u.unionByName(p)
    o = hz.odds_ratios(cut_lineage(u), [("local", "x"), ("local", "y")], ["log_age"], "season", REPS, keys=["variant"])
    return ratios(hz.direction_agreement(cut_lineage(o), "primary"))


TRAILING_SQL = f"""WITH RECURSIVE {SC_SQL}, tr AS (SELECT date, CASE WHEN count(x) OVER w = 20 THEN avg(x) OVER w END AS x20 FROM cov WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 20 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
hz AS (SELECT season, log_age AS a, {CENSORED} THEN 0 ELSE terminates END AS t, x20 FROM rs0 r LEFT JOIN tr USING (date)), cm AS (SELECT 'trailing' AS family, 'x20' AS predictor, season, t, x20 AS v, a FROM hz WHERE x20 IS NOT NULL AND a IS NOT NULL),
{standardised(['v', 'a'], 'family, predictor')}, {PLAN_SQL}, {DESIGN_SQL}, {newton('family, predictor, rep')} {RATIO_SQL}"""


@query("trailing_window_hazard", "H17 K13", TRAILING_SQL)
def _(spark, sf):
    c = k.trailing_mean(cov(spark, sf).select("date", "x"), [], "date", "x", 20, "x20", until=1).select("date", "x20")
    r = hz.censor_season_end(hz.risk_set(short_events(spark, sf), c, ["x20"], [], 2))
    return ratios(hz.odds_ratios(cut_lineage(r), [("trailing", "x20")], ["log_age"], "season", REPS))


def _q(p: str) -> str:
    return f"least(1.0, min({p} * n / k) OVER (PARTITION BY win ORDER BY {p} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


DRIVER_SQL = f"""WITH {AL_SQL}, wn("window", a, f, t) AS (VALUES ('pre', 'onset', -7, -1), ('first3', 'onset', 0, 2)),
wm AS (SELECT "window" AS win, event_id, season, duration_group AS g, duration_days::DOUBLE AS d, avg(x) AS x, avg(y) AS y FROM ar JOIN wn ON a = align AND lag BETWEEN f AND t GROUP BY 1, 2, 3, 4, 5),
ev AS MATERIALIZED (SELECT * FROM (SELECT win, 'x' AS variable, season, g, d, x AS value FROM wm UNION ALL SELECT win, 'y', season, g, d, y FROM wm) WHERE value IS NOT NULL), {PLANS_SQL}, {weighted_spearman('win, variable', ['d', 'value'], 'ev')},
bs AS (SELECT win, variable, i, coalesce(sum(value) FILTER (WHERE g <> 'short'), 0) AS sa, count(value) FILTER (WHERE g <> 'short') AS na, coalesce(sum(value) FILTER (WHERE g = 'short'), 0) AS sb, count(value) FILTER (WHERE g = 'short') AS nb FROM ev JOIN bl ON season = b GROUP BY 1, 2, 3),
df AS (SELECT win, variable, rep, {DIFF_DRAW} AS d FROM bs JOIN pl USING (i) GROUP BY 1, 2, 3),
dp AS (SELECT win, variable, max(d) FILTER (WHERE rep = -1) AS difference, least(1.0, 2.0 * (least(count(*) FILTER (WHERE rep >= 0 AND round(d, 12) <= 0), count(*) FILTER (WHERE rep >= 0 AND round(d, 12) >= 0)) + 1) / (count(d) FILTER (WHERE rep >= 0) + 1)) AS diff_p FROM df GROUP BY 1, 2),
rp AS (SELECT win, variable, {RANK_OUT} FROM rho GROUP BY 1, 2), j AS (SELECT dp.*, observed, ci_low, ci_high, p_value AS rho_p FROM dp JOIN rp USING (win, variable)),
qd AS (SELECT *, {_q('diff_p')} AS diff_q FROM (SELECT *, count(*) OVER (PARTITION BY win) AS n, rank() OVER (PARTITION BY win ORDER BY diff_p) + count(*) OVER (PARTITION BY win, diff_p) - 1 AS k FROM j)),
qr AS (SELECT * EXCLUDE (n, k), {_q('rho_p')} AS rho_q FROM (SELECT * EXCLUDE (n, k), count(*) OVER (PARTITION BY win) AS n, rank() OVER (PARTITION BY win ORDER BY rho_p) + count(*) OVER (PARTITION BY win, rho_p) - 1 AS k FROM qd))
SELECT win AS "window", variable, {R('difference', 5)} AS difference, {R('diff_p')} AS diff_p, observed AS rho, ci_low, ci_high, rho_p, {R('diff_q')} AS diff_q, {R('rho_q')} AS rho_q FROM qr"""


@query("duration_driver_tests", "H18 A03 B08 B22", DRIVER_SQL)
def _(spark, sf):
    w = cut_lineage(al.window_means(aligned(spark, sf), {"pre": ("onset", -7, -1), "first3": ("onset", 0, 2)}, ["x", "y"], KEEP))
    long = al.long_form(w, ["window", "season", "duration_group", "duration_days"], ["x", "y"])
    short = F.col("duration_group") == "short"
    d = rs.bootstrap_difference(long, ["window", "variable"], "value", "season", ~short, short, REPS).select("window", "variable", F.col("observed").alias("difference"), F.col("p_value").alias("diff_p"))
    s = rt.spearman_interval(long.withColumn("d", F.col("duration_days").cast("double")), ["window", "variable"], ["d", "value"], "season")
    j = cut_lineage(d.join(s.select("window", "variable", F.col("observed").alias("rho"), "ci_low", "ci_high", F.col("p_value").alias("rho_p")), ["window", "variable"]))
    q = rs.benjamini_hochberg(rs.benjamini_hochberg(j, ["window"], "diff_p", "diff_q"), ["window"], "rho_p", "rho_q")
    return rounded(rounded(q, "difference", "rho", "ci_low", "ci_high", digits=5), "diff_p", "rho_p", "diff_q", "rho_q")
