"""Nested validation over rows beside fold-by-fold fits in NumPy."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hiemal.operators import hazard as hz, resample as rs, validation as vl

NAMES = ["u", "v", "uu", "diag", "flat"]


def table(n=900, seed=11):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(3, 2, n), rng.normal(0, 1, n)
    d = pd.DataFrame({"id": np.arange(n), "season": rng.choice([1990, 1991, 1992, 1993, 1994, 1995], n, p=[.35, .2, .15, .1, .1, .1]), "age": rng.integers(3, 9, n).astype(float),
                      "u": u, "v": v, "uu": u + rng.normal(0, .3, n), "flat": 1.0})
    eta = .5 * (u - 3) - .4 * v - .2 * d["age"] + .5
    d["terminates"] = (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(float)
    d["diag"] = d["terminates"] + rng.normal(0, 1, n)
    d.loc[rng.random(n) < .1, "u"] = np.nan
    d.loc[rng.random(n) < .2, "v"] = np.nan
    d.loc[d["season"] != 1990, "flat"] = 2.0  # no spread without 1990
    return d


def fit(x, y):
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    sd = np.where(sd > 0, sd, 1)
    b = hz.logistic_fits((x - mean) / sd, y, np.ones((1, len(y))))[0][0]
    return mean, sd, b


def likelihood(x, y):
    mean, sd, b = fit(x, y)
    eta = b[0] + (x - mean) / sd @ b[1:]
    return (y * eta - np.logaddexp(0, eta)).sum()


def choose(tr, names, excluded):
    p = {}
    for c in names:
        d = tr.dropna(subset=[c])
        if len(d) < 30 or d[c].std() == 0:
            continue
        y = d["terminates"].to_numpy()
        p[c] = math.erfc(math.sqrt(max(likelihood(d[[c, "age"]].to_numpy(), y) - likelihood(d[["age"]].to_numpy(), y), 0)))
    order, chosen = sorted(p, key=p.get), []
    q = {c: min(p[x] * len(order) / (order.index(x) + 1) for x in order[i:]) for i, c in enumerate(order)}
    for c in order:
        if q[c] < .05 and c not in excluded and not any(abs(tr[[c, s]].corr().iloc[0, 1]) > .8 for s in chosen):
            chosen.append(c)
    return chosen


def predict(tr, te, columns):
    d = tr.dropna(subset=columns)
    mean, sd, b = fit(d[columns].to_numpy(), d["terminates"].to_numpy())
    return 1 / (1 + np.exp(-(b[0] + np.nan_to_num((te[columns].to_numpy() - mean) / sd) @ b[1:])))


def by_hand(d, folds, excluded, fixed=None):
    out = {}
    for f, (tr, te) in folds.items():
        chosen = choose(tr, NAMES, excluded) if fixed is None else fixed
        for i, a, p in zip(te["id"], predict(tr, te, ["age"]), predict(tr, te, [*chosen, "age"])):
            out[i] = (f, a, p, tr["terminates"].mean(), chosen)
    return out


def stored(spark, d):
    odd = pd.DataFrame({"id": [9001, 9002, 9003], "season": [None, 1991, 1992], "age": [4.0, None, 4.0], "terminates": [1.0, 1.0, None]})  # take no part
    s = pd.concat([d, odd]).astype(object)
    return spark.createDataFrame(s.where(s.notna(), None)[["id", "season", "age", "terminates", *NAMES]], "id long, season int, age double, terminates double, " + ", ".join(f"{c} double" for c in NAMES)).repartition(5)


def agree(got, want):
    assert {int(r.row_id) for r in got} == set(want)
    for r in got:
        f, a, p, rate, chosen = want[int(r.row_id)]
        assert (r.fold, r.chosen) == (f, chosen) and r.y in (0, 1)
        assert np.allclose([r.p_adjust, r.p_full, r.p_climatology], [a, p, rate], atol=1e-7)


@pytest.mark.parametrize("part_rows", [8192, 150])
def test_nested_predictions_as_fold_by_fold(spark, part_rows):
    d = table()
    folds = {int(w): (d[d["season"] != w], d[d["season"] == w]) for w in sorted(d["season"].unique())}
    got = vl.nested_predictions(stored(spark, d), NAMES, ["age"], "season", F.col("id"), excluded=["diag"], part_rows=part_rows).collect()
    want = by_hand(d, folds, ["diag"])
    assert {tuple(v[4]) for v in want.values()} & {("u", "v"), ("v", "u"), ("uu", "v")}
    agree(got, want)


def test_split_and_fixed_predictors(spark):
    d = table(400, 3)
    early = d["season"] <= 1991
    s = stored(spark, d)
    got = vl.nested_predictions(s, NAMES, ["age"], "season", F.col("id"), split=F.col("season") <= 1991, keep=["season"]).collect()
    agree(got, by_hand(d, {0: (d[early], d[~early])}, []))
    assert all(r.season > 1991 for r in got)
    got = vl.nested_predictions(s, ["u", "v"], ["age"], "season", F.col("id"), select=False, split=F.col("season") > 1991).collect()
    agree(got, by_hand(d, {0: (d[~early], d[early])}, [], ["u", "v"]))
    none = vl.nested_predictions(s, ["u", "v"], ["age"], "season", F.col("id"), select=False, missing="null").collect()
    gaps = set(d.loc[d[["u", "v"]].isna().any(axis=1), "id"])
    assert {int(r.row_id) for r in none if r.p_full is None} == gaps and all(r.p_adjust is not None for r in none)


def test_one_class_in_training_and_no_rows(spark):
    d = pd.DataFrame({"id": range(40), "season": [1, 2] * 20, "age": np.arange(40.0) % 7, "u": np.sin(np.arange(40)), "terminates": 0.0})
    d.loc[[1, 3, 7], "terminates"] = 1.0  # all in season 2: its fold trains on one class
    s = spark.createDataFrame(d)
    got = {r.row_id: r for r in vl.nested_predictions(s, ["u"], ["age"], "season", F.col("id")).collect()}
    assert len(got) == 40 and got["1"].p_full is None and got["1"].p_climatology == 0 and got["0"].p_full is not None
    assert vl.nested_predictions(s.limit(0), ["u"], ["age"], "season", F.col("id"), select=False).count() == 0


def test_score_intervals_as_weighted_scores(spark):
    rng = np.random.default_rng(4)
    n = 700
    d = pd.DataFrame({"m": np.where(rng.random(n) < .5, "p", "q"), "b": rng.integers(0, 6, n), "p_adjust": np.round(rng.random(n), 1) * .9 + .05, "p_full": np.round(rng.random(n), 2) * .9 + .05})
    d["y"] = (rng.random(n) < d["p_full"]).astype(float)
    got = {r.m: r for r in vl.score_intervals(spark.createDataFrame(d).repartition(4), ["m"], "b", 60, 5, part_rows=100).collect()}
    plan = rs.plan_matrix(6, 60, 5)
    for m, g in d.groupby("m"):
        y, a, f = (g[c].to_numpy() for c in ("y", "p_adjust", "p_full"))
        da, db = [], []
        for w in plan[:, g["b"]].astype(float):
            area = [(w[y > 0][:, None] * w[y == 0] * ((p[y > 0][:, None] > p[y == 0]) + .5 * (p[y > 0][:, None] == p[y == 0]))).sum() / (w[y > 0].sum() * w[y == 0].sum()) for p in (f, a)]
            da.append(area[0] - area[1])
            db.append((w * ((y - f) ** 2 - (y - a) ** 2)).sum() / w.sum())
        slope = hz.logistic_fits(np.log(f / (1 - f))[:, None], y, np.ones((1, len(y))))[0][0][1]
        want = [*np.percentile(da, [2.5, 97.5]), *np.percentile(db, [2.5, 97.5]), slope]
        assert np.allclose([got[m][c] for c in ("auc_diff_ci_low", "auc_diff_ci_high", "brier_diff_ci_low", "brier_diff_ci_high", "calibration_slope")], want, atol=1e-8)
