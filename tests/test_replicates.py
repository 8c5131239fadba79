"""Replicated fits of one part, of many parts, and row by row."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hiemal.operators import hazard as hz, replicates as rp, resample as rs


def rows(n=500, seed=3, whole=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(2, 3, size=(n, 2))
    if whole:
        x = np.round(x)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 * x[:, 0] - 0.4 * x[:, 1] - 0.5)))).astype(float)
    return pd.DataFrame({"k": np.where(rng.random(n) < .4, "p", "q"), "s": rng.integers(1990, 1999, n), "terminates": y, "u": x[:, 0], "v": x[:, 1]})


def direct(d, plan, blocks):
    x = d[["u", "v"]].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    w = np.concatenate([np.ones((1, len(d))), plan[:, np.searchsorted(blocks, d["s"])]])
    return hz.logistic_fits(z, d["terminates"].to_numpy(), w)


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("part_rows,chunk", [(8192, 1000), (60, 7)])
def test_replicates_as_row_by_row_fits(spark, whole, part_rows, chunk):
    d = rows(whole=whole)
    odd = pd.DataFrame({"k": ["p", "p", "q"], "s": [1991, None, 1992], "terminates": [None, 1.0, 1.0], "u": [1.0, 1.0, None], "v": [1.0, 1.0, 1.0]})
    s = spark.createDataFrame(pd.concat([d, odd]).astype(object).where(lambda x: x.notna(), None), "k string, s int, terminates double, u double, v double").repartition(5)
    got, facts = rp.replicate_fits(s, ["k"], ["u", "v"], "s", 25, 7, part_rows=part_rows, chunk=chunk)
    got = {(r.k, r.rep): r for r in got.collect()}
    plan, blocks = rs.plan_matrix(9, 25, 7), np.arange(1990, 1999)
    for k, g in d.groupby("k"):
        coef, ok = direct(g, plan, blocks)
        assert ok.all() and all(got[k, r].converged for r in range(-1, 25))
        assert np.allclose([got[k, r].coef for r in range(-1, 25)], coef, atol=1e-8)
    assert {(r.k, r.n_rows, r.n_terminations) for r in facts.collect()} == {(k, len(g), int(g["terminates"].sum())) for k, g in d.groupby("k")}
    left, _ = rp.replicate_fits(s, ["k"], ["u", "v"], "s", None, None, part_rows=part_rows, chunk=chunk)
    left = {(r.k, r.rep): r.coef for r in left.collect()}
    g = d[d["k"] == "p"]
    assert np.allclose([left["p", r] for r in range(-1, 9)], direct(g, 1 - np.eye(9), blocks)[0], atol=1e-8)


def test_one_class_and_separation_over_parts(spark):
    d = pd.DataFrame({"k": "a", "s": np.arange(60) % 3, "terminates": (np.arange(60) % 3 == 2).astype(float), "u": np.arange(60.0), "v": np.cos(np.arange(60))})
    d = pd.concat([d, d.assign(k="b", terminates=(d["u"] > 30).astype(float))])  # a: a block alone holds events; b: separated
    s = spark.createDataFrame(d)
    one, _ = rp.replicate_fits(s, ["k"], ["u", "v"], "s", 40, 1)
    many, _ = rp.replicate_fits(s, ["k"], ["u", "v"], "s", 40, 1, part_rows=9)
    one, many = ({(r.k, r.rep): r for r in x.collect()} for x in (one, many))
    assert len(one) == len(many) == 82
    assert {k for k, r in one.items() if r.coef is None} == {k for k, r in many.items() if r.coef is None} != set()
    assert not one["b", -1].converged and not many["b", -1].converged
    assert all(np.allclose(one[k].coef, many[k].coef, atol=1e-8) for k in one if k[0] == "a" and one[k].coef and one[k].converged)


def test_odds_ratios_beyond_one_part_equal_the_packed_fit(spark):
    d = rows(200_000, 5)
    d["s"] = d["s"] % 4
    s = spark.createDataFrame(d.assign(la=d["v"])).repartition(8)
    got = {r.predictor: r for r in hz.odds_ratios(s, [("f", "u")], ["la"], "s", 12, 3).collect()}["u"]
    coef, _ = direct(d, rs.plan_matrix(4, 12, 3), np.arange(4))
    assert (got.n_rows, got.n_terminations, got.n_boot_valid) == (len(d), int(d["terminates"].sum()), 12)
    assert abs(got.odds_ratio_per_sd - np.exp(coef[0, 1])) < 1e-8
    assert np.allclose([got.ci_low, got.ci_high], np.exp(np.percentile(coef[1:, 1], [2.5, 97.5])), atol=1e-8)


def test_plans_made_in_tasks_equal_the_matrix():
    assert (rp.weights_of(np.arange(-1, 30), 6, 9) == np.concatenate([np.ones((1, 6)), rs.plan_matrix(6, 30, 9)])).all()
    assert (rp.weights_of(np.array([4, 7]), 6, 9) == rs.plan_matrix(6, 30, 9)[[4, 7]]).all()
    assert [rp.replicates_of(c, 5, 2).tolist() for c in range(3)] == [[-1, 0, 1], [2, 3], [4]]


def test_random_sign_flips_agree_with_all_patterns(spark):
    """Beyond the exact limit random patterns stand for all of them; here both can be had."""
    rng = np.random.default_rng(8)
    rows = [(k, b, float(v)) for k, mean in (("a", 0.1), ("b", 0.4), ("c", 1.0)) for b, v in enumerate(rng.normal(mean, 1, 28))]
    df = spark.createDataFrame(rows, "k string, s int, d double").repartition(3)
    many = {r.k: r for r in rs.sign_flip(df, ["k"], "s", "d").collect()}
    every = {r.k: r for r in rs.sign_flip(df, ["k"], "s", "d", exact_up_to=28).collect()}
    for k in "abc":
        p, n = every[k].p_value, 200_000
        assert many[k].block_count == 28 and many[k].p_value != p and many[k].p_value >= 1 / (n + 1)
        assert abs(many[k].p_value - p) < 5 * (p * (1 - p) / n) ** 0.5 + 2 / n


def test_plan_tiles_are_the_plan():
    for method in ("hash", "numpy"):
        assert (np.concatenate(rs.plan_tiles(7, 25, 3, method, 10)) == rs.plan_matrix(7, 25, 3, method)).all()
    assert rs.plan_tiles(0, 4, 3, "hash")[0].shape == (4, 0)
