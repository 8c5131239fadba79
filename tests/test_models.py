import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hiemal.operators import grid_kernels as gk, hazard as hz, rank_tests as rt, reconcile as rc, resample as rs


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.4 * x[:, 0] - 0.8 * x[:, 1] - 0.5)))).astype(float)
    return x, y, rng.integers(0, 9, n)


def test_score_equations_vanish():
    x, y, b = data()
    w = rs.plan_matrix(9, 50, 1)[:, b].astype(float)
    coef, conv = hz.logistic_fits(x, y, w)
    d = np.column_stack([np.ones(len(y)), x])
    assert conv.all() and np.abs((w * (y - 1 / (1 + np.exp(-coef @ d.T)))) @ d).max() < 1e-6


def test_one_class_is_undefined_and_separation_is_reported():
    x = np.arange(6.0)[:, None]
    y = np.array([0, 0, 0, 1, 1, 1.0])
    coef, conv = hz.logistic_fits(x, y, np.array([[1, 1, 1, 0, 0, 0.0], [1, 1, 1, 1, 1, 1.0]]), steps=20)
    assert np.isnan(coef[0]).all() and np.isfinite(coef[1]).all() and not conv[1]


def test_large_fits_agree_with_the_batched_fit(spark):
    x, y, b = data()
    s = spark.createDataFrame(pd.DataFrame({"x0": x[:, 0], "x1": x[:, 1], "terminates": y, "b": b})).repartition(4)
    want = hz.logistic_fits(x, y, np.ones((1, len(y))))[0][0]
    got = hz.fit_large(s, ["x0", "x1"])
    assert np.allclose([got["intercept"], got["x0"], got["x1"]], want, atol=1e-4)
    plan = rs.plan_matrix(9, 5, 1)
    many = hz.fit_replicates_large(s, ["x0", "x1"], "b", plan, list(range(9)))
    assert np.allclose(many, hz.logistic_fits(x, y, plan[:, b].astype(float))[0], atol=1e-6)


def test_auc(spark):
    x, y, _ = data()
    p = np.round(x[:, 1], 1)
    s = spark.createDataFrame(pd.DataFrame({"y": y, "p": p})).withColumn("k", F.lit(1))
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(hz.auc(s, ["k"], "y", "p").first()["auc"] - want) < 1e-12


def frame(spark, lat, lon, **fields):
    la, lo = np.meshgrid(lat, lon, indexing="ij")
    pdf = pd.DataFrame({"t": 1, "level": 300.0, "lat": la.ravel(), "lon": lo.ravel()} | {k: v.ravel() for k, v in fields.items()})
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "t int, level double, lat double, lon double, " + ", ".join(f"{k} double" for k in fields))


def test_smoothing_keeps_a_constant_and_masks_gaps(spark):
    a = np.full((12, 14), 3.0)
    a[4:6, 4:6] = np.nan
    lat, lon = np.arange(12.0), np.arange(14.0)
    out = gk.smooth(frame(spark, lat, lon, a=a).filter("a IS NOT NULL"), ["t"], "a").collect()
    assert len(out) == a.size and all(r.smoothed is None or abs(r.smoothed - 3) < 1e-12 for r in out)
    assert all(r.smoothed is None for r in gk.smooth(frame(spark, lat, lon, a=np.full(a.shape, np.nan)), ["t"], "a").collect())
    point = np.zeros(a.shape)
    point[5, 5] = 1.0
    got = {(r.lat, r.lon): r.smoothed for r in gk.smooth(frame(spark, lat, lon, a=point), ["t"], "a").collect()}
    w = gk.gaussian(1.0)
    assert abs(got[5, 5] - w[4] ** 2) < 1e-15 and abs(got[6, 3] - w[5] * w[2]) < 1e-15


def test_slope_is_exact_for_parabolas(spark):
    from pyspark.sql import Window
    x = np.array([0.0, 1.0, 2.5, 3.0, 7.0])
    s = spark.createDataFrame(pd.DataFrame({"x": x, "f": 2 * x ** 2 - 3 * x}))
    got = s.select("x", gk.slope(F.col("f"), F.col("x"), Window.orderBy("x")).alias("d")).collect()
    assert all(abs(r.d - (4 * r.x - 3)) < 1e-9 for r in got)


def test_wave_filter(spark):
    lon = np.arange(0, 360, 10.0)
    v = 2.0 * np.cos(np.radians(3 * lon) + 0.4) + 5 * np.cos(np.radians(9 * lon))
    s = spark.createDataFrame(pd.DataFrame({"t": 1, "lon": lon, "v": v}))
    got = gk.band_wave(s, ["t"], "v", 2, 5).toPandas().sort_values("lon")
    assert np.allclose(got["envelope"], 2.0) and np.allclose(got["wave"], 2 * np.cos(np.radians(3 * lon) + 0.4))


def test_peaks():
    v = np.array([0, 2, 0, 3, 0, 0, 1, 1, 0, 5.0])
    assert list(np.flatnonzero(gk.peak_mask(v, np.full(10, 0.5), 3))) == [3, 6]


def test_flux_of_a_wave_on_westerlies_points_east(spark):
    lat, lon = np.arange(25, 70, 2.5), np.arange(0, 180, 2.5)
    z = 50 * np.cos(np.radians(5 * lon))[None, :] * np.exp(-((lat - 45) / 10.0) ** 2)[:, None]
    f = gk.wave_flux(frame(spark, lat, lon, z=z, u=np.full(z.shape, 20.0), v=np.zeros(z.shape)), ["t", "level"], "z", "u", "v", lat_range=(30, 65)).toPandas()
    assert len(f) == z.size and f[f.lat < 30]["fx"].isna().all() and f[(f.lat > 40) & (f.lat < 50)]["fx"].mean() > 0
    one = f[(f.lat == 45) & (f.lon == 90)].iloc[0]
    assert abs(one.magnitude - np.hypot(one.fx, one.fy)) < 1e-12 and abs(one.southeast - (one.fx - one.fy) / np.sqrt(2)) < 1e-12
    # a pure wave in longitude: s_x^2 - s s_xx = (5 A)^2 everywhere, so the flux depends on latitude alone
    row = f[(f.lat == 45) & (f.lon > 20) & (f.lon < 160)]["fx"]
    assert row.std() / row.mean() < 0.02


def test_spearman_as_ranking_each_resampled_list(spark):
    """Block weights give what ranking each resampled list gives; permutations what ranking by their hashes gives."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (40, 3)).astype(float)
    b = np.arange(40) % 7
    rows = [(k, f"e{i}", int(b[i]), *map(float, v)) for k in "pq" for i, v in enumerate(x if k == "p" else x[:, ::-1])]
    rows += [("p", "z", None, 1.0, 2.0, 3.0), ("q", "z", 3, None, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, e string, s int, u double, v double, z double").repartition(6)
    got = {r["k"]: r for r in rt.spearman_interval(df, ["k"], ["u", "v", "z"], "s", 1100, 42, permutations=700, row=["e"]).collect()}

    def corr(m, ranked=False):
        r = list(m.T) if ranked else [pd.Series(c).rank().to_numpy() for c in m.T]
        d = np.column_stack([np.ones(len(m)), r[2]])
        p, q = (c - d @ np.linalg.lstsq(d, c, rcond=None)[0] for c in r[:2])
        return np.corrcoef(p, q)[0, 1]

    for k, m in (("p", x), ("q", x[:, ::-1])):
        draws = [corr(m[np.repeat(np.arange(40), w[b])]) for w in rs.plan_matrix(7, 1100, 42)]
        assert abs(got[k]["observed"] - corr(m)) < 1e-9 and got[k]["n"] == 40 and got[k]["n_valid"] == 1100
        assert np.allclose([got[k]["ci_low"], got[k]["ci_high"]], np.percentile(draws, [2.5, 97.5]), atol=1e-9)
        ranks = np.stack([pd.Series(c).rank().to_numpy() for c in m.T], 1)
        fixed = ranks[sorted(range(40), key=lambda i: f"e{i}:"), 0]
        hits = 0
        for p in range(700):
            order = sorted(range(40), key=lambda i: hashlib.md5(f"42:{p}:e{i}".encode()).hexdigest())
            hits += abs(corr(np.column_stack([fixed, ranks[order][:, 1:]]), True)) >= abs(corr(m)) - 1e-9
        assert got[k]["p_permutation"] == (hits + 1) / 701
    flat = rt.spearman_interval(df.withColumn("u", F.lit(1.0)), [], ["u", "v"], "s", 20).collect()
    assert len(flat) == 1 and flat[0]["observed"] is None and flat[0]["n_valid"] == 0
    assert rt.spearman_interval(df.limit(0), ["k"], ["u", "v"], "s", 20).count() == 0


def test_queries_run_the_stated_replicates():
    """No registered query hands the rank correlations or the shift intervals fewer replicates than their defaults."""
    import inspect
    from hiemal.operators import network as nw
    from hiemal.verification import q_hazard, q_network, q_resample
    text = "".join(inspect.getsource(m) for m in (q_hazard, q_network, q_resample))
    assert not any(x in text for x in ('"season", 100', "0.1, 400", "permutations=200"))
    assert "permutations=10_000" in text and all(inspect.signature(f).parameters["reps"].default == n for f, n in ((nw.known_date_shift, 2000), (nw.break_scan, 2000), (rt.spearman_interval, 10_000)))


def test_suggestions(spark):
    names = ["dhakka", "chitagong", "zzz"]
    off = ["dhaka", "chittagong", "sylhet", "zzzz"]
    got = {r["name_key"]: (r["suggested_key"], r["suggestion_score"]) for r in rc.suggest_names(
        spark.createDataFrame([(n,) for n in names], "name_key string"), spark.createDataFrame([(o,) for o in off], "official_key string"), pool_size=2).collect()}
    for n in names:
        best = max(off, key=lambda o: rc.indel_ratio(n, o))
        assert got[n] == (best, rc.indel_ratio(n, best))
    assert abs(rc.indel_ratio("dhakka", "dhaka") - 100 * 10 / 11) < 1e-9


def test_suggestions_by_index_and_by_pools(spark):
    rng = np.random.default_rng(5)
    off = sorted({f"supplier{i:06d}" for i in rng.integers(0, 3000, 400)} | {"", "a", "x" * 70, "supplier"})
    names = sorted({f"supplier{i:06d}" for i in rng.integers(0, 900000, 300)} | {"", "b", "xy" * 40, "q" * 70, "suplier"} - set(off))
    frame = lambda c, v: spark.createDataFrame([(x,) for x in v] + [(None,)], f"{c} string")
    got = {r[0]: (r[1], r[2]) for r in rc.suggest_names(frame("name_key", names), frame("official_key", off), pool_size=50).collect()}
    assert sorted(got) == names
    for n in names:
        best = min(off, key=lambda o: (-rc.indel_ratio(n, o), o))
        assert got[n] == (best, rc.indel_ratio(n, best)), n


def test_suggestions_compare_near_names_only(spark, monkeypatch):
    seen = []
    whole = rc._compared
    monkeypatch.setattr(rc, "_compared", lambda asked, keys, n: seen.append(asked.count()) or whole(asked, keys, n))
    off = spark.range(300).select(F.format_string("supplier%09d", "id").alias("official_key"))
    names = spark.range(300, 3000).select(F.format_string("supplier%09d", "id").alias("name_key"))
    assert rc.suggest_names(names, off).count() == 2700 and seen == [0]
