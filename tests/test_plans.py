import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hiemal.operators import resample as rs
from hiemal.plans import nearest, ordered


def test_average_and_minimum_rank(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"g": ["a"] * 900 + ["b"] * 30, "x": rng.integers(0, 60, 930).astype(float)})
    got = ordered.minimum_rank(ordered.average_rank(spark.createDataFrame(p), ["g"], "x", "r"), ["g"], "x", "m").toPandas()
    g = got.groupby("g")["x"]
    assert np.allclose(got["r"], g.rank()) and np.allclose(got["m"], g.rank(method="min", ascending=False))


def test_quantiles_and_median_of_others(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"g": np.repeat(["a", "b", "c"], [400, 7, 2]), "x": np.round(rng.normal(size=409), 1)})
    s = spark.createDataFrame(p)
    q = ordered.family_quantiles(s, ["g"], "x", {"q": 0.3}).toPandas().set_index("g")["q"]
    assert np.allclose(q.sort_index(), p.groupby("g")["x"].quantile(0.3))
    got = ordered.median_of_others(s, ["g"], "x", "m", "n").toPandas()
    for (g, x), part in got.groupby(["g", "x"]):
        rest = list(p.loc[p.g == g, "x"])
        rest.remove(x)
        assert np.allclose(part["m"], np.median(rest))


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    lat = np.concatenate([rng.uniform(20, 26, 60), 23 + rng.normal(0, 0.01, 200), [22.0] * 12])
    lon = np.concatenate([rng.uniform(88, 92, 60), 90 + rng.normal(0, 0.01, 200), [91.0] * 12])
    p = pd.DataFrame({"id": np.arange(len(lat)), "lat": lat, "lon": lon})
    s = spark.createDataFrame(p)
    a, b = np.radians(lat), np.radians(lon)
    h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a[:, None]) * np.cos(a) * np.sin((b[:, None] - b) / 2) ** 2
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(h))
    got = nearest.nearest_k(s, s, 3, 80.0, exclude_self=True, levels=4).toPandas().sort_values(["id", "neighbour_rank"])
    for i in range(len(p)):
        want = sorted((round(km[i, j], 9), j) for j in range(len(p)) if j != i and km[i, j] <= 80)[:3]
        mine = got[got.id == i]
        assert np.allclose(mine["distance_km"], [w[0] for w in want], atol=1e-6)


def test_false_discovery(spark):
    got = {r["i"]: r["q_value"] for r in rs.benjamini_hochberg(spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None)], "i int, p double"), [], "p").collect()}
    assert np.allclose([got[0], got[1], got[2]], [0.03, 0.04, 0.04]) and got[3] is None


def test_plus_one_p_and_sign_flip(spark):
    r = spark.range(1).select(rs.p_from_tails(F.lit(0), F.lit(10000), F.lit(10000))).first()[0]
    assert abs(r - 2 / 10001) < 1e-15
    d = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3)], "b int, d double").withColumn("k", F.lit(1))
    assert rs.sign_flip(d, ["k"], "b", "d").first()["p_value"] == 0.25


def test_plan_table_equals_matrix(spark):
    m = rs.plan_matrix(7, 20, 42)
    t = np.zeros_like(m)
    for r in rs.plan_table(spark, 7, 20, 42).collect():
        t[r["rep"], r["block_no"]] = r["weight"]
    assert (m == t).all() and (m.sum(axis=1) == 7).all()


def test_moments_of_a_large_mean_keep_their_digits(spark):
    import numpy as np
    from hiemal.operators import climatology as k
    rng = np.random.default_rng(6)
    rows = [(1, slot, float(v)) for slot in range(1, 366) for v in 1e8 + rng.normal(0, 0.01, 5)]
    got = {r.slot: r for r in k.pooled_moments(spark.createDataFrame(rows, "g int, slot int, x double").repartition(4), ["g"], "x", "slot", 7).collect()}
    for slot in (1, 100, 365):
        near = np.array([v for _, s, v in rows if min((s - slot) % 365, (slot - s) % 365) <= 7]) - 1e8
        assert got[slot].n == 75 and abs(got[slot].sd / near.std(ddof=1) - 1) < 1e-6


def test_calendar_windows_of_any_rows(spark):
    import numpy as np
    from hiemal.operators import climatology as k
    rng = np.random.default_rng(8)
    rows = [(int(g), int(y), int(s), float(v)) for g, y, s, v in zip(rng.integers(0, 3, 900), rng.integers(1995, 2000, 900), rng.integers(1, 367, 900), rng.normal(size=900).round(1))]
    df = spark.createDataFrame(rows + [(0, 1996, None, 5.0), (1, 1996, 7, None)], "station int, year int, slot int, x double")
    near = lambda g, slot: [(v, y) for h, y, s, v in rows if h == g and min((s - slot) % 366, (slot - s) % 366) <= 2]
    got = {(r.station, r.slot): r for r in k.robust_calendar(df, ["station"], "x", "slot", 2, min_scale=0.1).collect()}
    out = {(r.station, r.slot, r.excluded_year): r for r in k.leave_year_out_thresholds(df, ["station"], "x", "slot", 0.1, 1995, 1996, 2, 2, 2).collect()}
    moments = {(r.station, r.slot): r for r in k.pooled_moments(df, ["station"], "x", "slot", 2, 366).collect()}
    assert len(got) == len(moments) == sum(bool(near(g, s)) for g in range(3) for s in range(1, 367)) and len(out) == 2 * len(got)
    for (g, slot), r in got.items():
        v = np.array([v for v, _ in near(g, slot)])
        m = np.median(v)
        assert r.clim_n == moments[g, slot].n == len(v) and abs(moments[g, slot].mean - v.mean()) < 1e-9
        assert np.allclose([r.clim_median, r.clim_mad, r.clim_p01, r.clim_p99], [m, np.median(np.abs(v - m)), *np.quantile(v, [0.01, 0.99])])
        kept = [(v, y) for v, y in near(g, slot) if y != 1995]
        o = out[g, slot, 1995]
        assert (o.loo_observation_count, o.loo_year_count) == (len(kept), len({y for _, y in kept}))
        if o.loo_year_count >= 2:
            assert abs(o.loo_threshold - np.quantile([v for v, _ in kept], 0.1, method="median_unbiased")) < 1e-9
        else:
            assert o.loo_threshold is None


def test_nearest_levels_do_not_multiply_the_plan(spark):
    rng = np.random.default_rng(9)
    p = pd.DataFrame({"id": range(90), "lat": rng.uniform(20, 26, 90), "lon": rng.uniform(88, 92, 90)})
    pts = spark.createDataFrame(p)
    plan = lambda n: nearest.nearest_k(pts, pts, 3, 300.0, True, levels=n)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    one, two, six = plan(1), plan(2), plan(6)
    assert six <= one + 6 * (two + one)
    rows = lambda n: sorted((r.id, r.neighbour_rank, r.neighbour) for r in nearest.nearest_k(pts, pts, 3, 300.0, True, levels=n).collect())
    assert rows(6) == rows(1)


def test_robust_scale_works_its_array_out_once(spark):
    from hiemal.operators import network as nw
    c = nw.robust_scale(F.array_sort(F.concat("a", "b")), 0.1)
    assert str(c).count("concat(") == 1
    df = spark.createDataFrame([([3.0, 1.0], [8.0, 4.0, 100.0]), ([], []), (None, [1.0]), ([2.0], [2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(c).collect()]
    assert abs(got[0] - 1.4826 * 3) < 1e-9 and got[1:] == [None, None, 0.1]


def test_staging_frees_its_shuffle_files(spark):
    from hiemal.session import stage_table
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = lambda: tracker.shuffleStatuses().size()
    before = held()
    assert stage_table(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stage_table(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert held() - before <= 1  # count() above is no staging


def test_passing_tables_go(spark):
    import os
    from hiemal.session import passing_tables, stage_folder, stage_table
    tables = f"{stage_folder(spark)}/tables"
    os.makedirs(tables, exist_ok=True)
    before = set(os.listdir(tables))
    with passing_tables(spark) as keep:
        with passing_tables(spark) as stay:
            inner = stay(stage_table(spark.range(10)).where("id > 2"))
        assert inner.count() == 7 and len(set(os.listdir(tables)) - before) == 1
        out = keep(inner.where("id > 5"))
    assert out.count() == 4 and len(set(os.listdir(tables)) - before) == 1
    with pytest.raises(ZeroDivisionError), passing_tables(spark):
        stage_table(spark.range(3))
        1 / 0
    assert len(set(os.listdir(tables)) - before) == 1
