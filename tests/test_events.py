import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hiemal.operators import events as ev, hazard as hz

D = dt.date


def days(spark, flags, start=D(2000, 12, 1), season=2000):
    return spark.createDataFrame([(season, start + dt.timedelta(i), bool(f)) for i, f in enumerate(flags)], "season int, date date, f boolean")


def test_runs_keep_short_lengths(spark):
    got = ev.assign_runs(days(spark, [1, 1, 1, 0, 1, 1]), ["season"], "f", 3).orderBy("date").collect()
    assert [r["event_seq"] for r in got] == [1, 1, 1, None, None, None]
    assert [r["candidate_run_length"] for r in got] == [3, 3, 3, 0, 2, 2]


def test_runs_do_not_cross_seasons(spark):
    a = days(spark, [1, 1], D(2001, 2, 27), 2000).unionByName(days(spark, [1], D(2001, 12, 1), 2001))
    assert ev.assign_runs(a, ["season"], "f", 3).filter("qualifying").count() == 0


def test_gap_bridging(spark):
    share = [0.3, 0.3, 0.17, 0.3, 0.3]
    d = spark.createDataFrame([(2000, D(2000, 12, 1) + dt.timedelta(i), True, s) for i, s in enumerate(share)], "season int, date date, usable boolean, area double")
    got = ev.sweep(d, [{"id": "A", "column": "area", "share": 0.2, "min_days": 3, "marginal": 0.15}, {"id": "B", "column": "area", "share": 0.2, "min_days": 3}])
    assert {r["scenario"]: r["count"] for r in got.filter("qualifying").groupBy("scenario").count().collect()} == {"A": 5}


def test_event_comparison(spark):
    mk = lambda i, a, b: [(i, 2000, D(2001, 1, x)) for x in range(a, b + 1)]
    s = "event_id string, season int, date date"
    r = ev.compare_sets(spark.createDataFrame(mk("p", 1, 5), s), spark.createDataFrame(mk("o", 4, 8), s)).first()
    assert (r["intersection_days"], r["primary_overlap"], r["jaccard"], r["reproduced"]) == (2, 0.4, 0.25, False)


def test_peak_tie_takes_earlier_date(spark):
    d = spark.createDataFrame([("e", 1, D(2001, 1, 1), 0.5, 3), ("e", 1, D(2001, 1, 2), 0.5, 3)], "event_id string, season int, date date, a double, n int")
    assert ev.catalogue(d, ["season"], {}, "a", "n").first()["peak_date"] == D(2001, 1, 1)


def test_season_end_censoring(spark):
    c = spark.createDataFrame([("e", 2000, D(2001, 2, 24), D(2001, 2, 28), 5)], "event_id string, season int, start_date date, end_date date, duration_days int")
    cov = spark.createDataFrame([(D(2001, 2, 1) + dt.timedelta(i), 1.0) for i in range(40)], "date date, x double")
    r = hz.risk_set(c, cov, ["x"], [], 3)
    assert [x["terminates"] for x in r.orderBy("event_age").collect()] == [0, 0, 1]
    assert [x["terminates"] for x in hz.censor_season_end(r).orderBy("event_age").collect()] == [0, 0, 0]
    assert hz.censor_season_end(r, "drop_final").count() == 2


def walk(dates, x, gap=20, recovery=10):
    """Sequential acceptance of sign reversals."""
    at = {d: v for d, v in zip(dates, x)}

    def run(a, b, n):
        best = cur = 0
        for d, v in zip(dates, x):
            if a <= d <= b:
                cur = cur + 1 if v > 0 else 0
                best = max(best, cur)
        return best >= n
    out, one = [], dt.timedelta(1)
    for d in dates:
        if d.month in (11, 12, 1, 2, 3) and at[d] < 0 and at.get(d - one, -1) >= 0:
            if out and not run(out[-1] + one, d - one, gap):
                continue
            if run(d + one, D(d.year if d.month <= 4 else d.year + 1, 4, 30), recovery):
                out.append(d)
    return out


def test_sign_reversals_match_a_walk(spark):
    rng = np.random.default_rng(5)
    frames, want = [], {}
    dates = [D(2000, 10, 1) + dt.timedelta(i) for i in range(900)]
    for s in range(8):
        x = np.convolve(rng.normal(size=930), np.ones(31) / 31, "valid")[:900]
        frames.append(pd.DataFrame({"s": s, "date": dates, "x": x}))
        want[s] = walk(dates, x)
    got = ev.sign_reversals(spark.createDataFrame(pd.concat(frames)), "x", keys=["s"]).toPandas()
    assert sum(len(v) for v in want.values()) > 5
    for s in want:
        assert sorted(got.loc[got.s == s, "central_date"]) == want[s]


def test_nearest_dates(spark):
    f = [D(1990, 1, 5), D(1990, 12, 30), D(1999, 3, 3)]
    r = [D(1991, 1, 2), D(1994, 6, 1), D(1999, 3, 3), D(1980, 1, 1)]
    got = {x["reference_date"]: x["nearest_date"] for x in ev.nearest_dates(
        spark.createDataFrame([(d,) for d in r], "reference_date date"), spark.createDataFrame([(d,) for d in f], "central_date date")).collect()}
    assert got == {d: min(f, key=lambda z: abs((z - d).days)) for d in r}
