import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from hiemal.functions import calendar as cal, numeric as num, parse, quantile as q
from hiemal.operators import tails


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_leap_day_slots(spark):
    d = F.lit("2004-02-29").cast("date")
    r = one(spark, a=cal.slot_366(d), b=cal.slot_365(d), c=cal.slot_366(F.lit("2001-03-01").cast("date")), d=cal.slot_365(F.lit("2004-12-31").cast("date")))
    assert tuple(r) == (60, 59, 61, 365)


def test_cold_band_boundaries(spark):
    xs = [3.9, 4.0, 4.1, 6.0, 6.1, 8.0, 8.1, 10.0, 10.1, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(num.cold_band(F.col("x"))).collect()]
    assert got == ["very_severe"] * 2 + ["severe"] * 2 + ["moderate"] * 2 + ["mild"] * 2 + ["above_cold_wave_threshold", "missing"]


def test_quantile_rules(spark):
    a = F.array(*[F.lit(float(i)) for i in range(1, 11)])
    r = one(spark, t8=q.median_unbiased(a, 0.1), t7=q.linear(a, 0.1), m=q.median(a))
    assert abs(r["t8"] - np.quantile(np.arange(1, 11), 0.1, method="median_unbiased")) < 1e-12
    assert abs(r["t7"] - 1.9) < 1e-12 and r["m"] == 5.5


def test_parse_statuses(spark):
    rows = spark.createDataFrame([("",), ("****",), ("abc",), (" 7.5 ",), (None,), ("inf",)], "raw string")
    got = [tuple(r[0]) for r in rows.select(parse.parse_measurement(F.col("raw"))).collect()]
    assert got == [(None, "missing_cell"), (None, "missing_code"), (None, "non_numeric"), (7.5, "numeric"), (None, "missing_cell"), (None, "non_numeric")]
    d = spark.createDataFrame([("2001", "2", "29"), ("2004.0", "2", "29"), ("2001", "", "1"), ("2001", "x", "1")], "y string, m string, d string")
    got = [(r["date"], r["date_status"]) for r in parse.with_date(d, F.col("y"), F.col("m"), F.col("d")).collect()]
    assert got == [(None, "invalid_calendar_date"), (dt.date(2004, 2, 29), "valid"), (None, "missing_date_component"), (None, "invalid_date_component")]


def test_tails():
    assert abs(tails.t_two_sided(2.0, 10) - 0.07338803477074) < 1e-9
    assert abs(tails.chi2_1_tail(3.841458820694124) - 0.05) < 1e-9
    assert abs(tails.beta_quantile(0.025, 3, 8) - 0.0667395111777345) < 1e-9
