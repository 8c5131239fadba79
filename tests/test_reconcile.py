"""Row numbers of collapsed duplicates."""
import numpy as np

from pyspark.sql import functions as F

from hiemal.operators import reconcile as rc


def test_source_rows_come_back_as_runs(spark):
    rng = np.random.default_rng(2)
    rows = [("a", int(n)) for n in rng.choice(400, 330)] + [("b", n) for n in range(7, 50)] + [("c", 16), ("c", 15), ("c", None), ("d", -1), ("d", 0), ("d", 1)]
    d = spark.createDataFrame(rows, "k string, src_row long").repartition(3)
    for stretch in (1, 2, 16, 1 << 16):
        got = rc.source_row_runs(d, ["k"], stretch=stretch).collect()
        assert sorted((r.k, n) for r in got for n in range(r.first_row, r.last_row + 1)) == sorted({(k, n) for k, n in rows if n is not None})
        ends = {(r.k, r.last_row + 1) for r in got}
        assert not ends & {(r.k, r.first_row) for r in got}  # maximal
        assert all(r.run_rows == r.last_row - r.first_row + 1 for r in got)
        assert [(r.first_row, r.last_row) for r in got if r.k in "bd"] in ([(7, 49), (-1, 1)], [(-1, 1), (7, 49)])
    assert rc.source_row_runs(d.limit(0), ["k"]).count() == 0


def test_remainders_of_names_are_not_broadcast(spark):
    key = F.format_string("supplier%09d", "id")
    keys, asked = spark.range(0, 40).select(key.alias("official_key")), spark.range(40, 900, 20).select(key.alias("name_key"))
    plans = [rc._near_names(asked, keys, gone, longest, [17])._jdf.queryExecution().executedPlan().toString() for gone, longest in rc.DELETIONS]
    assert all("SortMergeJoin [_text" in p for p in plans)
    official = keys.withColumn("station", F.lit(1))
    aliases = spark.createDataFrame([("a", "b")], "name_key string, alias_target string")
    assert "SortMergeJoin [official_key" in rc.crosswalk(asked.withColumn("name", F.lit("n")), official, aliases)._jdf.queryExecution().executedPlan().toString()
    got = rc.suggest_names(asked, official).collect()
    every = [r.official_key for r in keys.collect()]
    assert len(got) == 43
    for r in got:
        score, best = min((-rc.indel_ratio(r.name_key, k), k) for k in every)
        assert (r.suggestion_score, r.suggested_key) == (-score, best)
