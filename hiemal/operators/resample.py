"""Block bootstrap, sign-flip and permutation tests, multiple testing and matched nulls.

Rows are first reduced to one sum per key and block (a partial aggregate). What is resampled is
that short array, so the cost of B replicates does not depend on the number of rows. The plan
matrix (replicates x blocks, blocks being seasons) is the only thing sent to the tasks.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..plans.single import attach
from ..functions import calendar as cal
from ..plans.ordered import average_rank, running_extreme, tie_totals, with_rank
from .replicates import drawn, kept
from .tails import binomial_interval, t_p_value

def refuse_large(df: DataFrame, keys: list[str], limit: int, what: str) -> None:
    """Stop before a key with more than ``limit`` rows would be packed into one Arrow row."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if n.filter(F.col("_n") > limit).limit(1).count():
        raise ValueError(f"{what}: a group has more than {limit} rows")


# ---------------------------------------------------------------- plan
def block_list(df: DataFrame, block: str) -> list:
    """Sorted distinct blocks; these are seasons, so their number grows with the years on record and not with the rows."""
    return sorted(r[0] for r in df.select(block).filter(F.col(block).isNotNull()).distinct().collect())


def plan_matrix(n_blocks: int, reps: int, seed: int, method: str = "hash") -> np.ndarray:
    """reps x n_blocks resampling counts.

    ``numpy`` uses a generator seeded once; ``hash`` takes draw j of replicate r from
    md5("seed:r:j"), which any SQL engine can repeat.
    """
    if method == "numpy":
        draws = np.random.default_rng(seed).integers(0, n_blocks, size=(reps, n_blocks))
    else:
        draws = np.array([[int(hashlib.md5(f"{seed}:{r}:{j}".encode()).hexdigest()[:8], 16) % n_blocks for j in range(n_blocks)] for r in range(reps)], np.int64).reshape(reps, n_blocks)
    out = np.zeros((reps, n_blocks), np.int32)
    np.add.at(out, (np.arange(reps)[:, None], draws), 1)
    return out


def plan_table(spark: SparkSession, n_blocks: int, reps: int, seed: int) -> DataFrame:
    """The hash plan as rows (rep, block_no, weight), generated in parallel."""
    d = spark.range(reps).withColumnRenamed("id", "rep").withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("_j").cast("string"))
    no = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n_blocks
    return d.groupBy("rep", no.cast("int").alias("block_no")).agg(F.count(F.lit(1)).alias("weight"))


def p_from_tails(n_le: Column, n_ge: Column, n: Column) -> Column:
    """Two-sided plus-one p-value; never zero, null without valid replicates."""
    return F.when(n > 0, F.least(F.lit(1.0), F.lit(2.0) * (F.least(n_le, n_ge) + 1) / (n + 1)))


def block_arrays(df: DataFrame, keys: list[str], block: str, blocks: list, sums: dict[str, Column]) -> DataFrame:
    """One row per key with, for every named column, an array of its per-block sums."""
    kind = next(t for c, t in df.select(F.col(block).alias("b")).dtypes)
    each = df.groupBy(*keys, F.col(block).alias("_b")).agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()])
    # at most one entry per block, as the sums are merged before
    packed = each.groupBy(*keys).agg(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", F.struct(*sums)))).alias("_e"))
    found, order = F.map_from_entries("_e"), F.array(*[F.lit(b) for b in blocks]).cast(f"array<{kind}>")
    entry = lambda n: lambda b: F.coalesce(F.try_element_at(found, b)[n], F.lit(0.0))
    return packed.select(*keys, *[F.transform(order, entry(n)).alias(n) for n in sums])


_RESULT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("observed", "se", "ci_low", "ci_high", "n_le", "n_ge", "n_valid")])


def _summary(obs: np.ndarray, draws: np.ndarray) -> pd.DataFrame:
    """Percentile summary of replicate draws (replicates x rows); undefined replicates leave n_valid."""
    draws = np.round(draws, 12)  # a draw of exactly zero counts on both sides, so remove rounding noise
    ok = np.isfinite(draws)
    n = ok.sum(axis=0)
    lo, hi, se = (np.full(draws.shape[1], np.nan) for _ in range(3))
    for j in range(draws.shape[1]):
        d = draws[ok[:, j], j]
        if len(d):
            lo[j], hi[j] = np.percentile(d, [2.5, 97.5])
            se[j] = d.std(ddof=1) if len(d) > 1 else np.nan
    return pd.DataFrame({"observed": obs, "se": se, "ci_low": lo, "ci_high": hi, "n_le": ((draws <= 0) & ok).sum(axis=0).astype(float),
                         "n_ge": ((draws >= 0) & ok).sum(axis=0).astype(float), "n_valid": n.astype(float)})


def plan_tiles(n_blocks: int, reps: int, seed: int, method: str, size: int = 1000) -> list[np.ndarray]:
    """The plan in tiles of ``size`` replicates, made in the task and kept by its Python worker; what travels is the seed."""
    if method == "numpy":
        whole = kept(("numpy", n_blocks, reps, seed), lambda: plan_matrix(n_blocks, reps, seed, method))
        return [whole[lo:lo + size] for lo in range(0, reps, size)]
    return [drawn(n_blocks, lo, min(reps, lo + size), seed) for lo in range(0, reps, size)]


def _by_chunks(make, arrays: list[pd.Series], plan: tuple, chunk: int = 256) -> pd.DataFrame:
    """Key tiles times replicate tiles; ``plan`` has the arguments of ``plan_tiles``."""
    cols = [np.stack([np.asarray(x, float) for x in a]) if len(a) else np.zeros((0, plan[0])) for a in arrays]
    parts, tiles = [], plan_tiles(*plan)
    one = np.ones((1, plan[0]))
    for i in range(0, len(arrays[0]), chunk):
        c = [a[i:i + chunk] for a in cols]
        with np.errstate(all="ignore"):
            parts.append(_summary(make(one, c)[0], np.concatenate([make(tile, c) for tile in tiles])))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[f.name for f in _RESULT])


def _udf(make, plan: tuple, n: int):
    """Arrow function of n array columns that summarises ``make(weights, arrays)`` over the plan of ``plan_tiles(*plan)``."""
    if n == 2:
        def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return _by_chunks(make, [a, b], plan)
    elif n == 4:
        def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
            return _by_chunks(make, [a, b, c, d], plan)
    else:
        def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.DataFrame:
            return _by_chunks(make, [a, b, c, d, e], plan)
    return F.pandas_udf(run, _RESULT)


def _unpack(df: DataFrame, keys: list[str]) -> DataFrame:
    out = df.select(*keys, "_r.*")
    for c in _RESULT.names:
        out = out.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    for c in ("n_le", "n_ge", "n_valid"):
        out = out.withColumn(c, F.col(c).cast("long"))
    return out.withColumn("p_value", p_from_tails(F.col("n_le"), F.col("n_ge"), F.col("n_valid")))


def _mean(w, c):
    return (w @ c[0].T) / (w @ c[1].T)


def _difference(w, c):
    return (w @ c[0].T) / (w @ c[1].T) - (w @ c[2].T) / (w @ c[3].T)


def _slope(w, c):
    n, x, y, xx, xy = (w @ a.T for a in c)
    return (n * xy - x * y) / (n * xx - x * x)


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, block: str, reps: int = 10_000, seed: int = 42, method: str = "hash", blocks: list | None = None) -> DataFrame:
    """Mean per key with block-bootstrap interval, tail counts and plus-one p.

    The same function serves one scalar per key and one map cell per key. ``blocks`` fixes the
    drawn blocks; by default they are those with a value.
    """
    d = df.filter(F.col(value).isNotNull())
    blocks = blocks or block_list(d, block)
    a = block_arrays(d, keys, block, blocks, {"_s": F.col(value), "_n": F.lit(1.0)})
    return _unpack(a.withColumn("_r", _udf(_mean, (len(blocks), reps, seed, method), 2)("_s", "_n")), keys)


def bootstrap_difference(df: DataFrame, keys: list[str], value: str, block: str, is_a: Column, is_b: Column, reps: int = 10_000, seed: int = 42,
                         method: str = "hash", blocks: list | None = None) -> DataFrame:
    """mean(A) - mean(B) per key; replicates without one of the groups are undefined and dropped."""
    d = df.filter(F.col(value).isNotNull())
    blocks = blocks or block_list(d, block)
    one, x = F.lit(1.0), F.col(value)
    a = block_arrays(d, keys, block, blocks, {"_sa": F.when(is_a, x), "_na": F.when(is_a, one), "_sb": F.when(is_b, x), "_nb": F.when(is_b, one)})
    a = a.withColumn("_r", _udf(_difference, (len(blocks), reps, seed, method), 4)("_sa", "_na", "_sb", "_nb"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v).cast("long")
    counts = a.select(*keys, "_r", total("_na").alias("n_a"), total("_nb").alias("n_b"))
    return _unpack(counts, [*keys, "n_a", "n_b"])


def bootstrap_slope(df: DataFrame, keys: list[str], x: Column, y: str, block: str, reps: int = 10_000, seed: int = 42, method: str = "hash", per: float = 10.0) -> DataFrame:
    """Least-squares slope per ``per`` units of x with a block interval, from block moments."""
    d = df.filter(F.col(y).isNotNull()).withColumn("_x", x.cast("double") / per)
    blocks = block_list(d, block)
    a = block_arrays(d, keys, block, blocks, {"_n": F.lit(1.0), "_sx": F.col("_x"), "_sy": F.col(y), "_xx": F.col("_x") * F.col("_x"), "_xy": F.col("_x") * F.col(y)})
    return _unpack(a.withColumn("_r", _udf(_slope, (len(blocks), reps, seed, method), 5)("_n", "_sx", "_sy", "_xx", "_xy")), keys)


def leave_one_out(df: DataFrame, keys: list[str], value: str, block: str) -> DataFrame:
    """Sign stability of the mean when each block is left out, same-sign block share, block-equal mean."""
    b = df.filter(F.col(value).isNotNull()).groupBy(*keys, block).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    t = b.groupBy(*keys).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    j = b.join(t, keys) if keys else attach(b, t)
    rest = F.round((F.col("_ts") - F.col("_s")) / F.when(F.col("_tn") > F.col("_n"), F.col("_tn") - F.col("_n")), 12)
    full, own = F.round(F.col("_ts") / F.col("_tn"), 12), F.round(F.col("_s") / F.col("_n"), 12)
    return j.groupBy(*keys).agg(
        F.max(F.col("_ts") / F.col("_tn")).alias("mean"), F.count(F.lit(1)).alias("block_count"),
        F.avg(F.when(rest.isNotNull(), (F.signum(rest) == F.signum(full)).cast("double"))).alias("loo_sign_stability"),
        F.avg((F.signum(own) == F.signum(full)).cast("double")).alias("same_sign_fraction"), F.avg(F.col("_s") / F.col("_n")).alias("block_equal_mean"),
        F.min(rest).alias("loo_low"), F.max(rest).alias("loo_high"))


# ---------------------------------------------------------------- sign flips
def _signed_sums(d: np.ndarray) -> np.ndarray:
    """Sums of ``d`` under every choice of signs."""
    sums = np.zeros(1)
    for v in d:
        sums = np.concatenate([sums + v, sums - v])
    return sums


def _flip_share(d: np.ndarray, exact_up_to: int, draws: int, seed: int) -> float:
    if not len(d) or not np.isfinite(d).all():
        return np.nan
    far = abs(d.sum()) - 1e-9 * np.abs(d).sum()  # rounding must not exclude the observed pattern
    if far <= 0:
        return 1.0
    if len(d) <= exact_up_to:
        one, two = _signed_sums(d[::2]), np.sort(_signed_sums(d[1::2]))
        above = len(two) - np.searchsorted(two, far - one, "left")
        return float(2 * above.sum() / 2.0 ** len(d))  # the patterns below are the mirror images
    rng, hits, left = np.random.default_rng(seed), 0, draws
    while left:
        n = min(left, 1 << 15)
        hits += int(np.count_nonzero(np.abs(np.where(rng.random((n, len(d))) < 0.5, 1.0, -1.0) @ d) >= far))
        left -= n
    return (hits + 1) / (draws + 1)


def sign_flip(df: DataFrame, keys: list[str], block: str, value: str, exact_up_to: int = 22, draws: int = 200_000, seed: int = 42) -> DataFrame:
    """Two-sided sign-flip test of zero mean over per-block differences, per key.

    Up to ``exact_up_to`` blocks the share of all 2^n patterns whose sum is as far from zero is counted exactly: the blocks
    are parted into two halves, the signed sums of one half are sorted, and each sum of the other half finds by bisection
    how many complete it. Beyond, ``draws`` random patterns give a plus-one p.
    """
    @F.pandas_udf(T.DoubleType())
    def p(values: pd.Series) -> pd.Series:
        return pd.Series([_flip_share(np.asarray([np.nan if x is None else x for x in v], float), exact_up_to, draws, seed) for v in values])

    a = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(block), F.col(value).alias("v")))).alias("_a"))
    a = a.select(*keys, F.size("_a").alias("block_count"), F.transform("_a", lambda e: e["v"]).alias("_v"))
    r = a.withColumn("p_value", p("_v")).withColumn("mean_difference", F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / F.col("block_count"))
    return r.drop("_v").withColumn("p_value", F.when(~F.isnan("p_value"), F.col("p_value")))


# ---------------------------------------------------------------- multiple testing
def benjamini_hochberg(df: DataFrame, family: list[str], p: str, out: str = "q_value") -> DataFrame:
    """q-values within each family; null p stays null and does not count.

    Tied p share the largest rank. The family is never collected into one task (see
    ``plans.ordered``), so a map of any size may be one family.
    """
    def q_values(d):
        t = tie_totals(d, family, p)
        raw = F.col(p) * F.col("n_family") / (F.col("n_before") + F.col("n"))
        return running_extreme(t.select(*family, p, raw.alias("_raw")), family, p, "_raw", "_q").select(*family, p, F.least(F.col("_q"), F.lit(1.0)).alias(out))

    return with_rank(df, family, p, q_values)


# ---------------------------------------------------------------- rank correlation
def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman correlation per key from distributed average ranks."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_rank(average_rank(d, keys, x, "_rx"), keys, y, "_ry")
    return d.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def partial_spearman(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Spearman correlation of x and y with the ranks of one control removed."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    for c, r in ((x, "_rx"), (y, "_ry"), (z, "_rz")):
        d = average_rank(d, keys, c, r)
    g = d.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("_xy"), F.corr("_rx", "_rz").alias("_xz"), F.corr("_ry", "_rz").alias("_yz"), F.count(F.lit(1)).alias("n"))
    den = F.sqrt((1 - F.col("_xz") * F.col("_xz")) * (1 - F.col("_yz") * F.col("_yz")))
    return g.select(*keys, "n", F.when(den > 0, (F.col("_xy") - F.col("_xz") * F.col("_yz")) / den).alias("rho"))


# ---------------------------------------------------------------- matched nulls
def _pick(seed: int, rep: Column, key: Column, size: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), key.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % size).cast("int")


def matched_values(onsets: DataFrame, daily: DataFrame, value: str, reps: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """Per replicate the mean of one random same-calendar-day value per onset.

    Pools are arrays per month-day (and phase), as long as the number of seasons.
    """
    by = by or []
    pool = daily.filter(F.col(value).isNotNull()).groupBy("month_day", *by).agg(F.array_sort(F.collect_list(value)).alias("_p"))
    j = onsets.select("event_id", "month_day", *by).join(pool, ["month_day", *by]).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    x = F.get("_p", _pick(seed, F.col("rep"), F.col("event_id"), F.size("_p")))
    return j.withColumn("_x", x).groupBy("rep").agg(F.avg("_x").alias("null_value"), F.count(F.lit(1)).alias("onset_count"))


def admissible_dates(dates: DataFrame, first: int, last: int, distance: int = 45, jitter: int = 0, phases: DataFrame | None = None) -> DataFrame:
    """All (id, candidate) dates in another season at the same calendar day, away from every real date.

    Days within ``distance`` of a real date are listed once and removed by an anti join. ``phases``
    (season, phase) keeps seasons of the same phase. Ids without any candidate are kept with
    ``fallback`` true, so that no date disappears from the null.
    """
    own = cal.season_year(F.col("date"), 6)
    c = dates.select("id", "date", own.alias("_own"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("season")).filter("season <> _own")
    if phases is not None:
        p = phases.select(F.col("season").alias("_own"), F.col("phase").alias("_ph"))
        c = c.join(p, "_own").join(phases, "season").filter(F.col("phase") == F.col("_ph"))
    c = c.withColumn("_o", F.explode(F.sequence(F.lit(-jitter), F.lit(jitter))))
    c = c.withColumn("candidate", F.date_add(cal.shift_to_season(F.col("date"), F.col("season")), F.col("_o")))
    taken = dates.select(F.explode(F.sequence(F.date_sub("date", distance), F.date_add("date", distance))).alias("candidate")).distinct()
    free = c.join(taken, "candidate", "left_anti").select("id", "date", "candidate").withColumn("fallback", F.lit(False))
    rest = c.join(free.select("id").distinct(), "id", "left_anti").select("id", "date", "candidate").withColumn("fallback", F.lit(True))
    return free.unionByName(rest)


def null_dates(candidates: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, id, null_date, fallback): one admissible candidate per date and replicate."""
    p = candidates.groupBy("id").agg(F.array_sort(F.collect_list("candidate")).alias("_c"), F.max("fallback").alias("fallback"))
    p = p.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return p.select("rep", "id", "fallback", F.get("_c", _pick(seed, F.col("rep"), F.col("id"), F.size("_c"))).alias("null_date"))


def redraw_diagnostics(dates: DataFrame, candidates: DataFrame, all_pairs: int) -> DataFrame:
    """Share of admissible pairs per date and the expected number of draws until one is found."""
    n = candidates.filter("NOT fallback").groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    j = dates.select("id").distinct().join(n, "id", "left").withColumn("admissible", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")
    share = F.col("admissible") / F.lit(float(all_pairs))
    return j.withColumn("admissible_share", share).withColumn("expected_draws", F.when(share > 0, 1 / share)).withColumn("always_fails", F.col("admissible") == 0)


def window_days(dates: DataFrame, first: int, last: int, by: list[str] | None = None, date: str = "date") -> DataFrame:
    """Distinct days covered by windows around dates."""
    return dates.select(*(by or []), F.explode(F.sequence(F.date_add(date, first), F.date_add(date, last))).alias("day")).distinct()


def onsets_in_windows(onsets: DataFrame, dates: DataFrame, first: int, last: int, by: list[str] | None = None, date: str = "date") -> DataFrame:
    """Onsets that fall in any window, each counted once (per replicate if ``by`` is given).

    Events with one start date, which are nearly all, are counted by day before they meet the windows; only those listed under several dates are
    told apart one by one.
    """
    by = by or []
    w = window_days(dates, first, last, by, date)
    e = onsets.select("event_id", F.col("start_date").alias("day")).distinct()
    several = e.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"), F.min("day").alias("day"))
    alone = several.filter("_n = 1").groupBy("day").agg(F.count(F.lit(1)).alias("_c"))
    repeated = e.join(several.filter("_n > 1").select("event_id"), "event_id")
    hit = w.join(alone, "day").groupBy(*by).agg(F.sum("_c").alias("_c")).unionByName(w.join(repeated, "day").groupBy(*by).agg(F.count_distinct("event_id").alias("_c")))
    return hit.groupBy(*by).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("onset_count"))


def null_summary(null: DataFrame, value: str, observed: Column) -> DataFrame:
    """Null mean, percentiles, one- and two-sided plus-one p, dispersion, and the critical count: the smallest whole number
    that at most 5% of the null values reach."""
    x = F.col(value).cast("double")
    g = null.withColumn("_o", observed).groupBy("_o").agg(
        F.count(x).alias("n"), F.avg(x).alias("null_mean"), F.percentile(x, 0.025).alias("null_p025"), (F.floor(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY CAST({value} AS DOUBLE))")) + 1).cast("long").alias("critical_value"), F.percentile(x, 0.975).alias("null_p975"),
        F.var_pop(x).alias("_v"), F.count_if(x >= F.col("_o")).alias("_ge"), F.count_if(x <= F.col("_o")).alias("_le"))
    return g.select(F.col("_o").alias("observed"), "n", "null_mean", "null_p025", "null_p975", "critical_value", ((F.col("_ge") + 1) / (F.col("n") + 1)).alias("p_one_sided"),
                    p_from_tails(F.col("_le"), F.col("_ge"), F.col("n")).alias("p_two_sided"), F.when(F.col("null_mean") != 0, F.col("_v") / F.col("null_mean")).alias("dispersion"))


def exposure(days: DataFrame, cat: DataFrame, dates: DataFrame, first: int, last: int) -> DataFrame:
    """At-risk days (not inside an event after its onset), and those inside windows, per season."""
    inner = cat.filter("duration_days > 1").select(F.explode(F.sequence(F.date_add("start_date", 1), F.col("end_date"))).alias("date")).distinct()
    risk = days.select("season", "date").distinct().join(inner, "date", "left_anti")
    w = window_days(dates, first, last).select(F.col("day").alias("date"), F.lit(True).alias("_w"))
    j = risk.join(w, "date", "left")
    return j.groupBy("season").agg(F.count(F.lit(1)).alias("at_risk_days"), F.count("_w").alias("window_days"))


def rate_ratio(df: DataFrame, events_in: str, days_in: str, events_out: str, days_out: str, level: float = 0.95) -> DataFrame:
    """Rate ratio with the exact conditional-binomial interval."""
    k, m = F.col(events_in), F.col(events_out)
    ratio = F.col(days_out) / F.col(days_in)
    d = df.withColumn("_ci", binomial_interval(k.cast("double"), (k + m).cast("double"), F.lit(level)))
    odds = lambda p: F.when(p < 1, p / (1 - p) * ratio)
    return d.select(*df.columns, F.when(m > 0, k / m * ratio).alias("rate_ratio"), odds(F.col("_ci.low")).alias("ci_low"), odds(F.col("_ci.high")).alias("ci_high"))


def quiet_contrast(daily: DataFrame, cat: DataFrame, value: str, distance: int = 10, min_days: int = 10) -> DataFrame:
    """Onset value minus the mean of the season's days far from any event."""
    near = cat.select(F.explode(F.sequence(F.date_sub("start_date", distance), F.date_add("end_date", distance))).alias("date")).distinct()
    q = daily.join(near, "date", "left_anti").filter(F.col(value).isNotNull()).groupBy("season").agg(F.avg(value).alias("quiet_mean"), F.count(F.lit(1)).alias("quiet_days"))
    o = cat.select("event_id", F.col("start_date").alias("date")).join(daily.select("date", "season", F.col(value).alias("onset_value")), "date")
    return o.join(q.filter(F.col("quiet_days") >= min_days), "season").withColumn("contrast", F.col("onset_value") - F.col("quiet_mean"))


# ---------------------------------------------------------------- detectability and maps
# fixed values: normal quantiles of a two-sided 5% test and of 80% power
Z_TEST, Z_POWER = 1.959963984540054, 0.8416212335729143


def minimum_detectable(ci_low: Column, ci_high: Column) -> tuple[Column, Column]:
    """(standard error, smallest effect found with 80% power) from a 95% interval."""
    se = (ci_high - ci_low) / F.lit(2 * Z_TEST)
    return se, F.lit(Z_TEST + Z_POWER) * se


def pooled_sd(df: DataFrame, keys: list[str], value: str, is_a: Column, is_b: Column) -> DataFrame:
    """Pooled sample SD of two groups."""
    x = F.col(value)
    g = df.groupBy(*keys).agg(F.var_samp(F.when(is_a, x)).alias("_va"), F.count(F.when(is_a, x)).alias("n_a"), F.var_samp(F.when(is_b, x)).alias("_vb"), F.count(F.when(is_b, x)).alias("n_b"))
    v = ((F.col("n_a") - 1) * F.col("_va") + (F.col("n_b") - 1) * F.col("_vb")) / (F.col("n_a") + F.col("n_b") - 2)
    return g.select(*keys, "n_a", "n_b", F.sqrt(v).alias("pooled_sd"))


def cell_regression(df: DataFrame, keys: list[str], y: str, x: str, control: str | None = None) -> DataFrame:
    """Cell-wise slope, correlation, t and p of y on x, optionally with a control variable."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(control).isNotNull() if control else F.lit(True)))
    aggs = [F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("_r"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy")]
    if control:
        aggs += [F.corr(x, control).alias("_xz"), F.corr(y, control).alias("_yz")]
    g = d.groupBy(*keys).agg(*aggs)
    if control:
        kx, ky = 1 - F.col("_xz") * F.col("_xz"), 1 - F.col("_yz") * F.col("_yz")
        top = F.col("_r") - F.col("_xz") * F.col("_yz")
        r, slope, dof = F.when(kx * ky > 0, top / F.sqrt(kx * ky)), F.when((kx > 0) & (F.col("_sx") > 0), top / kx * F.col("_sy") / F.col("_sx")), F.col("n") - 3
    else:
        r, slope, dof = F.col("_r"), F.when(F.col("_sx") > 0, F.col("_r") * F.col("_sy") / F.col("_sx")), F.col("n") - 2
    g = g.withColumn("slope", slope).withColumn("r", r).withColumn("dof", dof)
    g = g.withColumn("t", F.when((F.col("dof") > 0) & (F.abs("r") < 1), F.col("r") * F.sqrt(F.col("dof") / (1 - F.col("r") * F.col("r")))))
    return g.select(*keys, "n", "slope", "r", "t", "dof").withColumn("p_value", t_p_value("t", F.col("dof").cast("double")))
