"""Out-of-block validation of hazard models with any number of rows.

Everything a fold needs is what all blocks give less what its own block gives. Fits that leave one block out come from sufficient rows
(``replicates``), counts, means and correlations from sums by block, and candidates are rows (fold, candidate) that are screened, ranked and
chosen by DataFrame operations. No task holds the rows of a fold, and no row is copied for each fold.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..plans.ordered import _ranges
from ..plans.single import attach
from ..session import stage_table
from .replicates import CHUNK, PART_ROWS, block_numbers, fits_of_parts, model_parts, weights_of, with_intercept
from .resample import benjamini_hochberg
from .tails import chi2_1_tail

#: Training rows that a candidate needs to be screened.
SCREEN_ROWS = 30


# ---------------------------------------------------------------- selection
@F.pandas_udf(T.DoubleType())
def likelihood_ratio_p(gain: pd.Series) -> pd.Series:
    return gain.map(chi2_1_tail)


def training_likelihoods(parts: DataFrame, draws: DataFrame, keys: list[str], k: int, chunk: int = CHUNK) -> DataFrame:
    """(keys, rep, ll): the log likelihood of each fit on the rows it was fitted to, where replicate r left block r out; undefined fits have no row."""
    @F.pandas_udf("array<struct<rep: int, ll: double>>")
    def run(b: pd.Series, n: pd.Series, s: pd.Series, z: pd.Series, rep: pd.Series, coef: pd.Series) -> pd.Series:
        out = []
        for b_, n_, s_, z_, rep_, coef_ in zip(b, n, s, z, rep, coef):
            design, beta, mine = with_intercept(z_, k), np.asarray(coef_, float).reshape(-1, k + 1), []
            n_, s_, b_ = np.asarray(n_, float)[:, None], np.asarray(s_, float)[:, None], np.asarray(b_)[:, None]
            for i in range(0, len(beta), 128):
                eta = design @ beta[i:i + 128].T
                mine.append(np.where(b_ == np.asarray(rep_)[i:i + 128], 0.0, s_ * eta - n_ * np.logaddexp(0.0, eta)).sum(axis=0))
            out.append([{"rep": int(r), "ll": float(v)} for r, v in zip(rep_, np.concatenate(mine))])
        return pd.Series(out)

    fits = draws.where("coef IS NOT NULL").groupBy(*keys, F.floor(F.col("rep") / chunk).alias("_c")).agg(F.sort_array(F.collect_list(F.struct("rep", "coef"))).alias("_f"))
    pairs = parts.join(fits, keys)
    each = pairs.select(*keys, F.inline(run("b", "n", "s", "z", F.col("_f.rep"), F.flatten("_f.coef"))))
    return each.groupBy(*keys, "rep").agg(F.sum("ll").alias("ll"))


def screened(rows: DataFrame, blocks: DataFrame, n_blocks: int, n_adjust: int, part_rows: int) -> DataFrame:
    """(rep, _j, p): likelihood-ratio p of every candidate in the training rows of every fold.

    A candidate is judged on the rows that hold it, against the base model on the same rows. With fewer than SCREEN_ROWS of them, or without
    spread, it has no row.
    """
    base = [f"_a{i}" for i in range(n_adjust)]
    c = rows.select("_block", "_b", "_y", *[F.get("_a", i).alias(a) for i, a in enumerate(base)], F.posexplode("_x").alias("_j", "_v")).where("_v IS NOT NULL")
    lls = []
    for name, columns in (("_more", ["_v", *base]), ("_less", base)):
        _, parts, facts = model_parts(c, ["_j"], columns, "_block", "_y", blocks, part_rows)
        draws = fits_of_parts(parts, facts, ["_j"], len(columns), n_blocks, n_blocks, None)
        lls.append(training_likelihoods(parts, draws, ["_j"], len(columns)).withColumnRenamed("ll", name))
    held = stage_table(c.groupBy("_j", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    whole = held.groupBy("_j").agg(F.sum("_n").alias("_all"), F.min("_lo").alias("_all_lo"), F.max("_hi").alias("_all_hi"))
    by = Window.partitionBy("_j").orderBy("_b")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    own = held.select("_j", F.col("_b").alias("rep"), "_n", F.least(F.min("_lo").over(before), F.min("_lo").over(after)).alias("_lo"),
                      F.greatest(F.max("_hi").over(before), F.max("_hi").over(after)).alias("_hi"))
    out = lls[0].join(lls[1], ["_j", "rep"]).where("rep >= 0").join(own, ["_j", "rep"], "left").join(whole, "_j")
    lo, hi = (F.when(F.col("_n").isNull(), F.col(f"_all_{e}")).otherwise(F.col(f"_{e}")) for e in ("lo", "hi"))
    out = out.where((F.col("_all") - F.coalesce("_n", F.lit(0)) >= SCREEN_ROWS) & (lo < hi))
    gain = 2 * (F.col("_more") - F.col("_less"))
    return out.where(~F.isnan(gain)).select("rep", "_j", likelihood_ratio_p(gain).alias("p"))


def rivals(rows: DataFrame, n_candidates: int, limit: float) -> DataFrame:
    """(rep, _j, _rivals): the candidates whose correlation with candidate _j is above ``limit`` in the training rows of a fold that hold both."""
    means = rows.agg(F.array(*[F.coalesce(F.avg(F.get("_x", i)), F.lit(0.0)) for i in range(n_candidates)]).alias("_m"))
    centred = attach(rows.select("_b", "_x"), means).select("_b", F.zip_with("_x", "_m", lambda v, m: v - m).alias("_x"))
    at = np.triu_indices(n_candidates, 1)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def partial(batches):
        held = {}

        def send():
            for b, v in held.items():
                yield pd.DataFrame({"_b": b, "_i": at[0], "_j": at[1], **dict(zip(names, v))})

        for batch in batches:
            x = np.asarray(batch["_x"].tolist(), float).reshape(len(batch), n_candidates)
            for b in batch["_b"].unique():
                mine = x[(batch["_b"] == b).to_numpy()]
                m = np.isfinite(mine).astype(float)
                mine = np.nan_to_num(mine)
                s, q = mine.T @ m, (mine * mine).T @ m
                v = np.stack([a[at] for a in (m.T @ m, s, s.T, q, q.T, mine.T @ mine)])
                held[b] = held[b] + v if b in held else v
            if len(held) > 64:
                yield from send()
                held = {}
        yield from send()

    sums = centred.mapInPandas(partial, "_b int, _i int, _j int, " + ", ".join(f"{c} double" for c in names)).groupBy("_b", "_i", "_j").agg(*[F.sum(c).alias(c) for c in names])
    pair = Window.partitionBy("_i", "_j")
    left = sums.select(F.col("_b").alias("rep"), "_i", "_j", *[(F.sum(c).over(pair) - F.col(c)).alias(c) for c in names])
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    under = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    alike = left.where((F.col("n") > 2) & (under > 0) & (F.abs(top) > limit * F.sqrt(under)))
    both = alike.select("rep", "_j", "_i").union(alike.select("rep", F.col("_i"), F.col("_j")))
    return both.groupBy("rep", "_j").agg(F.collect_set("_i").alias("_rivals"))


def chosen_by_fold(screen: DataFrame, alike: DataFrame, excluded: list[int], q_limit: float) -> DataFrame:
    """(rep, _chosen): candidates below ``q_limit`` by rising p, left out where a stronger chosen one is a rival; ``excluded`` ones count for q only."""
    none = F.array().cast("array<int>")
    q = benjamini_hochberg(screen, ["rep"], "p", "q").where(F.col("q") < q_limit)
    if excluded:
        q = q.where(~F.col("_j").isin(excluded))
    listed = q.join(alike, ["rep", "_j"], "left").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("p", "_j", F.coalesce("_rivals", none).alias("r")))).alias("_e"))
    pick = F.aggregate("_e", none, lambda so_far, e: F.when(F.arrays_overlap(so_far, e["r"]), so_far).otherwise(F.concat(so_far, F.array(e["_j"]))))
    return listed.select("rep", pick.alias("_chosen"))


# ---------------------------------------------------------------- predictions
def fold_models(rows: DataFrame, picks: DataFrame, blocks: DataFrame, n_blocks: int, n_adjust: int, part_rows: int) -> DataFrame:
    """(_set, rep, coef, _mean, _scale, _fill): the leave-one-block-out fits of every distinct set of candidates in ``picks`` (_set: sorted numbers).

    Rows are copied once for each distinct set, whatever number of folds chose it. _fill is the z-score of the training means.
    """
    base = [f"_a{i}" for i in range(n_adjust)]
    sizes = sorted({0, *[r[0] for r in picks.select(F.size("_set")).distinct().collect()]})  # at most one number more than candidates
    out = []
    for m in sizes:
        sets = picks.where(F.size("_set") == m).agg(F.collect_set("_set").alias("_sets"))
        if m == 0:
            sets = sets.select(F.array(F.array().cast("array<int>")).alias("_sets"))
        each = attach(rows.select("_block", "_y", "_x", *[F.get("_a", i).alias(a) for i, a in enumerate(base)]), sets).withColumn("_set", F.explode("_sets"))
        each = each.select("_block", "_y", F.concat_ws(",", F.transform("_set", lambda i: i.cast("string"))).alias("_set"), *base, *[F.get("_x", F.get("_set", i)).alias(f"_x{i}") for i in range(m)])
        columns = [*[f"_x{i}" for i in range(m)], *base]
        enough, parts, facts = model_parts(each, ["_set"], columns, "_block", "_y", blocks, part_rows)
        draws = fits_of_parts(parts, facts, ["_set"], len(columns), n_blocks, n_blocks, None).where("rep >= 0")
        z = [F.sum(F.col("trials") * (F.get("_x", i) - F.get("_mean", i)) / F.get("_scale", i)) for i in range(len(columns))]
        own = enough.join(facts, "_set").groupBy("_set", F.col("_b").alias("rep")).agg(F.sum("trials").alias("_n"), F.array(*z).alias("_own"))
        d = draws.join(facts.select("_set", "_mean", "_scale", "n_rows"), "_set").join(own, ["_set", "rep"], "left")
        left = F.nullif(F.col("n_rows") - F.coalesce("_n", F.lit(0)), F.lit(0))
        fill = F.coalesce(F.transform("_own", lambda v: -v / left), F.transform("_mean", lambda v: F.lit(0.0)))  # z-scores of all rows sum to zero
        out.append(d.select("_set", "rep", "coef", "_mean", "_scale", fill.alias("_fill")))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return stage_table(whole)


def _chance(x: Column, model: str, fill: bool) -> Column:
    z = F.zip_with(x, F.arrays_zip(F.col(f"{model}._mean").alias("m"), F.col(f"{model}._scale").alias("s"), F.col(f"{model}._fill").alias("f")),
                   lambda v, k: F.coalesce((v - k["m"]) / k["s"], k["f"]) if fill else (v - k["m"]) / k["s"])
    slopes = F.expr(f"slice({model}.coef, 2, size({model}.coef) - 1)")
    eta = F.get(F.col(f"{model}.coef"), 0) + F.aggregate(F.zip_with(z, slopes, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return 1 / (1 + F.exp(-eta))


def nested_predictions(rs: DataFrame, candidates: list[str], adjust: list[str], block: str, row_id: Column, select: bool = True, q_limit: float = 0.05, r_limit: float = 0.8,
                       split: Column | None = None, excluded: list[str] | None = None, missing: str = "mean", keep: list[str] | None = None, y: str = "terminates", part_rows: int = PART_ROWS) -> DataFrame:
    """Out-of-block predictions: selection, scaling and fit use the other blocks only, for risk sets of any size.

    Rows (row_id, keep, fold, y, p_adjust, p_full, p_climatology, chosen). Missing candidates cost no row in training: each is screened on the rows
    that hold it, and a model is fitted on the rows that hold what it uses. A missing value of a predicted row counts as its training mean, or
    with ``missing="null"`` its prediction is null. ``select=False`` uses all candidates; ``excluded`` ones are screened and count for the
    false-discovery control but are never chosen (a diagnostic among them); ``split`` is a condition for one training period (true) that predicts the rest.
    Rows without a block, outcome or adjustment value take no part; a fold whose training rows have one class predicts nulls.
    """
    keep, excluded = keep or [], excluded or []
    if split is not None:
        rs, block = rs.withColumn("_period", F.when(split, -1).when(~split, 0)), "_period"
    known = lambda c: F.when(F.abs(F.col(c).cast("double")) < F.lit(math.inf), F.col(c).cast("double"))
    base = [known(c) for c in adjust] or [F.lit(0.0)]
    rows = rs.select(row_id.cast("string").alias("row_id"), *keep, F.col(block).alias("_block"), F.col(y).cast("double").alias("_y"),
                     F.array(*[known(c) for c in candidates]).cast("array<double>").alias("_x"), F.array(*base).alias("_a"))
    rows = rows.where("_block IS NOT NULL AND _y IS NOT NULL AND NOT exists(_a, v -> v IS NULL)")
    blocks = stage_table(block_numbers(rows, "_block"))
    n_blocks = blocks.count()
    rows = stage_table(rows.join(blocks, "_block"))
    folds = blocks.where("_block = 0") if split is not None else blocks
    if select and candidates:
        found = chosen_by_fold(screened(rows, blocks, n_blocks, len(base), part_rows), rivals(rows, len(candidates), r_limit), [candidates.index(c) for c in excluded], q_limit)
        picks = folds.join(found, folds["_b"] == found["rep"], "left").select("_b", F.coalesce("_chosen", F.array().cast("array<int>")).alias("_chosen"))
    else:
        picks = folds.select("_b", F.array(*[F.lit(i) for i, c in enumerate(candidates) if c not in excluded]).cast("array<int>").alias("_chosen"))
    picks = stage_table(picks.withColumn("_set", F.sort_array("_chosen")))
    models = fold_models(rows, picks, blocks, n_blocks, len(base), part_rows)
    packed = F.struct("coef", "_mean", "_scale", "_fill")
    full = models.select(F.col("_set").alias("_name"), F.col("rep").alias("_b"), packed.alias("_full"))
    less = models.where("_set = ''").select(F.col("rep").alias("_b"), packed.alias("_less"))
    whole = Window.partitionBy(F.lit(1))  # one row for each block
    rate = rows.groupBy("_b").agg(F.sum("_y").alias("_s"), F.count(F.lit(1)).alias("_n")).select(
        "_b", ((F.sum("_s").over(whole) - F.col("_s")) / F.nullif(F.sum("_n").over(whole) - F.col("_n"), F.lit(0))).alias("p_climatology"))
    table = picks.withColumn("_name", F.concat_ws(",", F.transform("_set", lambda i: i.cast("string")))).join(full, ["_name", "_b"], "left").join(less, "_b", "left").join(rate, "_b")
    d = rows.join(stage_table(table), "_b")
    x = F.concat(F.transform("_set", lambda i: F.get("_x", i)), "_a")
    names = F.array(*[F.lit(c) for c in candidates]).cast("array<string>")
    return d.select("row_id", *keep, F.col("_block").alias("fold"), F.col("_y").alias("y"), _chance(F.col("_a"), "_less", False).alias("p_adjust"), _chance(x, "_full", missing == "mean").alias("p_full"),
                    "p_climatology", F.transform("_chosen", lambda i: F.get(names, i)).alias("chosen"))


def selection_frequency(pred: DataFrame, candidates: list[str]) -> DataFrame:
    """Share of folds that picked each candidate, zero included."""
    f = pred.select("fold", "chosen").distinct()
    named = f.select("fold", F.explode(F.array(*[F.lit(c) for c in candidates])).alias("predictor"), "chosen")
    c = named.groupBy("predictor").agg(F.count_if(F.array_contains("chosen", F.col("predictor"))).alias("times_chosen"), F.count(F.lit(1)).alias("folds"))
    return c.withColumn("share", F.col("times_chosen") / F.col("folds"))


# ---------------------------------------------------------------- intervals of scores
def order_counts(p: DataFrame, keys: list[str], value: str, n_blocks: int) -> DataFrame:
    """(keys, _a, _c, _w): for each pair of blocks, how often a positive row of block _a lies above a negative row of block _c by ``value``, ties as halves.

    Values are cut into ranges; a range counts its own rows, and what lies in earlier ranges comes from their totals.
    """
    cut = _ranges(p.groupBy(*keys, value, "_b").agg(F.sum("y").alias("_pos"), F.sum(1 - F.col("y")).alias("_neg")), keys, value)
    kinds = dict(cut.dtypes)
    at = [*keys, "_range"]

    def inside(table: pa.Table) -> pa.Table:
        u, row = np.unique(table[value].to_numpy(), return_inverse=True)
        order = np.argsort(row, kind="stable")
        row, b, pos, neg = row[order], table["_b"].to_numpy()[order], table["_pos"].to_numpy()[order], table["_neg"].to_numpy()[order]
        carried, m = np.zeros(n_blocks), np.zeros((n_blocks, n_blocks))
        step = 8192
        for lo in range(0, len(u), step):
            i, j = np.searchsorted(row, [lo, lo + step])
            cells = np.zeros((2, min(step, len(u) - lo), n_blocks))
            for cell, v in zip(cells, (pos, neg)):
                np.add.at(cell, (row[i:j] - lo, b[i:j]), v[i:j])
            so_far = carried + np.cumsum(cells[1], axis=0)
            m += cells[0].T @ (so_far - cells[1] / 2)
            carried = so_far[-1]
        first = table.slice(0, 1).select(at).take(pa.array([0] * n_blocks))
        for name, v in (("_a", pa.array(range(n_blocks), pa.int32())), ("_pos", pa.array(np.bincount(b, pos, n_blocks))), ("_neg", pa.array(carried)), ("_in", pa.array(m.tolist(), pa.list_(pa.float64())))):
            first = first.append_column(name, v)
        return first

    ranges = stage_table(cut.groupBy(*at).applyInArrow(inside, "".join(f"`{c}` {kinds[c]}, " for c in at) + "_a int, _pos double, _neg double, _in array<double>"))
    earlier = Window.partitionBy(*keys, "_a").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    off = ranges.select(*at, "_a", F.coalesce(F.sum("_neg").over(earlier), F.lit(0.0)).alias("_off"))
    off = off.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("_a", "_off"))).alias("_s")).select(*at, F.col("_s._off").alias("_off"))
    j = ranges.join(off, at).select(*keys, "_a", F.posexplode(F.zip_with("_in", F.transform("_off", lambda n: F.col("_pos") * n), lambda a, c: a + c)).alias("_c", "_w"))
    return j.groupBy(*keys, "_a", "_c").agg(F.sum("_w").alias("_w"))


def score_intervals(pred: DataFrame, keys: list[str], block: str, reps: int = 10_000, seed: int = 42, part_rows: int = PART_ROWS) -> DataFrame:
    """Block intervals of AUC and Brier differences (full less adjustment) and the calibration slope, for any number of predictions.

    The AUC under block weights is a ratio of forms in the weights: a replicate needs the counts of ordered pairs between blocks alone, and
    the Brier difference sums by block. A key holds two block x block tables. Rows without a prediction take no part; replicates with
    one class are left out of the AUC interval.
    """
    blocks = stage_table(block_numbers(pred, block))
    n_blocks = blocks.count()
    for c in ("y", "p_adjust", "p_full"):
        pred = pred.where(F.col(c).isNotNull())
    p = stage_table(pred.select(*keys, F.col(block).alias("_block"), "y", "p_adjust", "p_full").join(blocks, "_block"))
    gap = F.pow(F.col("y") - F.col("p_full"), 2) - F.pow(F.col("y") - F.col("p_adjust"), 2)
    sums = p.groupBy(*keys, "_b").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(gap).alias("gap"))
    state = sums.groupBy(*keys).agg(F.collect_list(F.struct("_b", "pos", "n", "gap")).alias("_s"))
    for c, out in (("p_adjust", "_m_adjust"), ("p_full", "_m_full")):
        state = state.join(order_counts(p, keys, c, n_blocks).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_a", "_c", "_w"))).alias(out)), keys)

    @F.pandas_udf("auc_diff_ci_low double, auc_diff_ci_high double, brier_diff_ci_low double, brier_diff_ci_high double")
    def run(b: pd.Series, pos: pd.Series, n: pd.Series, gap_: pd.Series, less: pd.Series, more: pd.Series) -> pd.DataFrame:
        out = []
        for b_, *v in zip(b, pos, n, gap_, less, more):
            sums_ = np.zeros((3, n_blocks))
            sums_[:, np.asarray(b_)] = np.stack([np.asarray(x, float) for x in v[:3]])
            m = (np.asarray(v[4], float) - np.asarray(v[3], float)).reshape(n_blocks, n_blocks)
            da, db = [], []
            for lo in range(0, reps, CHUNK):
                w = weights_of(np.arange(lo, min(reps, lo + CHUNK)), n_blocks, seed)
                s, t, g = (w @ sums_.T).T
                with np.errstate(invalid="ignore", divide="ignore"):
                    da.append(np.where(s * (t - s) > 0, ((w @ m) * w).sum(axis=1) / (s * (t - s)), np.nan))
                    db.append(np.where(t > 0, g / t, np.nan))
            line = []
            for d in (np.concatenate(da), np.concatenate(db)):
                d = d[np.isfinite(d)]
                line += np.percentile(d, [2.5, 97.5]).tolist() if len(d) else [None, None]
            out.append(line)
        return pd.DataFrame(out, columns=["auc_diff_ci_low", "auc_diff_ci_high", "brier_diff_ci_low", "brier_diff_ci_high"], dtype=float)

    limits = state.select(*keys, run("_s._b", "_s.pos", "_s.n", "_s.gap", "_m_adjust._w", "_m_full._w").alias("_r")).select(*keys, "_r.*")
    held = F.least(F.greatest("p_full", F.lit(1e-9)), F.lit(1 - 1e-9))
    _, parts, facts = model_parts(p.withColumn("_lp", F.log(held / (1 - held))), keys, ["_lp"], "_block", "y", blocks, part_rows)
    slope = fits_of_parts(parts, facts, keys, 1, n_blocks, 0, seed).where("rep = -1").join(facts, keys).select(*keys, (F.get("coef", 1) / F.get("_scale", 0)).alias("calibration_slope"))
    return limits.join(slope, keys, "left")
