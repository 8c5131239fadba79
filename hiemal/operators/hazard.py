"""Discrete-time hazard models of event termination.

Replicated fits (predictors x replicates) of models of any size are in ``replicates``: a model's rows become sufficient rows, cut
into parts, and every Newton pass of a model with several parts sums gradients and curvatures over them. ``fit_large`` and
``fit_replicates_large`` give coefficients alone, from the rows as they are. Out-of-block predictions are in ``validation``.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.single import attach
from .replicates import PART_ROWS, block_numbers, grouped_fits, replicate_fits
from .resample import benjamini_hochberg, p_from_tails
from ..plans.ordered import tie_totals


# ---------------------------------------------------------------- risk sets
def risk_set(cat: DataFrame, cov: DataFrame, predictors: list[str], adjust: list[str], k0: int = 3, lead: int = 0, keep: list[str] | None = None) -> DataFrame:
    """One row per event day k >= k0: outcome (last day), log age and covariates.

    With ``lead`` the predictors come from ``lead`` days earlier on the calendar and the adjustment
    columns from the same day.
    """
    rows = cat.filter(F.col("duration_days") >= k0).select(
        "event_id", "season", *(keep or []), "start_date", "end_date", F.col("duration_days").alias("_d"), F.explode(F.sequence(F.lit(k0), F.col("duration_days").cast("int"))).alias("event_age"))
    rows = rows.select("event_id", "season", *(keep or []), "start_date", "end_date", "event_age", F.log("event_age").alias("log_age"),
                       F.date_add("start_date", F.col("event_age") - 1).alias("date"), (F.col("event_age") == F.col("_d")).cast("int").alias("terminates"))
    same = cov.select("date", *adjust, *([] if lead else predictors))
    rows = rows.join(same, "date", "left")
    if lead:
        rows = rows.join(cov.select(F.date_add("date", lead).alias("date"), *predictors), "date", "left")
    return rows


def censor_season_end(rs: DataFrame, mode: str = "censor", last_month: int = 2, first_day: tuple[int, int] = (12, 1)) -> DataFrame:
    """Treatment of events whose last day ends the season.

    censor: keep the row with outcome 0; none: leave it; drop_final: drop that row;
    drop_left_truncated: also leave out events that start on the first day of the season.
    """
    at_end = (F.month("end_date") == last_month) & (F.month(F.date_add("end_date", 1)) != last_month)
    final = at_end & (F.col("date") == F.col("end_date"))
    if mode == "none":
        return rs
    if mode == "drop_final":
        return rs.filter(~final)
    out = rs.withColumn("terminates", F.when(final, 0).otherwise(F.col("terminates")))
    if mode == "drop_left_truncated":
        out = out.filter(~((F.month("start_date") == first_day[0]) & (F.dayofmonth("start_date") == first_day[1])))
    return out


def standardise(rs: DataFrame, columns: list[str], training: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """z-scores with the sample SD of all rows or of the training rows only."""
    keys = keys or []
    t = rs.filter(training) if training is not None else rs
    s = t.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    if keys:
        j = rs.join(s, keys)
    else:
        j = attach(rs, s)
    for c in columns:
        j = j.withColumn(f"{c}_z", (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") != 0, F.col(f"_s_{c}"))).drop(f"_m_{c}", f"_s_{c}")
    return j


# ---------------------------------------------------------------- numerical core
def logistic_fits(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 60, tol: float = 1e-10):
    """Weighted logistic fits of one design under many weight rows at once, as grouped binomial scoring.

    Equal design rows are merged first; a weight row then only sees trials and events of each distinct row. Scoring steps
    are shortened so that no linear predictor moves by more than 5. Returns (coefficients with the intercept first,
    converged). Weight rows whose outcome has one class are undefined (NaN); separated ones end unconverged.
    """
    design, row = np.unique(np.column_stack([np.ones(len(y)), x]), axis=0, return_inverse=True)
    order = np.argsort(row.ravel(), kind="stable")
    firsts = np.searchsorted(row.ravel()[order], np.arange(len(design)))
    merged = lambda v: np.add.reduceat(v[:, order], firsts, axis=1)
    trials, events = merged(w), merged(w * y)
    return grouped_fits(design, trials, events, steps, tol)


# ---------------------------------------------------------------- replicated models
def odds_ratios(rs: DataFrame, models: list[tuple[str, str]], adjust: list[str], block: str, reps: int = 10_000, seed: int = 42, keys: list[str] | None = None,
                y: str = "terminates", part_rows: int = PART_ROWS) -> DataFrame:
    """Odds ratio per SD of each (family, predictor), block interval and plus-one p, for risk sets of any size.

    ``keys`` adds group columns of the risk set (variants, catalogues), so that every variant of
    every predictor is one job. The plan is drawn on the blocks of the full set.
    """
    k = [*(keys or []), "family", "predictor"]
    draws, facts = replicate_fits(model_rows(rs, models, adjust, block, keys, y), k, ["_x1", *adjust], block, reps, seed, y, block_numbers(rs, block), part_rows)
    d = draws.withColumn("_b", F.get("coef", 1))
    rep = F.col("rep") >= 0
    g = d.groupBy(*k).agg(
        F.max(F.when(~rep, F.col("_b"))).alias("_o"), F.percentile(F.when(rep, F.col("_b")), 0.025).alias("_l"), F.percentile(F.when(rep, F.col("_b")), 0.975).alias("_h"),
        F.count(F.when(rep, F.col("_b"))).alias("n_boot_valid"), F.count_if(rep & F.col("_b").isNotNull() & ~F.col("converged")).alias("n_not_converged"),
        F.count_if(rep & (F.col("_b") <= 0)).alias("_le"), F.count_if(rep & (F.col("_b") >= 0)).alias("_ge"))
    return facts.join(g, k).select(*k, "n_rows", "n_terminations", F.exp("_o").alias("odds_ratio_per_sd"), F.exp("_l").alias("ci_low"), F.exp("_h").alias("ci_high"),
                                   p_from_tails(F.col("_le"), F.col("_ge"), F.col("n_boot_valid")).alias("p_bootstrap"), "n_boot_valid", "n_not_converged",
                                   ((F.col("_l") > 0) | (F.col("_h") < 0)).alias("ci_excludes_one"))


def model_rows(rs: DataFrame, models: list[tuple[str, str]], adjust: list[str], block: str, keys: list[str] | None = None, y: str = "terminates") -> DataFrame:
    """The risk set once for each (family, predictor), with the predictor in ``_x1``."""
    spec = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(p).alias("predictor"), F.col(p).cast("double").alias("_x1")) for f, p in models])
    return rs.select(*(keys or []), block, y, *adjust, F.inline(spec))


def family_scan(rs: DataFrame, models: list[tuple[str, str]], adjust: list[str], block: str, reps: int = 10_000, seed: int = 42) -> DataFrame:
    """Odds ratios of all predictors with q-values within families and over all of them."""
    o = odds_ratios(rs, models, adjust, block, reps, seed)
    return benjamini_hochberg(benjamini_hochberg(o, ["family"], "p_bootstrap", "q_family"), [], "p_bootstrap", "q_all")


def leave_block_out_ratios(rs: DataFrame, models: list[tuple[str, str]], adjust: list[str], block: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Odds ratios with each block left out and their sign stability, as 0/1 weights."""
    k = ["family", "predictor"]
    draws, _ = replicate_fits(model_rows(rs, models, adjust, block), k, ["_x1", *adjust], block, None, None, blocks=block_numbers(rs, block), part_rows=part_rows)
    d = draws.withColumn("_b", F.get("coef", 1))
    full = d.filter("rep = -1").select("family", "predictor", F.col("_b").alias("_o"))
    return d.filter("rep >= 0").join(full, ["family", "predictor"]).groupBy("family", "predictor").agg(
        F.exp(F.max("_o")).alias("odds_ratio"), F.exp(F.min("_b")).alias("loo_low"), F.exp(F.max("_b")).alias("loo_high"),
        F.avg((F.signum("_b") == F.signum("_o")).cast("double")).alias("sign_stability"), F.count("_b").alias("block_count"))


def multivariable(rs: DataFrame, columns: list[str], block: str, reps: int = 10_000, seed: int = 42, part_rows: int = PART_ROWS) -> DataFrame:
    """One joint model: odds ratio, interval, p and variance inflation of every column."""
    d, _ = replicate_fits(rs.withColumn("_model", F.lit(1)), ["_model"], columns, block, reps, seed, blocks=block_numbers(rs, block), part_rows=part_rows)
    d = d.select("rep", F.posexplode("coef").alias("_i", "_b")).filter("_i > 0")
    rep = F.col("rep") >= 0
    g = d.groupBy("_i").agg(F.max(F.when(~rep, F.col("_b"))).alias("_o"), F.percentile(F.when(rep, F.col("_b")), 0.025).alias("_l"), F.percentile(F.when(rep, F.col("_b")), 0.975).alias("_h"),
                            F.count_if(rep & (F.col("_b") <= 0)).alias("_le"), F.count_if(rep & (F.col("_b") >= 0)).alias("_ge"), F.count_if(rep).alias("n_boot_valid"))
    vif = variance_inflation(rs, columns)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_i"))
    return g.withColumn("predictor", name).join(vif, "predictor").select(
        "predictor", F.exp("_o").alias("odds_ratio_per_sd"), F.exp("_l").alias("ci_low"), F.exp("_h").alias("ci_high"), p_from_tails(F.col("_le"), F.col("_ge"), F.col("n_boot_valid")).alias("p_bootstrap"),
        "n_boot_valid", "vif")


def variance_inflation(rs: DataFrame, columns: list[str]) -> DataFrame:
    """Diagonal of the inverse correlation matrix; the matrix comes from one aggregate."""
    d = rs.dropna(subset=columns)
    row = d.agg(*[F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]).first() if len(columns) > 1 else None
    m = np.eye(len(columns))
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            m[i, j] = m[j, i] = row[f"{i}_{j}"]
    v = np.diag(np.linalg.inv(m))
    return rs.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(columns, v)], "predictor string, vif double")


# ---------------------------------------------------------------- large models
def fit_large(rs: DataFrame, columns: list[str], y: str = "terminates", weight: str | None = None) -> dict[str, float]:
    """One unpenalised weighted fit of any number of rows, by the built-in distributed learner."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    d = VectorAssembler(inputCols=columns, outputCol="_f").transform(rs.dropna(subset=[*columns, y]).withColumn("_y", F.col(y).cast("double")))
    lr = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=0.0, maxIter=200, tol=1e-12, standardization=False)
    m = (lr.setWeightCol(weight) if weight else lr).fit(d)
    return {"intercept": float(m.intercept), **{c: float(v) for c, v in zip(columns, m.coefficients)}}


def fit_replicates_large(rs: DataFrame, columns: list[str], block: str, plan: np.ndarray, blocks: list, y: str = "terminates", steps: int = 12, tol: float = 1e-8) -> np.ndarray:
    """All replicates of one large model: each Newton step is one pass over the rows.

    A task sums gradient and curvature of every replicate over its own rows; only those sums
    (replicates x k(k+3)/2 numbers) are shuffled and returned. Full steps are taken, which suits
    large well-conditioned sets.
    """
    k = len(columns) + 1
    iu = np.triu_indices(k)
    d = rs.dropna(subset=[*columns, y]).select(F.array_position(F.array(*[F.lit(b) for b in blocks]), F.col(block)).cast("int").alias("_b"), F.col(y).cast("double").alias("_y"), *columns)
    beta = np.zeros((len(plan), k))
    for _ in range(steps):
        at = beta.copy()

        def part(batches):
            total = np.zeros((len(at), k + len(iu[0])))
            for pdf in batches:
                for s in range(0, len(pdf), 2048):
                    q = pdf.iloc[s:s + 2048]
                    x = np.column_stack([np.ones(len(q)), q[columns].to_numpy(float)])
                    w = plan[:, q["_b"].to_numpy() - 1]
                    mu = 1.0 / (1.0 + np.exp(-np.clip(at @ x.T, -700, 700)))
                    total[:, :k] += (w * (q["_y"].to_numpy() - mu)) @ x
                    total[:, k:] += (w * mu * (1 - mu)) @ (x[:, iu[0]] * x[:, iu[1]])
            yield pd.DataFrame({"rep": np.arange(len(at)), "v": list(total)})

        sums = d.mapInPandas(part, "rep int, v array<double>").groupBy("rep").agg(F.array(*[F.sum(F.get("v", i)) for i in range(k + len(iu[0]))]).alias("v"))
        v = np.zeros((len(plan), k + len(iu[0])))
        for r in sums.collect():
            v[r["rep"]] = r["v"]
        h = np.zeros((len(plan), k, k))
        h[:, iu[0], iu[1]] = v[:, k:]
        h[:, iu[1], iu[0]] = v[:, k:]
        move = np.linalg.solve(h + 1e-10 * np.eye(k), v[:, :k, None])[..., 0]
        beta += move
        if np.abs(move).max() < tol:
            break
    return beta


# ---------------------------------------------------------------- validation
def auc(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Area under the curve from distributed average ranks."""
    d = df.withColumn("_y", F.col(y).cast("double"))
    t = tie_totals(d, keys, p, weights={"pos": "_y"})
    mid = F.col("n_before") + (F.col("n") + 1) / 2
    g = t.groupBy(*keys).agg(F.sum(F.col("pos") * mid).alias("_r"), F.max("pos_family").alias("_p"), F.max("n_family").alias("_n"))
    neg = F.col("_n") - F.col("_p")
    return g.select(*keys, F.when((F.col("_p") > 0) & (neg > 0), (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * neg)).alias("auc"))


def scores(pred: DataFrame, keys: list[str]) -> DataFrame:
    """AUC, Brier, skill against the training rate and observed over expected, for both models."""
    sq = lambda c: F.avg(F.pow(F.col("y") - F.col(c), 2))
    g = pred.groupBy(*keys).agg(sq("p_adjust").alias("brier_adjust"), sq("p_full").alias("brier_full"), sq("p_climatology").alias("brier_climatology"),
                                (F.sum("y") / F.sum("p_full")).alias("observed_over_expected"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("skill", 1 - F.col("brier_full") / F.col("brier_climatology"))
    a = auc(pred, keys, "y", "p_adjust").withColumnRenamed("auc", "auc_adjust").join(auc(pred, keys, "y", "p_full").withColumnRenamed("auc", "auc_full"), keys)
    return g.join(a, keys).withColumn("auc_difference", F.col("auc_full") - F.col("auc_adjust"))


def direction_agreement(variants: DataFrame, primary: str, variant: str = "variant") -> DataFrame:
    """Whether each variant's estimate points the same way as the primary one."""
    p = variants.filter(F.col(variant) == primary).select("family", "predictor", F.signum(F.log("odds_ratio_per_sd")).alias("_p"))
    return variants.join(p, ["family", "predictor"]).withColumn("same_direction", F.signum(F.log("odds_ratio_per_sd")) == F.col("_p")).drop("_p")
