"""Replicated logistic fits of models with any number of rows.

A model's rows become sufficient rows first: one for each distinct design row and block, with its trials and events. They are cut into
parts of about ``part_rows``. A model of one part is fitted where its part lies. Larger models keep a state table, one row for each model and
chunk of replicates; every Newton pass joins parts with states, sums gradients and curvatures over the parts, and moves the states that
haven't settled. The resampling plan is made in the tasks from its seed and never travels.
"""
from __future__ import annotations

import hashlib
import sys
import types

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import stage_table

#: Sufficient rows of one part, and replicates of one state row.
PART_ROWS, CHUNK = 8192, 1000
STEPS, TOLERANCE, REACH, RIDGE = 60, 1e-10, 5.0, 1e-10


# ---------------------------------------------------------------- plans made in tasks
def kept(key, build):
    """``build()`` once in a Python worker, kept between its tasks; at most 64 results are held."""
    host = sys.modules.setdefault("_hiemal_plans", types.ModuleType("_hiemal_plans")).__dict__.setdefault("held", {})
    if key not in host:
        if len(host) >= 64:
            host.clear()
        host[key] = build()
    return host[key]


def drawn(n_blocks: int, lo: int, hi: int, seed: int) -> np.ndarray:
    """Rows lo..hi-1 of the hash plan: how often each block is drawn; draw j of replicate r comes from md5("seed:r:j")."""
    def build():
        draws = np.array([[int(hashlib.md5(f"{seed}:{r}:{j}".encode()).hexdigest()[:8], 16) % n_blocks for j in range(n_blocks)] for r in range(lo, hi)], np.int64).reshape(hi - lo, n_blocks)
        out = np.zeros((hi - lo, n_blocks), np.int32)
        np.add.at(out, (np.arange(hi - lo)[:, None], draws), 1)
        return out

    return kept(("drawn", n_blocks, lo, hi, seed), build)


def weights_of(replicates: np.ndarray, n_blocks: int, seed: int | None) -> np.ndarray:
    """Weights (replicates x blocks): ones for replicate -1, else a draw, or all blocks but one if ``seed`` is None."""
    out = np.ones((len(replicates), n_blocks))
    some = replicates >= 0
    if seed is None:
        out[np.flatnonzero(some), replicates[some]] = 0
    elif some.any():
        lo, hi = int(replicates[some].min()), int(replicates.max()) + 1
        out[some] = drawn(n_blocks, lo, hi, seed)[replicates[some] - lo]
    return out


def replicates_of(chunk: int, reps: int, size: int) -> np.ndarray:
    """The replicates of a chunk; the first chunk has the fit to the data, -1, as well."""
    rows = np.arange(chunk * size, min(reps, (chunk + 1) * size))
    return np.concatenate([[-1], rows]) if chunk == 0 else rows


# ---------------------------------------------------------------- numerical core
def sums_at(design: np.ndarray, trials: np.ndarray, events: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, curvature) of each weight row (rows of ``trials`` and ``events``) at its own coefficients."""
    k = design.shape[1]
    share = 1.0 / (1.0 + np.exp(-np.clip(beta @ design.T, -700, 700)))
    gradient = (events - trials * share) @ design
    spread = trials * share * (1 - share)
    curvature = np.stack([np.stack([spread @ (design[:, i] * design[:, j]) for j in range(k)], 1) for i in range(k)], 1)
    return gradient, curvature


def newton_step(gradient: np.ndarray, curvature: np.ndarray, reach) -> np.ndarray:
    """Steps, shortened where ``reach(step)``, a bound of how far a linear predictor moves, is above REACH."""
    k = gradient.shape[1]
    step = np.linalg.solve(curvature + RIDGE * np.eye(k), gradient[:, :, None])[:, :, 0]
    return step * np.minimum(1.0, REACH / np.maximum(reach(step), 1e-300))[:, None]


def grouped_fits(design: np.ndarray, trials: np.ndarray, events: np.ndarray, steps: int = STEPS, tol: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, converged) of every weight row; those whose outcome has one class are undefined (NaN), separated ones end unconverged."""
    beta, done = np.full((len(trials), design.shape[1]), np.nan), np.zeros(len(trials), bool)
    hits = events.sum(axis=1)
    active = np.flatnonzero((hits > 0) & (hits < trials.sum(axis=1)))
    beta[active] = 0.0
    for _ in range(steps):
        if not len(active):
            break
        step = newton_step(*sums_at(design, trials[active], events[active], beta[active]), lambda s: np.abs(s @ design.T).max(axis=1))
        beta[active] += step
        over = np.abs(step).max(axis=1) < tol
        done[active[over]] = True
        active = active[~over]
    return beta, done


# ---------------------------------------------------------------- sufficient rows
def sufficient_rows(df: DataFrame, keys: list[str], columns: list[str], block: str, y: str) -> DataFrame:
    """(keys, _block, _x, trials, events): the distinct design rows of every model and block, reduced inside the map tasks.

    Rows without a block, outcome or design value are left out.
    """
    for c in (block, y, *columns):
        df = df.where(F.col(c).isNotNull())
    x = F.array(*[F.col(c).cast("double") for c in columns])
    return df.groupBy(*keys, F.col(block).alias("_block"), x.alias("_x")).agg(F.count(F.lit(1)).alias("trials"), F.sum(F.col(y).cast("double")).alias("events"))


def block_numbers(df: DataFrame, block: str) -> DataFrame:
    """(_block, _b): the distinct blocks in order, numbered from 0; one row per block (a season)."""
    blocks = df.where(F.col(block).isNotNull()).select(F.col(block).alias("_block")).distinct()
    return blocks.withColumn("_b", F.row_number().over(Window.orderBy("_block")) - 1)


def parts_of(rows: DataFrame, keys: list[str], k: int, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """(parts, facts): packed parts of the standardised sufficient rows, and (keys, n_rows, n_terminations, _parts, _far) of each model.

    ``rows`` has (keys, _b, _x, trials, events). Columns get z-scores with the sample SD of the model's rows; one without spread stays centred.
    A part holds about ``part_rows`` rows, dealt by their hash.
    """
    x = [F.col("_x")[i] for i in range(k)]
    first = rows.groupBy(*keys).agg(F.sum("trials").alias("n_rows"), F.sum("events").cast("int").alias("n_terminations"), F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_parts"),
                                    F.array(*[F.sum(F.col("trials") * c) / F.sum("trials") for c in x]).alias("_mean"))
    rows = rows.join(first, keys)
    gap = [c - F.col("_mean")[i] for i, c in enumerate(x)]
    second = rows.groupBy(*keys).agg(*[F.sqrt(F.sum(F.col("trials") * g * g) / F.nullif(F.sum("trials") - 1, F.lit(0))).alias(f"_s{i}") for i, g in enumerate(gap)],
                                     *[F.max(F.abs(g)).alias(f"_f{i}") for i, g in enumerate(gap)])
    scale = [F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(F.lit(1.0)) for i in range(k)]
    second = second.select(*keys, F.array(*scale).alias("_scale"), F.array(*[F.col(f"_f{i}") / s for i, s in enumerate(scale)]).alias("_far"))
    facts = stage_table(first.join(second, keys))
    z = F.transform("_x", lambda v, i: (v - F.get("_mean", i)) / F.get("_scale", i))
    rows = rows.select(*keys, "_b", "_x", "trials", "events").join(facts, keys)
    rows = rows.select(*keys, "_parts", F.pmod(F.xxhash64("_x", "_b"), F.col("_parts")).cast("int").alias("_p"), F.struct(F.col("_b").alias("b"), F.col("trials").cast("double").alias("n"), F.col("events").alias("s"), z.alias("z")).alias("_e"))
    packed = rows.groupBy(*keys, "_parts", "_p").agg(F.sort_array(F.collect_list("_e")).alias("_d"))
    parts = packed.select(*keys, "_parts", "_p", F.col("_d.b").alias("b"), F.col("_d.n").alias("n"), F.col("_d.s").alias("s"), F.flatten(F.col("_d.z")).alias("z"))
    return stage_table(parts), facts


def with_intercept(z, k: int) -> np.ndarray:
    z = np.asarray(z, float).reshape(-1, k)
    return np.column_stack([np.ones(len(z)), z])


_DRAW = "array<struct<rep: int, coef: array<double>, converged: boolean>>"


def draw_list(replicates, coef, converged) -> list[dict]:
    return [{"rep": int(r), "coef": None if np.isnan(c).any() else c.tolist(), "converged": bool(v)} for r, c, v in zip(replicates, coef, converged)]


def fits_of_one_part(parts: DataFrame, keys: list[str], k: int, n_blocks: int, reps: int, seed: int | None, chunk: int) -> DataFrame:
    """Fits of models whose part is the whole; each (model, chunk of replicates) is one row."""
    @F.pandas_udf(_DRAW)
    def fit(b: pd.Series, n: pd.Series, s: pd.Series, z: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for b_, n_, s_, z_, c_ in zip(b, n, s, z, c):
            design, row = np.unique(with_intercept(z_, k), axis=0, return_inverse=True)
            cells = [np.zeros((n_blocks, len(design))) for _ in range(2)]
            for cell, v in zip(cells, (n_, s_)):
                np.add.at(cell, (np.asarray(b_), row.ravel()), np.asarray(v, float))
            mine = replicates_of(int(c_), reps, chunk)
            w = weights_of(mine, n_blocks, seed)
            out.append(draw_list(mine, *grouped_fits(design, w @ cells[0], w @ cells[1])))
        return pd.Series(out)

    chunks = F.sequence(F.lit(0), F.lit(max(0, -(-reps // chunk) - 1)))
    rows = parts.withColumn("_c", F.explode(chunks)).repartition(*keys, "_c")
    return rows.select(*keys, F.inline(fit("b", "n", "s", "z", "_c")))


ACTIVE, SETTLED, UNDEFINED, STOPPED = range(4)


def fits_of_many_parts(parts: DataFrame, facts: DataFrame, keys: list[str], k: int, n_blocks: int, reps: int, seed: int | None, chunk: int) -> DataFrame:
    """Fits of models with several parts, by Newton passes over all of them.

    A pass sends each (part, state) pair to a task; what is summed is one vector of (k + 1)(k + 4) / 2 numbers a replicate, and pairs
    of a task are added up before the shuffle. Replicates that have settled drop out of the following passes.
    """
    kinds = dict(parts.dtypes)
    named = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    d = k + 1
    upper = np.triu_indices(d)
    width = d + len(upper[0]) + 2
    state_schema = f"{named}, _c int, _far array<double>, beta binary, status binary, active boolean"
    chunks = -(-reps // chunk) or 1

    def start(batches):
        for batch in batches:
            beta, status = [], []
            for c in batch.column("_c").to_pylist():
                n = len(replicates_of(c, reps, chunk))
                beta.append(np.zeros((n, d)).tobytes())
                status.append(np.full(n, ACTIVE, np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beta, pa.binary()), pa.array(status, pa.binary()), pa.array([True] * batch.num_rows)], [*batch.schema.names, "beta", "status", "active"])

    def partial(batches):
        held = {}  # sums of this task, at most one entry for each of its states

        def send(entries):
            rows = list(entries)
            yield pa.RecordBatch.from_arrays([*[pa.array([r[0][i] for r in rows], t) for i, t in enumerate(types_)], pa.array([r[1][0] for r in rows], pa.list_(pa.float64())),
                                              *[pa.array([r[1][j] for r in rows], pa.binary()) for j in (1, 2)], pa.array([r[1][3].tobytes() for r in rows], pa.binary())],
                                             [*keys, "_c", "_far", "beta", "status", "sums"])

        types_ = None
        for batch in batches:
            types_ = [batch.schema.field(c).type for c in (*keys, "_c")]
            for row in batch.to_pylist():
                status = np.frombuffer(row["status"], np.uint8)
                on = np.flatnonzero(status == ACTIVE)
                beta = np.frombuffer(row["beta"]).reshape(-1, d)[on]
                w = weights_of(replicates_of(row["_c"], reps, chunk)[on], n_blocks, seed)
                design, b = with_intercept(row["z"], k), np.asarray(row["b"])
                n, s = np.asarray(row["n"], float), np.asarray(row["s"], float)
                total = np.zeros((len(on), width))
                for i in range(0, len(on), 128):
                    mine = w[i:i + 128][:, b]
                    gradient, curvature = sums_at(design, mine * n, mine * s, beta[i:i + 128])
                    total[i:i + 128] = np.column_stack([gradient, curvature[:, upper[0], upper[1]], mine @ s, mine @ n])
                key = tuple(row[c] for c in (*keys, "_c"))
                if key in held:
                    held[key][3] += total
                else:
                    held[key] = [row["_far"], row["beta"], row["status"], total]
                if len(held) > 256:
                    yield from send(held.items())
                    held = {}
        if held:
            yield from send(held.items())

    def update(last: bool):
        def run(table: pa.Table) -> pa.Table:
            status = np.frombuffer(table["status"][0].as_py(), np.uint8).copy()
            beta = np.frombuffer(table["beta"][0].as_py()).reshape(-1, d).copy()
            on = np.flatnonzero(status == ACTIVE)
            total = sum(np.frombuffer(v.as_py()).reshape(len(on), width) for v in table["sums"])
            good = (total[:, -2] > 0) & (total[:, -2] < total[:, -1])
            status[on[~good]] = UNDEFINED
            on, total = on[good], total[good]
            if len(on):
                curvature = np.zeros((len(on), d, d))
                curvature[:, upper[0], upper[1]] = curvature[:, upper[1], upper[0]] = total[:, d:-2]
                far = np.array([1.0, *table["_far"][0].as_py()])
                step = newton_step(total[:, :d], curvature, lambda s: np.abs(s) @ far)
                beta[on] += step
                status[on[np.abs(step).max(axis=1) < TOLERANCE]] = SETTLED
                if last:
                    status[status == ACTIVE] = STOPPED
            one = table.slice(0, 1).select([*keys, "_c", "_far"])
            return one.append_column("beta", pa.array([beta.tobytes()], pa.binary())).append_column("status", pa.array([status.tobytes()], pa.binary())).append_column(
                "active", pa.array([bool((status == ACTIVE).any())]))
        return run

    states = facts.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_c"), "_far").mapInArrow(start, state_schema)
    states, ended = stage_table(states), []
    for i in range(STEPS):
        pairs = parts.select(*keys, "_p", "b", "n", "s", "z").join(states, keys).repartition(*keys, "_p", "_c")
        sums = pairs.mapInArrow(partial, f"{named}, _c int, _far array<double>, beta binary, status binary, sums binary")
        states = stage_table(sums.groupBy(*keys, "_c").applyInArrow(update(i == STEPS - 1), state_schema))
        ended.append(states.where("not active"))
        states = states.where("active")
        if states.isEmpty():
            break

    @F.pandas_udf(_DRAW)
    def draws(beta: pd.Series, status: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for b, s, c_ in zip(beta, status, c):
            s = np.frombuffer(s, np.uint8)
            coef = np.frombuffer(b).reshape(-1, d).copy()
            coef[s == UNDEFINED] = np.nan
            out.append(draw_list(replicates_of(int(c_), reps, chunk), coef, s == SETTLED))
        return pd.Series(out)

    whole = ended[0]
    for e in ended[1:]:
        whole = whole.unionByName(e)
    return whole.select(*keys, F.inline(draws("beta", "status", "_c")))


def model_parts(df: DataFrame, keys: list[str], columns: list[str], block: str, y: str, blocks: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, parts, facts) of every model, staged: its sufficient rows, ``parts_of`` them, and its facts. ``blocks`` has (_block, _b)."""
    rows = stage_table(sufficient_rows(df, keys, columns, block, y).join(blocks, "_block").select(*keys, "_b", "_x", "trials", "events"))
    return rows, *parts_of(rows, keys, len(columns), part_rows)


def fits_of_parts(parts: DataFrame, facts: DataFrame, keys: list[str], k: int, n_blocks: int, reps: int, seed: int | None, chunk: int = CHUNK) -> DataFrame:
    """(keys, rep, coef, converged): models of one part where it lies, larger ones by passes over their parts."""
    out = fits_of_one_part(parts.where("_parts = 1"), keys, k, n_blocks, reps, seed, chunk)
    large = facts.where("_parts > 1")
    if not large.isEmpty():
        out = out.unionByName(fits_of_many_parts(parts.where("_parts > 1"), large, keys, k, n_blocks, reps, seed, chunk))
    return out


def replicate_fits(df: DataFrame, keys: list[str], columns: list[str], block: str, reps: int | None, seed: int | None = 42, y: str = "terminates", blocks: DataFrame | None = None,
                   part_rows: int = PART_ROWS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(draws, facts) of every model, however many rows it has.

    draws has (keys, rep, coef, converged): replicate -1 is the fit to all rows, 0.. are ``reps`` block bootstrap replicates; with
    ``seed`` None there is one replicate for each block, which leaves that block out. The coefficients, intercept first, are per SD. facts has
    (keys, n_rows, n_terminations). ``blocks`` (block_numbers of the full set) fixes the drawn blocks.
    """
    blocks = stage_table(block_numbers(df, block) if blocks is None else blocks)
    n_blocks = blocks.count()
    _, parts, facts = model_parts(df, keys, columns, block, y, blocks, part_rows)
    return fits_of_parts(parts, facts, keys, len(columns), n_blocks, n_blocks if seed is None else reps, seed, chunk), facts.select(*keys, "n_rows", "n_terminations")
