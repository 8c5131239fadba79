"""Block-bootstrap intervals and permutation tests of (partial) rank correlations of any number of events.

The average rank of a value under block weights w is w . a(value) + 1/2, where a(value) holds for each block its events with a smaller
value and half of those with the same one. It is linear in the weights, so all that a replicate needs of a key are sums of products of such
vectors: one block x block matrix for each block and pair of columns, whatever the number of events. The vectors are prefix sums over
range-partitioned values; no task holds the events of a key.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..plans.ordered import average_rank, tie_totals
from ..session import stage_table
from .replicates import block_numbers, weights_of
from .resample import _RESULT, _summary, p_from_tails

#: Replicates of one Arrow row, and numbers that a task holds in sums before it sends them on.
CHUNK, HELD = 1000, 8_000_000
#: A permuted correlation this much below the observed one still counts as as large.
NOISE = 1e-9


def rank_vectors(rows: DataFrame, keys: list[str], columns: list[str], n_blocks: int) -> DataFrame:
    """``rows`` (staged, with _b and ``columns``) and for each column ``_a{i}``: events of each block below its value, ties as halves."""
    out = rows
    marks = rows.select(*keys, *columns, *[(F.col("_b") == i).cast("int").alias(f"_in{i}") for i in range(n_blocks)])
    for i, c in enumerate(columns):
        t = tie_totals(marks, keys, c, {f"_w{b}": f"_in{b}" for b in range(n_blocks)})
        vector = F.array(*[(F.col(f"_w{b}_before") + F.col(f"_w{b}") / 2).cast("double") for b in range(n_blocks)])
        out = out.join(t.select(*keys, c, vector.alias(f"_a{i}")), [*keys, c])
    return out


def moment_tensors(ranked: DataFrame, keys: list[str], k: int, n_blocks: int) -> DataFrame:
    """(keys, v): per key the counts of the blocks, the sums of the rank vectors by block, and of their products for each pair of columns."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    n = n_blocks
    size = n + k * n * n + len(pairs) * n ** 3
    kinds = dict(ranked.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keys) + "v binary"

    def add(total, b, a):
        counts, first, second = total[:n], total[n:n + k * n * n].reshape(k, n, n), total[n + k * n * n:].reshape(len(pairs), n, n, n)
        for c in np.unique(b):
            m = b == c
            counts[c] += m.sum()
            here = [x[m] for x in a]
            for i in range(k):
                first[i, c] += here[i].sum(0)
            for p, (i, j) in enumerate(pairs):
                second[p, c] += here[i].T @ here[j]

    def run(batches):
        held, kept_types = {}, None

        def send():
            names = list(held)
            return pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in names], t) for i, t in enumerate(kept_types)], pa.array([held[x].tobytes() for x in names], pa.binary())], [*keys, "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept_types = [batch.schema.field(c).type for c in keys]
            named = list(zip(*[batch.column(c).to_pylist() for c in keys])) if keys else [()] * batch.num_rows
            b = batch.column("_b").to_numpy()
            a = [np.asarray(batch.column(f"_a{i}").flatten()).reshape(-1, n) for i in range(k)]
            places: dict = {}
            for i, key in enumerate(named):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                if key not in held:
                    held[key] = np.zeros(size)
                add(held[key], b[at], [x[at] for x in a])
            if len(held) * size > HELD:
                yield send()
                held.clear()
        if held:
            yield send()

    def whole(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for v in table["v"]:
            total += np.frombuffer(v.as_py())
        return table.slice(0, 1).drop_columns(["v"]).append_column("v", pa.array([total.tobytes()], pa.binary()))

    parts = ranked.select(*keys, "_b", *[f"_a{i}" for i in range(k)]).mapInArrow(run, schema)
    return parts.groupBy(*keys).applyInArrow(whole, schema)


def covariances(v: np.ndarray, k: int, n: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total weights, covariance matrices of the weighted ranks) of each row of block weights."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    counts, first, second = v[:n], v[n:n + k * n * n].reshape(k, n, n), v[n + k * n * n:].reshape(len(pairs), n, n * n)
    total = w @ counts
    sums = [((w @ f) * w).sum(1) for f in first]
    out = np.zeros((len(w), k, k))
    with np.errstate(all="ignore"):
        means = [(s + total / 2) / total for s in sums]
        for p, (i, j) in enumerate(pairs):
            product = np.concatenate([np.einsum("rpq,rp,rq->r", (u @ second[p]).reshape(-1, n, n), u, u, optimize=True) for u in np.array_split(w, -(-len(w) * n * n // HELD) or 1)])
            out[:, i, j] = out[:, j, i] = (product + (sums[i] + sums[j]) / 2 + total / 4) / total - means[i] * means[j]
    return total, out


def partial_correlations(total: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Correlation of the first two columns given the others; undefined (NaN) with three events or fewer or without spread."""
    cov = cov.copy()
    ok = (total > 3) & np.isfinite(cov).all(axis=(1, 2))
    cov[~ok] = 0
    z = cov[:, :2, 2:]
    rest = cov[:, :2, :2] - z @ np.linalg.pinv(cov[:, 2:, 2:], hermitian=True) @ z.transpose(0, 2, 1) if cov.shape[1] > 2 else cov[:, :2, :2]
    x, y = rest[:, 0, 0], rest[:, 1, 1]
    ok &= (x > 1e-12 * cov[:, 0, 0]) & (y > 1e-12 * cov[:, 1, 1])
    with np.errstate(all="ignore"):
        return np.where(ok, rest[:, 0, 1] / np.sqrt(x * y), np.nan)


def permutation_hits(ranked: DataFrame, facts: DataFrame, keys: list[str], row: list[str], k: int, n_blocks: int, permutations: int, seed: int) -> DataFrame:
    """(keys, hits): permutations whose correlation is at least as far from zero as the observed one.

    The i-th event by the hash of (seed, permutation, event) gets the first column's rank of the i-th event in fixed order: two orders joined
    by position, one row for each event and permutation, summed by (key, permutation). Events with equal ``row`` are told apart by their ranks.
    """
    rank = lambda i: F.aggregate(f"_a{i}", F.lit(0.5), lambda s, x: s + x)
    name = F.concat_ws(":", *row)
    rows = stage_table(ranked.select(*keys, name.alias("_row"), *[rank(i).alias(f"_r{i}") for i in range(k)]))
    others = [f"_r{i}" for i in range(1, k)]
    fixed = average_rank(rows.withColumn("_order", F.concat_ws(":", "_row", *[F.format_string("%020.1f", f"_r{i}") for i in range(k)])), keys, "_order", "_mean")
    same = Window.partitionBy(*keys, "_order").orderBy("_r0")  # rows alike in everything
    fixed = fixed.select(*keys, "_r0", (F.col("_mean") - (F.count(F.lit(1)).over(Window.partitionBy(*keys, "_order")) + 1) / 2 + F.row_number().over(same)).cast("long").alias("_i"))
    each = rows.select(*keys, "_row", "_r0", *others, F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_p"))
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_p").cast("string"), "_row"))
    order = Window.partitionBy(*keys, "_p").orderBy(mixed, "_r0", *others)
    each = each.select(*keys, "_p", *others, F.row_number().over(order).cast("long").alias("_i"))
    sums = each.join(fixed, [*keys, "_i"]).groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col("_r0") * F.col(c)).alias(f"_s{i}") for i, c in enumerate(others, 1)])

    @F.pandas_udf("long")
    def hit(observed: pd.Series, cov: pd.Series, s: pd.Series, n: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype="int64")
        cov, n = np.stack([np.asarray(x, float) for x in cov]).reshape(-1, k, k), n.to_numpy(float)
        cov[:, 0, 1:] = cov[:, 1:, 0] = np.stack([np.asarray(x, float) for x in s]) / n[:, None] - ((n + 1) / 2)[:, None] ** 2
        return pd.Series((np.abs(partial_correlations(n, cov)) >= np.abs(observed.to_numpy(float)) - NOISE).astype(np.int64))

    hits = sums.join(facts.select(*keys, "cov", "observed"), keys).withColumn("_h", hit("observed", "cov", F.array(*[F.col(f"_s{i}") for i in range(1, k)]), "_n"))
    return hits.groupBy(*keys).agg(F.sum("_h").alias("hits"))


def spearman_interval(df: DataFrame, keys: list[str], columns: list[str], block: str, reps: int = 10_000, seed: int = 42, permutations: int = 0, row: list[str] | None = None) -> DataFrame:
    """(Partial) Spearman of the first two columns given the others, block interval and p, for any number of events.

    Events with a null column or block are left out. ``permutations`` adds a permutation p and needs ``row``, the columns that name an event.
    The blocks are seasons: the sums of a key hold (number of blocks) ** 3 numbers for each pair of columns.
    """
    if permutations and not row:
        raise ValueError("permutations need the columns that name an event")
    if not keys:
        return spearman_interval(df.withColumn("_key", F.lit(1)), ["_key"], columns, block, reps, seed, permutations, row).drop("_key")
    k, row = len(columns), row or []
    d = df
    for c in (*columns, block):
        d = d.filter(F.col(c).isNotNull())
    blocks = stage_table(block_numbers(d, block))
    n_blocks = blocks.count()
    if not n_blocks:
        return df.sparkSession.createDataFrame([], T.StructType([df.schema[c] for c in keys] + list(_RESULT.fields[:4]) + [T.StructField(n, T.LongType()) for n in ("n_le", "n_ge", "n_valid")]
                                               + [T.StructField("p_permutation", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("p_value", T.DoubleType())]))
    named = [F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]
    rows = stage_table(d.select(*keys, *row, F.col(block).alias("_block"), *named).join(blocks, "_block").drop("_block"))
    ranked = rank_vectors(rows, keys, [f"_c{i}" for i in range(k)], n_blocks)
    ranked = stage_table(ranked) if permutations else ranked

    @F.pandas_udf("observed double, n long, cov array<double>")
    def observe(v: pd.Series) -> pd.DataFrame:
        one = np.ones((1, n_blocks))
        made = [covariances(np.frombuffer(x), k, n_blocks, one) for x in v]
        return pd.DataFrame({"observed": [partial_correlations(*m)[0] for m in made], "n": [int(round(m[0][0])) for m in made], "cov": [m[1][0].ravel().tolist() for m in made]})

    facts = stage_table(moment_tensors(ranked, keys, k, n_blocks).select(*keys, "v", observe("v").alias("_o")).select(*keys, "v", "_o.*"))

    @F.pandas_udf("array<double>")
    def replicate(v: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([partial_correlations(*covariances(np.frombuffer(x), k, n_blocks, weights_of(np.arange(p * CHUNK, min(reps, (p + 1) * CHUNK)), n_blocks, seed))).tolist()
                          for x, p in zip(v, part)])

    @F.pandas_udf(T.StructType(_RESULT.fields))
    def summary(observed: pd.Series, draws: pd.Series) -> pd.DataFrame:
        return pd.concat([_summary(np.array([o]), np.asarray(x, float)[:, None]) for o, x in zip(observed, draws)], ignore_index=True)

    a = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-reps // CHUNK) - 1))))).repartition(*keys, "_part").select(*keys, "observed", "n", "_part", replicate("v", "_part").alias("draws"))
    a = a.groupBy(*keys).agg(F.first("observed").alias("_o"), F.flatten(F.sort_array(F.collect_list(F.struct("_part", "draws")))["draws"]).alias("_d"), F.first("n").alias("n"))
    p = F.lit(None).cast("double")
    if permutations:
        a = a.join(permutation_hits(ranked, facts, keys, row, k, n_blocks, permutations, seed), keys)
        p = (F.col("hits") + 1.0) / (permutations + 1.0)
    r = a.select(*keys, "n", p.alias("p_permutation"), summary("_o", "_d").alias("_r")).select(*keys, "_r.*", "p_permutation", "n")
    for c in ("observed", "se", "ci_low", "ci_high"):
        r = r.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    for c in ("n_le", "n_ge", "n_valid"):
        r = r.withColumn(c, F.col(c).cast("long"))
    return r.withColumn("p_value", p_from_tails(F.col("n_le"), F.col("n_ge"), F.col("n_valid")))
