"""What the operators of this package share: Arrow helpers, worker caches, salted lookups and distributed ranks."""
from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage_table


def worker_cache(key, build):
    """``build()`` once in a Python worker process, kept between its tasks."""
    host = sys.modules.setdefault("_hiemal_worker", types.ModuleType("_hiemal_worker"))
    if key not in host.__dict__:
        host.__dict__[key] = build()
    return host.__dict__[key]


BATCH_ROWS = 2000


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with Arrow batches of at most BATCH_ROWS rows: whole texts are large rows, and the default of the
    session (10,000) would make buffers of many megabytes in every task. A smaller setting of the session stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def small_batches(batches, column: str, limit: int = 2 << 20):
    """Arrow batches again, cut so that ``column`` (text) holds about ``limit`` bytes in each; no row is split."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list array from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def gather_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def salted_lookup(probe: DataFrame, key: str, table: DataFrame, spread: str, hot_rows: int = 20_000) -> DataFrame:
    """Left join of ``probe`` with a ``table`` that is unique in ``key``; keys with many probe rows are dealt over salts.

    A key is hot with over ``hot_rows`` rows and over a 256th of all rows, so there are fewer than 256 hot keys at
    any size: that bounds the list that is taken to the driver. Every other key is small beside the whole. Which row
    gets which salt follows from column ``spread``; the result doesn't depend on it. The table grows with the input: it is never broadcast.
    """
    counts = probe.groupBy(key).count().where(F.col(key).isNotNull())
    counts = counts.where(F.col("count") > hot_rows)
    rows = probe.count()
    hot = [r[0] for r in counts.where(F.col("count") > rows / 256).select(key).collect()]
    if not hot:
        return probe.join(table.hint("merge"), key, "left")
    is_hot = F.col(key).isin(hot)
    left = probe.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(256)).cast("int")).otherwise(0))
    right = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(255))).otherwise(F.array(F.lit(0)))))
    return left.join(right.hint("merge"), [key, "_salt"], "left").drop("_salt")


def ranked(df: DataFrame, order: list[Column], group: list[str] | None = None, carry: dict[str, str] | None = None) -> DataFrame:
    """Add ``_rank`` (from 0, within ``group``) and ``_rows`` (rows of the group); no group has to fit one task.

    The rows are range-partitioned by (group, order), so a group that holds a third of all rows is cut into many
    ranges; the ranks inside a range are completed with the counts of the ranges before. ``carry`` sums columns along
    the way: {column: name} adds the sum of ``column`` over the rows of the group before this row. The table of counts has one row
    per range and group, so at most ranges + groups. The ranges are staged: ranks and counts see the same cut.
    """
    group, carry = group or [], carry or {}
    keys = [F.col(g).asc_nulls_last() for g in group] + order
    # a one-row table for the cut: without a key the ranges follow the number of shuffle partitions
    cut = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    cut = stage_table(cut.withColumn("_part", F.shiftright("_m", 33).cast("int")))
    here = [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)]
    sums = cut.groupBy("_part", *[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)]).agg(
        F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in carry])
    ks = [f"_k{i}" for i in range(len(group))]
    before = Window.partitionBy(*ks).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select("*", F.coalesce(F.sum("_n").over(before), zero).alias("_before"), F.sum("_n").over(Window.partitionBy(*ks)).alias("_rows"),
                       *[F.coalesce(F.sum(f"_sum_{c}").over(before), zero).alias(f"_base_{c}") for c in carry]).withColumnRenamed("_part", "_p")
    on = F.col("_part") == F.col("_p")
    for h in here:
        on = on & h
    out = cut.join(sums, on, "left").withColumn("_rank", F.col("_m") - F.col("_first") + F.col("_before"))
    if carry:
        run = Window.partitionBy("_part", *group).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
        out = out.select("*", *[(F.coalesce(F.sum(c).over(run), zero) + F.col(f"_base_{c}")).alias(name) for c, name in carry.items()])
    return out.select(*df.columns, "_rank", "_rows", *carry.values())


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, texts): every text of ``rows`` (_holder, an id that isn't null, _digest, _text) once, numbered in the order of (smallest id, digest).

    nodes has (_digest, _holder, _copies, _key), texts (_id, _copies, _text) with _id the number. Only digests and ids are grouped; of each text one
    row travels, that of its first holder. Rows that repeat id and text meet there.
    """
    nodes = rows.groupBy("_digest").agg(F.min("_holder").alias("_holder"), F.count(F.lit(1)).alias("_copies"))
    nodes = stage_table(ranked(nodes, [F.col("_holder").asc(), F.col("_digest").asc()]).select("_digest", "_holder", "_copies", F.col("_rank").alias("_key")))
    texts = rows.join(nodes.hint("merge"), ["_holder", "_digest"]).groupBy("_holder", "_digest").agg(F.first("_key").alias("_id"), F.first("_copies").alias("_copies"), F.first("_text").alias("_text"))
    return nodes, stage_table(texts.select("_id", "_copies", "_text"))
