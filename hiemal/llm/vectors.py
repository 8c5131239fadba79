"""Vectors: near-duplicates by Euclidean p-stable hashing, and exact top-k inner products over norm buckets."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage_table
from .components import components
from .common import map_arrow, salted_lookup

# ------------------------------------------------------------------ near-duplicates
TABLES = 20
PROJECTIONS = 10
WIDTH = 2.0
BLOCK = 512


def finite(x: Column) -> Column:
    """The array isn't null and holds numbers only."""
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def projections(dim: int, tables: int, per_table: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (2-stable) and offsets."""
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim, tables * per_table)), rng.uniform(0, width, tables * per_table)


def as_rows(column) -> np.ndarray:
    """A list column of equally long lists as a matrix of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def bucket_codes(vectors: DataFrame, tables: int, per_table: int, width: float, seed: int) -> DataFrame:
    """Add ``codes``: for each table one 64-bit hash of the quantised projections of the normalised vector.

    The input has (node, label, dim, x, ...); rows of a batch may differ in dim.
    """
    schema = ", ".join(f"{c} {t}" for c, t in vectors.dtypes) + ", codes array<bigint>"
    names = vectors.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(names.index("dim")).to_numpy()
            codes = np.zeros((batch.num_rows, tables), np.int64)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x = as_rows(batch.column(names.index("x")).take(pa.array(rows)))
                x = x / np.abs(x).max(1, keepdims=True)  # before the square: huge or tiny components
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                a, b = projections(int(d), tables, per_table, width, seed)
                cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(rows), tables, per_table)
                h = np.zeros((len(rows), tables), np.int64)
                with np.errstate(over="ignore"):
                    for k in range(per_table):
                        h = (h ^ cells[:, :, k]) * np.int64(0x100000001B3)
                        h ^= (h >> np.int64(29))
                codes[rows] = h
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*names, "codes"])

    return map_arrow(vectors, run, schema)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def verified(left: dict, right: dict | None, table: np.ndarray, least: float):
    """Checked pairs of one block with itself (right None) or another: per vector links (weighted by copies) and a lower partner.

    A pair that has met in an earlier table counts only there.
    """
    a, b = left, right or left
    close = unit(a["x"]) @ unit(b["x"]).T >= least
    if right is None:
        close &= np.tri(len(a["node"]), k=-1, dtype=bool)
    i, j = np.nonzero(close)
    if not len(i):
        return None
    same = a["codes"][i] == b["codes"][j]
    i, j = (v[same.argmax(1) == table] for v in (i, j))
    if not len(i):
        return None
    node = np.concatenate([a["node"][i], b["node"][j]])
    other = np.concatenate([b["node"][j], a["node"][i]])
    weight = np.concatenate([b["copies"][j], a["copies"][i]])
    each, at = np.unique(node, return_inverse=True)
    links = np.bincount(at, weight).astype(np.int64)
    # local spanning stars instead of all pairs
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            up[v] = v = up[up[v]]
        return v

    for p, q in zip(node[:len(i)].tolist(), other[:len(i)].tolist()):
        p, q = root(p), root(q)
        if p != q:
            up[max(p, q)] = min(p, q)
    return each, links, np.array([root(v) for v in each.tolist()], np.int64)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, tables: int = TABLES,
                 per_table: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector; links join vectors of one label with a cosine of at least ``least``.

    Equal vectors of a label are one node with a count. A normalised vector falls, in each of ``tables`` tables, into the
    bucket of its ``per_table`` quantised Gaussian projections; every pair in a bucket is checked by its exact cosine in
    doubles, as a product of two blocks of at most ``block`` vectors. Buckets above ``block`` vectors are cut into blocks
    and each pair of blocks is a row group of its own, so no bucket is one task. A pair counts in its first common table
    only. Blocks return counts and spanning stars, never all pairs. Null labels, and vectors that are null, empty, zero or
    not finite link with nothing; vectors of different length don't link. Rows with a null id count as copies but name no component.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast("array<double>").alias("_x"))
    rows = rows.withColumn("_ok", F.col("_label").isNotNull() & finite(F.col("_x")) & F.coalesce(F.exists("_x", lambda v: v != 0), F.lit(False)))
    keyed = rows.select("_id", "_label", "_x", "_ok", F.when(F.col("_ok"), F.sha2(F.to_json(F.struct("_label", "_x")), 256)).alias("_same"))
    keyed = stage_table(keyed)
    nodes = keyed.where("_ok").groupBy("_same").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("_label").cast("string").alias("label"), F.any_value("_x").alias("x"))
    nodes = stage_table(nodes.select("_same", F.xxhash64("_same").alias("node"), "first", "copies", "label", F.size("x").alias("dim"), "x"))
    coded = stage_table(bucket_codes(nodes.select("node", "copies", "label", "dim", "x"), tables, per_table, width, seed))
    spots = coded.select("node", "label", "dim", F.posexplode("codes").alias("table", "code"))
    key = ["label", "dim", "table", "code"]
    full = stage_table(spots.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # a bucket of n vectors has c = ceil(n / block) blocks; a vector of block i meets blocks 0..c-1: group (min, max) of both
    hit = spots.join(full.hint("merge"), key)  # neither side may be broadcast: Spark sizes them as before their explodes
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node", "table"), blocks).cast("int")
    hit = hit.select("node", F.xxhash64(*key).alias("bucket"), "table", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    hit = hit.select("node", "bucket", "table", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    packed = hit.join(coded.select("node", "copies", "x", "codes").hint("merge"), "node").select("bucket", "lo", "hi", "mine", "table", "node", "copies", "x", "codes")
    packed = packed.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "mine", "node")

    def run(batches):
        held: list = []
        for batch in batches:
            group = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            if not len(group):
                continue
            edges = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1), len(group)]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if held and tuple(group[a]) != held[0][0]:
                    yield from check(held)
                    held = []
                held.append((tuple(group[a]), part))
        yield from check(held)

    def check(held):
        if not held:
            return
        t = pa.Table.from_batches([p for _, p in held]).combine_chunks()
        one = lambda name: t.column(name).combine_chunks()
        mine = one("mine").to_numpy()
        x, codes = as_rows(one("x")), one("codes").flatten().to_numpy().reshape(len(mine), -1)
        take = lambda m: {"node": one("node").to_numpy()[m], "copies": one("copies").to_numpy()[m], "x": x[m], "codes": codes[m]}
        (_, lo, hi), table = held[0][0], one("table")[0].as_py()
        found = verified(take(mine == lo), None if lo == hi else take(mine == hi), table, least)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["node", "links", "root"])

    found = stage_table(map_arrow(packed, run, "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = components(found, "node", "root").select("node", F.col("root").alias("top"))
    named = nodes.select("_same", "node", "first", "copies").join(links, "node", "left").join(member, "node", "left").withColumn("top", F.coalesce("top", "node"))
    named = stage_table(named)
    named = salted_lookup(named, "top", named.groupBy("top").agg(F.min("first").alias("component_id")), "node")
    named = stage_table(named.select("_same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = salted_lookup(keyed.select("_id", "_same"), "_same", named, "_id")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))


# ------------------------------------------------------------------ exact top-k
NORM_BUCKETS = 64
ROWS = 4096
QUERY_ROWS = 1024
HEAD = 2048
FOCUS = 4


def integer_parts(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(_id, _v, _norm): floor(scale * x) of vectors that are whole and finite, and the length of the integer vector."""
    x = F.col(vector_col).cast("array<double>")
    v = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    rows = vectors.where(finite(x) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), v.alias("_v"))
    return rows.withColumn("_norm", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, c: s + c * c)))


def dense(column, width: int) -> np.ndarray:
    """Lists as a matrix of ``width`` columns; short lists are padded with zeros."""
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    inside = np.arange(width)[None, :] < counts[:, None]
    out[inside] = flat
    return out


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles while all sums stay below 2**53, else 64-bit or Python integers."""
    most = np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * max(q.shape[-1], 1)
    if most < 2 ** 53:
        return (p @ q).astype(np.int64)
    if most < 2 ** 62:
        return p.astype(np.int64) @ q.astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(q.tolist(), row)) for row in p.tolist()], object).clip(-2 ** 63, 2 ** 63 - 1).astype(np.int64)


class Bucket:
    """Candidates of like length, longest first, with sorted lists of their normalised coordinates."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, norms: np.ndarray):
        order = np.lexsort((ids, -norms))
        self.ids, self.v, self.norms = ids[order], v[order], norms[order]
        self.unit = self.v / np.maximum(self.norms, 1e-300)[:, None]
        self.by_coordinate = np.argsort(self.unit, 0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.by_coordinate, 0)

    def candidates(self, q: np.ndarray, norm: float, least: float) -> np.ndarray:
        """Places of candidates that can score ``least``: by length, or by the narrowest feasible range of a focus coordinate."""
        n = len(self.ids)
        if least <= 0 or norm == 0:
            return np.arange(n)
        slack = 1e-9
        by_length = int(np.searchsorted(-self.norms, -(least / norm) * (1 - slack), "right"))
        if not by_length:
            return np.arange(0)
        cosine = min(least / (norm * self.norms[0]) * (1 - slack), 1.0)  # local threshold of this bucket
        if cosine < 0.3:  # wide ranges: only lengths prune
            return np.arange(by_length)
        u, spread = q / norm, np.arccos(cosine)
        focus = np.argsort(-np.abs(u))[:FOCUS]
        angle = np.arccos(np.clip(u[focus], -1, 1))
        low, high = np.cos(np.minimum(angle + spread, np.pi)) - slack, np.cos(np.maximum(angle - spread, 0)) + slack
        a = np.array([np.searchsorted(self.sorted[:, f], x, "left") for f, x in zip(focus, low)])
        b = np.array([np.searchsorted(self.sorted[:, f], x, "right") for f, x in zip(focus, high)])
        best = int((b - a).argmin())
        if b[best] - a[best] >= by_length:
            return np.arange(by_length)
        at = self.by_coordinate[a[best]:b[best], focus[best]]
        return at[at < by_length]

    def best(self, q: np.ndarray, norm: float, least: float, k: int, own: int) -> list[tuple[int, int]]:
        """Up to k (score, id), best first, of candidates that reach ``least``; ``own`` is left out."""
        at = self.candidates(q, norm, least)
        at = at[self.ids[at] != own]
        if not len(at):
            return []
        score, ids = products(q, self.v[at]), self.ids[at]
        top = np.lexsort((ids, -score))[:k]
        return [(int(s), int(i)) for s, i in zip(score[top], ids[top]) if s >= least]


def top_products(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best integer inner products of each query (id divisible by ``every``) with all other rows.

    Candidates are grouped by length into NORM_BUCKETS quantile ranges, cut into blocks of about ROWS. A first pass over
    the HEAD longest vectors (a bounded table) gives every query a score that its k-th best reaches at least. A query goes only to
    buckets whose longest vector can reach that score, in blocks of about QUERY_ROWS queries; inside, the cosine that the bucket's longest
    vector would need chooses between pruning by length and by coordinate ranges, and what is left is verified by
    exact products. Ties go to the smaller id. Null ids, and vectors that are null or hold null or non-finite components,
    take no part; shorter vectors count as padded with zeros, empty ones score 0.
    """
    spark = vectors.sparkSession
    rows = stage_table(integer_parts(vectors, id_col, vector_col, scale))
    n, dim, low, high = rows.agg(F.count(F.lit(1)), F.max(F.size("_v")), F.min("_norm"), F.max("_norm")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cuts = sorted(set(rows.select(F.percentile_approx("_norm", [i / NORM_BUCKETS for i in range(1, NORM_BUCKETS)], 10000)).first()[0]), reverse=True)
    # bucket 0 holds the longest vectors; bucket i ends at cuts[i - 1], so no vector in it is longer
    caps = [high, *cuts]
    sizes = max(1, -(-n // (len(caps) * ROWS)))  # blocks in a bucket
    head = rows.orderBy(F.col("_norm").desc(), "_id").limit(HEAD).toPandas()
    h_ids, h_v = head["_id"].to_numpy(), np.zeros((len(head), dim))
    for i, v in enumerate(head["_v"]):
        h_v[i, :len(v)] = v

    def floors(batches):
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), dense(batch.column(1), dim)
            least = []
            for i, v in zip(ids, q):
                s = products(v, h_v)[h_ids != i]
                least.append(float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.float64())], ["_id", "_v", "_norm", "least"])

    queries = rows.where(F.col("_id") % every == 0)
    queries = map_arrow(queries, floors, "_id bigint, _v array<double>, _norm double, least double")
    limits = F.array(*[F.lit(float(c)) for c in caps])
    # a bucket is out if even its longest vector, in the query's direction, stays below
    reach = F.filter(F.sequence(F.lit(0), F.lit(len(caps) - 1)), lambda i: F.col("least").isNull() | (F.col("least") <= 0) | (F.col("_norm") * limits[i] * (1 + 1e-9) >= F.col("least")))
    q_blocks = max(1, -(-n // every // QUERY_ROWS))
    q = queries.select("*", F.explode(reach).alias("bucket")).select("*", F.explode(F.sequence(F.lit(0), F.lit(sizes - 1))).alias("block"), F.pmod(F.xxhash64("_id"), F.lit(q_blocks)).cast("int").alias("part"))
    q = q.select("bucket", "block", "part", F.lit(1).alias("kind"), "_id", "_v", "_norm", "least")
    place = sum((F.when(F.col("_norm") <= float(c), 1).otherwise(0) for c in cuts), F.lit(0))
    p = rows.select(place.alias("bucket"), F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(sizes)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("part"),
                    F.lit(0).alias("kind"), "_id", "_v", "_norm", F.lit(None).cast("double").alias("least"))
    both = p.unionByName(q).repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part", "kind")

    def search(batches):
        now, held, bucket = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            if not len(key):
                continue
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
            for a, b in zip(edges, edges[1:]):
                part, group, kind = batch.slice(a, b - a), tuple(key[a, :3]), key[a, 3]
                if group != now:
                    now, held, bucket = group, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if bucket is None:
                    bucket = Bucket(*(np.concatenate(x) for x in zip(*[(h.column(4).to_numpy(), dense(h.column(5), dim), h.column(6).to_numpy()) for h in held])))
                out = []
                for own, v, norm, least in zip(part.column(4).to_pylist(), dense(part.column(5), dim), part.column(6).to_pylist(), part.column(7).to_pylist()):
                    out += [(own, i, s) for s, i in bucket.best(v, norm, -np.inf if least is None else least, k, own)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["query_id", "vec_id", "score"])

    found = map_arrow(both, search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # k rows per block at most
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
