"""Near-duplicate documents by SimHash fingerprints, searched with BK-trees."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage_table
from .common import map_arrow, salted_lookup
from .components import components

RADIUS = 2
#: A bucket above this many fingerprints is split by further bits, down to LEVELS.
BUCKET = 512
LEVELS = 4


def fingerprint_of(text: str | None, words: int) -> int:
    """Unsigned 64-bit SimHash of one text; 0 without a word."""
    import xxhash
    if not text:
        return 0
    parts = text.encode().lower().split()  # bytes: only A-Z change, only \\x20 and \\x09-\\x0D separate
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), 42)
    runs = zip(*(parts[i:] for i in range(words)))
    hashes = np.fromiter((digest(x, 42) for x in map(b" ".join, runs)), np.uint64, len(parts) - words + 1)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint): a signed long with the 64 bits of the SimHash over all word shingles of the whole text.

    Null and empty texts and texts of white space get 0. Repeated shingles count each time.
    """
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint bigint"

    def run(batches):
        for batch in batches:
            marks = np.fromiter((fingerprint_of(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], [id_col, "fingerprint"])

    return map_arrow(docs.select(id_col, F.col(text_col).cast("string")), run, schema)


def bit_masks(radius: int, level: int, taken: int = 0) -> list[int]:
    """Masks of the keys of one level: two values within ``radius`` bits agree under one of them at least.

    The bits not yet taken are cut into radius + 1 parts; at most ``radius`` parts can hold a difference.
    """
    free = [i for i in range(64) if not taken >> i & 1]
    parts = [sum(1 << i for i in part) for part in (x.tolist() for x in np.array_split(free, radius + 1))]
    masks = [taken | p for p in parts]
    return masks if level == 1 else [m for t in masks for m in bit_masks(radius, level - 1, t)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.edges.append({})
        if len(self.values) == 1:
            return
        at, me = 0, len(self.values) - 1
        while True:
            d = (self.values[at] ^ value).bit_count()
            down = self.edges[at].setdefault(d, me)
            if down == me:
                return
            at = down

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most ``radius`` bits away; only edges within the radius of the distance are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo += [child for e, child in self.edges[at].items() if d - radius <= e <= d + radius]
        return found


def local_stars(values: list[int], radius: int):
    """(value, root) for the values of one bucket that are linked inside it: a spanning star per local component."""
    tree, up = BKTree(), list(range(len(values)))

    def root(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[r]) for i, v in enumerate(values) if (r := root(i)) != i]


def near_links(values: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints connected by steps of at most ``radius`` bits.

    ``values`` has one distinct long column ``fingerprint``. Values meet in buckets keyed by a part of their bits
    (one of radius + 1 parts must be equal); each bucket's BK-tree is built and probed in the task that gets it. A
    bucket over ``bucket`` values is split by parts of its remaining bits, exactly and up to LEVELS times; by then at
    most 13 bits are free (radius 2), so no bucket can hold over 8,192 distinct values. A bucket returns a spanning star per local component, never its pairs.
    """
    rows = values.select("fingerprint")
    links = None
    for level in range(1, LEVELS + 1):
        if level == 1:
            masks = F.array(*[F.lit(signed(m)) for m in bit_masks(radius, 1)])
            keyed = rows.select("fingerprint", F.explode(masks).alias("mask"))
        else:  # the children of the mask that was too full
            below = F.create_map(*[x for m in bit_masks(radius, level - 1) for x in (F.lit(signed(m)), F.array(*[F.lit(signed(c)) for c in bit_masks(radius, 1, m)]))])
            keyed = rows.select("fingerprint", F.explode(below[F.col("mask")]).alias("mask"))
        keyed = keyed.withColumn("part", F.col("fingerprint").bitwiseAND(F.col("mask")))
        counts = keyed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        keyed = stage_table(keyed.join(counts.hint("merge"), ["mask", "part"]))  # neither side may be broadcast: Spark sizes them as before the explode
        full = F.lit(level < LEVELS) & (F.col("n") > bucket)
        fit = keyed.where(~full).repartition("mask", "part").sortWithinPartitions("mask", "part", "fingerprint")

        def run(batches):
            key, held = None, []
            for batch in batches:
                for k, v in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                    if k != key:
                        yield from star(held)
                        key, held = k, []
                    held.append(v & (1 << 64) - 1)
            yield from star(held)

        def star(held):
            found = local_stars(held, radius)
            if found:
                a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        here = map_arrow(fit.select("mask", "part", "fingerprint"), run, "a bigint, b bigint")
        links = here if links is None else links.unionByName(here)
        rows = keyed.where(full).select("fingerprint", "mask")
        if level == LEVELS or rows.isEmpty():
            return links


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS,
                       bucket: int = BUCKET) -> DataFrame:
    """(id, fingerprint hex, component_id): the smallest id that can be reached by links of at most ``radius`` bits.

    Documents with equal fingerprints are one node, so thousands of copies cost one row. Null ids keep a row; they never
    name a component unless all its ids are null.
    """
    marks = stage_table(fingerprints(docs, id_col, text_col, words))
    nodes = stage_table(marks.groupBy("fingerprint").agg(F.min(id_col).alias("_first")))
    member = components(near_links(nodes, radius, bucket)).select(F.col("node").alias("fingerprint"), F.col("root").alias("_root"))
    named = stage_table(nodes.join(member.hint("merge"), "fingerprint", "left").withColumn("_root", F.coalesce("_root", "fingerprint")))
    first = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = stage_table(salted_lookup(named, "_root", first, "fingerprint").select("fingerprint", "component_id"))
    out = salted_lookup(marks, "fingerprint", named, id_col)
    return out.select(id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id; rows with that same id stay, rows without an id too."""
    classes = simhash_components(docs, id_col, text_col, words, radius)
    goes = classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(goes, docs[id_col] == goes["_gone"], "left_anti")
