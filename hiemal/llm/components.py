"""Connected components of a graph of any size, by contraction rounds of joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage_table
from .common import salted_lookup


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the members of every component and one of them as its name; nodes without an edge have no row.

    ``edges`` holds two long columns; direction, loops and repeats don't matter; a null end joins nothing. Each round points every
    node to its neighbour with the smallest hash (or to itself), follows that pointer once more, and replaces both
    ends of each edge; nodes fall by a constant factor a round, long chains included. Neighbours are reduced with a
    mergeable minimum, and hub nodes are dealt over salts. The pointer tables are staged, then composed from the last
    to the first.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = stage_table(live.distinct())
    tables = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(
            F.col("a").alias("node"), F.least(F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")), F.col("m"))["v"].alias("up"))
        near = stage_table(near)
        jump = salted_lookup(near, "up", near.select(F.col("node").alias("up"), F.col("up").alias("upper")), "node")
        jump = stage_table(jump.select("node", F.coalesce("upper", "up").alias("up")))
        tables.append(jump)
        to = lambda name: jump.select(F.col("node").alias(name), F.col("up").alias(f"{name}_up"))
        moved = salted_lookup(salted_lookup(live, "a", to("a"), "b"), "b", to("b"), "a")
        live = stage_table(moved.where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
    if not tables:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = tables.pop()
    while tables:
        lower = tables.pop()
        found = salted_lookup(lower, "up", roots.select(F.col("node").alias("up"), F.col("up").alias("top")), "node")
        roots = stage_table(found.select("node", F.coalesce("top", "up").alias("up")))
    return roots.select("node", F.col("up").alias("root"))
