"""Mixing sources to target weights by systematic sampling."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import ranked

#: Runs of anything but \x20 and \x09-\x0D.
WORDS = r"[^\x20\x09-\x0D]+"
MOST = 3  # a target stops at this many times its source's size
WEIGHTS = 3  # weights 1 to 3, repeating over the sources in order
SEED = "mix-1"


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(_source, _total, target): targets by weight of all sizes together, stopped at ``most`` times the source's size.

    ``sizes`` has (_source, _size). What stopped sources can't take goes to the others by weight until none is above: in
    the order of limit / weight the stopped sources come first, so running sums over the sources tell where that ends. One
    row per source is all that meets in a window.
    """
    s = sizes.groupBy("_source").agg(F.sum("_size").alias("_total"))
    s = s.withColumn("_w", (F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1) % WEIGHTS + 1)
    every = Window.partitionBy()
    s = s.select("*", F.sum("_total").over(every).alias("_t"), F.sum("_w").over(every).alias("_ws"))
    before = Window.orderBy(most * F.col("_total") / F.col("_w"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    s = s.select("*", F.coalesce(F.sum("_total").over(before), zero).alias("_pt"), F.coalesce(F.sum("_w").over(before), zero).alias("_pw"))
    s = s.withColumn("_stop", (F.col("_t") - most * F.col("_pt")) * F.col("_w") > most * F.col("_total") * (F.col("_ws") - F.col("_pw")))
    s = s.select("*", F.coalesce(F.sum(F.when(F.col("_stop"), F.col("_total"))).over(every), zero).alias("_st"),
                 F.coalesce(F.sum(F.when(F.col("_stop"), F.col("_w"))).over(every), zero).alias("_sw"))
    rest = (F.col("_t") - most * F.col("_st")).cast("double") * F.col("_w") / (F.col("_ws") - F.col("_sw"))
    return s.select("_source", "_total", F.when(F.col("_stop"), (most * F.col("_total")).cast("double")).otherwise(rest).alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, most: int = MOST,
           keep: list[str] | None = None) -> DataFrame:
    """(_doc, _id, _size, _total, target, _copies): each row of ``docs`` as a struct and how often the mix takes it.

    Every document of a source expects target / size copies. The rows of a source lie on a line in order of (size, id),
    one expected copy count long each; starting at one offset per source, a row is taken once for each integer inside its
    stretch. In that order rows next to each other have like sizes, so the words taken stay within about the size of
    the largest document of the target. The offset is the hash of seed and source: runs agree. Rows with the same size and id are
    interchangeable. ``keep`` names the columns
    that the struct holds (all). Null and empty texts have size 0; null is a source of its own; a null id comes last.
    """
    df = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("_doc"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
                     F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("_size"))
    placed = ranked(df, [F.col("_size").asc(), F.col("_id").asc_nulls_last()], ["_source"])
    goals = source_targets(placed.select("_source", "_size"), most).withColumnRenamed("_source", "_s")
    placed = placed.join(goals, F.col("_source").eqNullSafe(F.col("_s")))
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("_source", F.lit("")))), 1, 3), 16, 10).cast("double") + 0.5) / 4096
    each = F.when(F.col("_total") > 0, F.col("target") / F.col("_total")).otherwise(F.lit(0.0))
    line = lambda k: F.floor(k * each + offset)
    return placed.select("_doc", "_id", "_size", "_total", "target", (line(F.col("_rank") + 1) - line(F.col("_rank"))).alias("_copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    taken = copies(docs, **how).where("_copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_doc.*")
