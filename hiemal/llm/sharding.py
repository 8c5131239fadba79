"""Shards with the same mixture of sources: proportional stratified interleaving."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import ranked

SEED = "shard-1"


def interleave(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED,
               keep: list[str] | None = None) -> DataFrame:
    """(_doc, _id, _size, _crc, _shard, _slot): every row of ``docs`` as a struct with its shard and its place there.

    Each source's rows are shuffled by a seeded hash of the id and ranked; sorted by (rank + 1/2) / rows of the source, all
    sources run evenly through the whole order, and equal cuts of it hold each source in its proportion. Shard sizes
    differ by one row at most. Both orders are ranks over range partitions: a source with a third of all rows is no
    single task. Rows with the same id are ordered by size and checksum. ``keep`` names
    the columns that the struct holds (all). Null texts have size 1 and checksum 0, null is a source of its own.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("_doc"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
                     (F.octet_length(raw) + 1).cast("long").alias("_size"), F.crc32(F.encode(raw, "UTF-8")).alias("_crc"),
                     F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_mixed"))
    one = ranked(df, [F.col("_mixed").asc(), F.col("_size").asc(), F.col("_crc").asc()], ["_source"])
    one = one.withColumn("_at", (F.col("_rank") + 0.5) / F.col("_rows")).drop("_rank", "_rows", "_mixed")
    two = ranked(one, [F.col("_at").asc(), F.col("_source").asc_nulls_last()])
    shard = F.expr(f"cast(_rank * {shards} div _rows as int)")
    first = F.expr("(_shard * _rows + {0} - 1) div {0}".format(shards))
    two = two.withColumn("_shard", shard)
    return two.select("_doc", "_id", "_size", "_crc", "_shard", (F.col("_rank") - first).alias("_slot"))
