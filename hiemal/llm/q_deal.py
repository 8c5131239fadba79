"""Queries that deal documents out: mixing and sharding."""
from __future__ import annotations

from pyspark.sql import functions as F

from .mixing import copies
from .queries import query, table
from .sharding import interleave

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS total, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
 t AS (SELECT *, sum(total) OVER () AS t, sum(w) OVER () AS ws,
   coalesce(sum(total) OVER o, 0) AS pt, coalesce(sum(w) OVER o, 0) AS pw FROM s
   WINDOW o AS (ORDER BY 3 * total / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 u AS (SELECT *, (t - 3 * pt) * w > 3 * total * (ws - pw) AS stop FROM t),
 v AS (SELECT *, coalesce(sum(total) FILTER (stop) OVER (), 0) AS st, coalesce(sum(w) FILTER (stop) OVER (), 0) AS sw FROM u),
 g AS (SELECT source, total, CASE WHEN stop THEN (3 * total)::DOUBLE ELSE (t - 3 * st)::DOUBLE * w::DOUBLE / (ws - sw)::DOUBLE END AS target FROM v),
 r AS (SELECT doc_id, size, g.total AS source_size, g.target,
   row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) - 1 AS k,
   CASE WHEN g.total > 0 THEN g.target / g.total ELSE 0 END AS each,
   (('0x' || substr(md5('mix-1' || coalesce(d.source, '')), 1, 3))::INTEGER + 0.5::DOUBLE) / 4096 AS u
   FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ((floor((k + 1) * each + u) - floor(k * each + u)) * size)::BIGINT AS taken FROM r"""

SHARD_SQL = """
WITH RECURSIVE steps AS (SELECT i::UINTEGER AS i, i::UINTEGER AS c, 0 AS n FROM range(256) r(i)
  UNION ALL SELECT i, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::UINTEGER ELSE 0::UINTEGER END), n + 1 FROM steps WHERE n < 8),
 codes AS (SELECT list(c ORDER BY i) AS code FROM steps WHERE n = 8),
 d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, md5('shard-1' || coalesce(doc_id::VARCHAR, '')) AS h,
   list_reduce(list_prepend(4294967295::UINTEGER, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UINTEGER)),
     lambda a, b: xor(a >> 8, code[xor(a & 255::UINTEGER, b) + 1])) AS c FROM documents, codes),
 e AS (SELECT *, xor(c, 4294967295::UINTEGER)::BIGINT AS text_crc32 FROM d),
 f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, size, text_crc32) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS frac FROM e),
 g AS (SELECT *, row_number() OVER (ORDER BY frac, source ASC NULLS LAST) - 1 AS k, count(*) OVER () AS n FROM f)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (k * 16 // n)::INTEGER AS shard,
  (k - ((k * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM g"""


@query("op6_systematic_mixing", MIX_SQL)
def op6(spark, sf_dir):
    rows = copies(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), "target", (F.col("_copies") * F.col("_size")).alias("taken"))


@query("op9_stratified_shards", SHARD_SQL)
def op9(spark, sf_dir):
    rows = interleave(table(spark, sf_dir, "documents"), 16, keep=["doc_id"])
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").alias("shard"),
                       F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
