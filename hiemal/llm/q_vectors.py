"""Queries over ``embeddings``."""
from __future__ import annotations

from .queries import query, table
from .vectors import near_vectors, top_products

TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v::DOUBLE[], p.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op4_p_stable_hashing")
def op4(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_norm_bucketed_top_k", TOP_SQL)
def op7(spark, sf_dir):
    return top_products(table(spark, sf_dir, "embeddings"))
