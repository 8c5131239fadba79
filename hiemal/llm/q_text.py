"""Queries over the texts of ``documents``."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import stage_folder
from . import byte_bpe
from .passages import repeated_passages
from .queries import query, table
from .simhash import simhash_components
from .token_files import checksums, places, read_tokens, write_tokens


@query("op2_simhash_bk_tree")
def op2(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


@query("op3_token_parquet")
def op3(spark, sf_dir):
    import public_tokenizers
    path = f"{stage_folder(spark)}/token-files/{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    tokens = read_tokens(spark, path)
    return places(tokens, checksums(tokens)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op10_byte_level_bpe")
def op10(spark, sf_dir):
    import public_tokenizers
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_compact_windows")
def op8(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))
