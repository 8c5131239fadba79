"""Delimited station files with a preamble before the header."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def text_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, line_key, line): lines of text files with a key that orders them inside a file."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("seq")).alias("line_key"),
        F.col("value").alias("line"))


def after_header(lines: DataFrame, header_prefix: str) -> DataFrame:
    """Rows after the first line of each file that starts with ``header_prefix``.

    Adds ``header`` (the header text). Files without a header yield one row with a null line, so
    that they are reported and not lost.
    """
    is_header = F.lower(F.trim("line")).startswith(header_prefix.lower())
    head = lines.groupBy("file").agg(
        F.min(F.when(is_header, F.col("line_key"))).alias("header_key"),
        F.min_by("line", F.when(is_header, F.col("line_key"))).alias("header"))
    found = (
        lines.join(head.filter("header_key IS NOT NULL"), "file")
        .filter((F.col("line_key") > F.col("header_key")) & (F.trim("line") != ""))
        .select("file", "line_key", "header", "line"))
    lost = head.filter("header_key IS NULL").select(
        "file", F.lit(None).cast(lines.schema["line_key"].dataType).alias("line_key"), "header",
        F.lit(None).cast("string").alias("line"))
    return found.unionByName(lost)


def split_fields(rows: DataFrame, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Typed columns plus ``row_status``: ok, missing_header, header_mismatch or field_count."""
    expected = sep.join(f.name for f in schema.fields).lower()
    header = F.lower(F.regexp_replace("header", r"\s*" + sep + r"\s*", sep))
    cells = F.split("line", sep)
    status = (
        F.when(F.col("header").isNull(), "missing_header")
        .when(F.trim(header) != expected, "header_mismatch")
        .when(F.size(cells) != len(schema.fields), "field_count").otherwise("ok"))
    out = rows.withColumn("row_status", status).withColumn("_c", cells)
    for i, f in enumerate(schema.fields):
        cell = F.trim(F.get("_c", i))
        out = out.withColumn(f.name, F.when(F.col("row_status") == "ok", cell.try_cast(f.dataType)))
    return out.drop("_c")


def read_with_preamble(spark: SparkSession, paths, header_prefix: str, schema: T.StructType) -> DataFrame:
    return split_fields(after_header(text_lines(spark, paths), header_prefix), schema)
