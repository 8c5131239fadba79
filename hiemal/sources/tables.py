"""Columnar reads, typed sinks, inventories and checks of monthly grid tables."""
from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import all_nan_to_null
from ..session import stage_table


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None,
               schema=None) -> DataFrame:
    """Parquet, or CSV for paths that end in .csv; NaN becomes null at this boundary."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema is not None else reader).csv(path)
    else:
        df = spark.read.parquet(path)
    return all_nan_to_null(df.select(*columns) if columns else df)


def write_table(df: DataFrame, path: str, schema=None, partition_by: list[str] | None = None,
                cluster_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet with zstd; columns are cast to ``schema``, rows are clustered for row-group pruning."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    out = df.write.mode(mode).option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def fixed_format(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floating columns as text with a fixed number of decimals; null becomes an empty cell."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() in ("double", "float"):
            c = F.coalesce(F.format_string(f"%.{digits}f", F.round(c.cast("double"), digits)), F.lit(""))
            c = F.when(F.col(f.name).isNull(), "").otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, digits: int = 4, mode: str = "overwrite") -> None:
    fixed_format(df, digits).write.mode(mode).option("header", True).csv(path)


def month_from_name(path: Column) -> Column:
    """struct(year, month) read from names like ..._2003_01.nc or ..._200301.nc; null if absent."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    y = F.regexp_extract(base, r"((?:19|20)\d{2})[-_]?(0[1-9]|1[0-2])(?!\d)", 1)
    m = F.regexp_extract(base, r"((?:19|20)\d{2})[-_]?(0[1-9]|1[0-2])(?!\d)", 2)
    return F.struct(F.when(y != "", y.try_cast("int")).alias("year"),
                    F.when(m != "", m.try_cast("int")).alias("month"))


def expected_months(spark: SparkSession, first_year: int, last_year: int, months=range(1, 13)) -> DataFrame:
    return (
        spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
        .withColumn("month", F.explode(F.array(*[F.lit(m) for m in months])))
    )


def missing_months(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.join(present.select("year", "month").distinct(), ["year", "month"], "left_anti")


def rows_for_dates(grid: DataFrame, wanted: DataFrame, time: str = "time", date: str = "date") -> DataFrame:
    """Only the grid rows of wanted dates.

    The join carries ``year`` and ``month`` when the table is partitioned by them, so whole
    partitions are pruned at run time once the small side is known.
    """
    w = wanted.select(F.col(date).alias(time)).distinct()
    keys = [time]
    if {"year", "month"} <= set(grid.columns):
        w = w.withColumn("year", F.year(time)).withColumn("month", F.month(time))
        keys = ["year", "month", time]
    return grid.join(w, keys, "left_semi")


def month_inventory(grid: DataFrame, value: str, level: str | None = None, time: str = "time") -> DataFrame:
    """Per month: days, first and last date, rows, finite values, level set, and a verdict."""
    d = F.col(time)
    aggs = [
        F.count_distinct(d).alias("day_count"), F.min(d).alias("first_date"), F.max(d).alias("last_date"),
        F.count(F.lit(1)).alias("row_count"), F.count(value).alias("finite_count"),
    ]
    if level:
        aggs.append(F.concat_ws(",", F.array_sort(F.collect_set(F.col(level).cast("int")))).alias("levels"))
    out = grid.groupBy(F.year(d).alias("year"), F.month(d).alias("month")).agg(*aggs)
    start = F.make_date("year", "month", F.lit(1))
    return (
        out.withColumn("expected_days", F.dayofmonth(F.last_day(start)))
        .withColumn("status", F.when(F.col("finite_count") == 0, "empty")
                    .when(F.col("day_count") < F.col("expected_days"), "short")
                    .when((F.col("first_date") != start) | (F.col("last_date") != F.last_day(start)), "misdated")
                    .otherwise("ok")))


def common_dates(dates: DataFrame, group: str, n_groups: int, date: str = "date") -> DataFrame:
    """Dates present in every one of ``n_groups`` groups."""
    return (
        dates.select(date, group).distinct().groupBy(date).agg(F.count(F.lit(1)).alias("group_count"))
        .filter(F.col("group_count") == n_groups))


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and modification time of files; the content column is pruned and never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
            .select("path", "length", "modificationTime"))


#: Files above this many bytes are read in pieces: a cell can't hold 2 GB, and one cell holds a whole file in memory.
WHOLE_FILE = 64 << 20


def file_checksums(spark: SparkSession, path: str, glob: str = "*", whole: int = WHOLE_FILE) -> DataFrame:
    """SHA-256 manifest, one task per file.

    Files up to ``whole`` bytes are one cell each. Larger ones stream through their task as pieces between line feeds, whatever the
    content, so memory is bounded by the longest piece.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    small = files.where(F.col("length") <= whole).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    longest = files.select("length").where(F.col("length") > whole).agg(F.max("length")).first()[0]
    return small if longest is None else small.unionByName(_streamed_checksums(spark, path, glob, whole, longest))


def _streamed_checksums(spark: SparkSession, path: str, glob: str, whole: int, longest: int) -> DataFrame:
    """Checksums of the files over ``whole`` bytes; they are never split, and staged, as that is a setting of the session."""
    pieces = spark.read.format("text").option("lineSep", "\n").option("pathGlobFilter", glob).load(path).where(F.col("_metadata.file_size") > whole)
    pieces = pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))

    def run(batches):
        now, size, seen, plain, marked = None, 0, 0, None, None

        def done():
            # the reader leaves out a mark at the start and doesn't tell whether a line feed ends the file: the size does
            for ends in (b"", b"\n"):
                for head, digest in ((0, plain), (3, marked)):
                    if head + seen + len(ends) == size:
                        digest.update(ends)
                        name = now.rsplit("/", 1)[-1]
                        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([digest.hexdigest()])], ["file", "bytes", "sha256"])
            raise ValueError(f"{now}: {seen} bytes read of {size}")

        for batch in batches:
            names = pc.run_end_encode(batch.column(1))
            start = 0
            for name, stop in zip(names.values.to_pylist(), names.run_ends.to_pylist()):
                part = batch.column(0).slice(start, stop - start)
                text = b"\n".join(part.to_pylist())
                if name != now:
                    if now is not None:
                        yield done()
                    now, size, seen, plain, marked = name, batch.column(2)[start].as_py(), 0, hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
                else:
                    plain.update(b"\n")
                    marked.update(b"\n")
                    seen += 1
                plain.update(text)
                marked.update(text)
                seen += len(text)
                start = stop
        if now is not None:
            yield done()

    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:  # a file as long as a partition may be, and opening one costs as much: one file a task, from its start to its end
            spark.conf.set(k, str(longest + 1))
        return stage_table(pieces.mapInArrow(run, "file string, bytes bigint, sha256 string"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def merge_parts(parts: list[DataFrame], key: list[str], order: list[str] | None = None) -> DataFrame:
    """Union of parts with the first row kept per key; earlier parts win.

    The winner is found by an aggregate, so a key with very many repeats is reduced before the
    shuffle.
    """
    order = order or []
    tagged = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        tagged = p if tagged is None else tagged.unionByName(p, allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in key]
    rank = F.struct("_part", *order, *[c for c in rest if c not in order and c != "_part"])
    best = tagged.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return best.select(*key, "_r.*").drop("_part")
