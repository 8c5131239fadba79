import hashlib
import os

from pyspark.sql import functions as F, types as T

from hiemal.sources import delimited, tables


def test_preamble_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Report\n\nid,balance\n1,2.5\n2,x\n3\n")
    (tmp_path / "b.csv").write_text("nothing here\n")
    got = delimited.read_with_preamble(spark, str(tmp_path / "*.csv"), "id,", T.StructType().add("id", "long").add("balance", "double")).select("id", "balance", "row_status").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 2.5, "ok"), (2, None, "ok"), (None, None, "field_count"), (None, None, "missing_header")]))


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456, 2001), (2, float("nan"), 2002)], "id int, x double, year int")
    p = str(tmp_path / "t")
    tables.write_table(df, p, T.StructType().add("id", "long").add("x", "float").add("year", "integer"), ["year"], ["id"])
    back = tables.read_table(spark, p)
    assert back.filter("x IS NULL").count() == 1 and back.schema["x"].dataType == T.FloatType()
    tables.write_csv(df.filter("id = 1"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["x"] == "0.1235"
    m = tables.file_checksums(spark, str(tmp_path / "c"), "*.csv").first()
    assert len(m["sha256"]) == 64 and tables.file_inventory(spark, str(tmp_path / "c"), "*.csv").count() >= 1


def test_partition_pruning_join(spark, tmp_path):
    g = spark.range(4000).select(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("time"), F.rand(1).alias("v"))
    tables.write_table(g.withColumn("year", F.year("time")).withColumn("month", F.month("time")), str(tmp_path / "g"), partition_by=["year", "month"])
    want = spark.createDataFrame([("2001-03-05",), ("2001-03-06",)], "date string").select(F.col("date").cast("date").alias("date"))
    out = tables.rows_for_dates(spark.read.parquet(str(tmp_path / "g")), want)
    assert out.count() == 20


def test_checksums_of_large_files_are_streamed(spark, tmp_path):
    random = os.urandom(300_000)
    content = {"a": random, "b": random + b"\n", "c": b"\xef\xbb\xbf" + random, "d": b"\xef\xbb\xbf\r\n" + random + b"\n\n", "e": b"\n" * 5000, "f": b"x" * 200_000, "h": b"small\n", "i": b"\x00" * 9000 + b"\r"}
    for name, data in content.items():
        (tmp_path / f"{name}.parquet").write_bytes(data)
    want = sorted((f"{n}.parquet", len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        for whole in (1000, 0, 1 << 30):
            assert sorted(map(tuple, tables.file_checksums(spark, str(tmp_path), "*.parquet", whole).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
