"""The query registry and the table adapters shared by queries and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the inventory ids it exercises."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero removes negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def R(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ station series
STATION_DAILY_SQL = """station_daily AS (
  SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS date,
         avg(l_quantity) AS tmin, max(l_extendedprice) / 1000 AS tmax, count(*) AS n_rows
  FROM lineitem GROUP BY 1, 2)"""


def station_daily(spark, sf) -> DataFrame:
    """(station, date) -> tmin, tmax from the order lines of one supplier and ship date."""
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("date")
    ).agg(F.avg("l_quantity").alias("tmin"), (F.max("l_extendedprice") / 1000).alias("tmax"),
          F.count(F.lit(1)).alias("n_rows"))


STATION_XY_SQL = """station_xy AS (
  SELECT s_suppkey AS station, s_name AS name,
         20 + CAST((s_suppkey * 7919) % 6007 AS DOUBLE) / 1000 AS lat,
         88 + CAST((s_suppkey * 10473) % 4001 AS DOUBLE) / 1000 AS lon
  FROM supplier)"""


def station_xy(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("station"), F.col("s_name").alias("name"),
        (F.lit(20) + ((k * 7919) % 6007).cast("double") / 1000).alias("lat"),
        (F.lit(88) + ((k * 10473) % 4001).cast("double") / 1000).alias("lon"))


# two overlapping sources with raw text cells: odd and even line numbers
SOURCE_SQL = """source_rows AS (
  SELECT l_linenumber % 2 AS source_no, l_suppkey AS station, CAST(l_shipdate AS DATE) AS date,
         l_orderkey * 10 + l_linenumber AS src_row,
         CASE WHEN l_quantity = 50 THEN '****' WHEN l_quantity = 49 THEN ''
              WHEN l_quantity = 48 THEN 'trace' WHEN l_quantity = 1 THEN '0'
              ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS raw,
         CASE WHEN l_quantity BETWEEN 2 AND 47 THEN l_quantity WHEN l_quantity = 1 THEN 0.0 END AS value,
         CASE WHEN l_quantity = 50 THEN 'missing_code' WHEN l_quantity = 49 THEN 'missing_cell'
              WHEN l_quantity = 48 THEN 'non_numeric' ELSE 'numeric' END AS parse_status
  FROM lineitem)"""


def raw_cell(q: Column) -> Column:
    return (F.when(q == 50, "****").when(q == 49, "").when(q == 48, "trace").when(q == 1, "0")
            .otherwise(q.cast("int").cast("string")))


def source_rows(spark, sf) -> DataFrame:
    from ..functions.parse import parse_measurement
    df = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 2).alias("source_no"), F.col("l_suppkey").alias("station"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("src_row"),
        raw_cell(F.col("l_quantity")).alias("raw"))
    df = df.withColumn("_p", parse_measurement(F.col("raw")))
    return df.select("source_no", "station", "date", "src_row", "raw", F.col("_p.value").alias("value"),
                     F.col("_p.status").alias("parse_status"))


# ------------------------------------------------------------------ grids
GRID_DAILY_SQL = """grid_daily AS (
  SELECT CAST(l_shipdate AS DATE) AS time, 25.0 + 5 * (l_suppkey % 6) AS lat0, 30.0 * (l_partkey % 12) AS lon0,
         avg(l_quantity) AS t, avg(round(l_extendedprice)) AS z,
         avg(round(l_discount * 100)) - 5 AS u, avg(round(l_tax * 100)) - 4 AS v, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3), grid AS (
  SELECT time, lat0::DOUBLE AS lat, lon0::DOUBLE AS lon, t, z, u, v, n FROM grid_daily)"""


def _fields():
    return [F.avg("l_quantity").alias("t"), F.avg(F.round("l_extendedprice")).alias("z"),
            (F.avg(F.round(F.col("l_discount") * 100)) - 5).alias("u"),
            (F.avg(F.round(F.col("l_tax") * 100)) - 4).alias("v"), F.count(F.lit(1)).alias("n")]


def _cell():
    return [(F.lit(25.0) + 5 * (F.col("l_suppkey") % 6)).alias("lat"),
            (F.lit(30.0) * (F.col("l_partkey") % 12)).alias("lon")]


def grid_daily(spark, sf) -> DataFrame:
    """Daily surface grid, 6 latitudes by 12 longitudes."""
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("time"), *_cell()).agg(*_fields())


GRID_MONTHLY_SQL = """gridm0 AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time,
         CASE l_returnflag WHEN 'A' THEN 850 WHEN 'N' THEN 500 ELSE 250 END AS level,
         25.0 + 5 * (l_suppkey % 6) AS lat0, 30.0 * (l_partkey % 12) AS lon0,
         avg(l_quantity) AS t, avg(round(l_extendedprice)) AS z,
         avg(round(l_discount * 100)) - 5 AS u, avg(round(l_tax * 100)) - 4 AS v, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3, 4), gridm AS (
  SELECT time, level, lat0::DOUBLE AS lat, lon0::DOUBLE AS lon, t, z, u, v, n FROM gridm0)"""


def grid_monthly(spark, sf) -> DataFrame:
    """Monthly grid on three levels (850, 500, 250)."""
    level = F.when(F.col("l_returnflag") == "A", 850).when(F.col("l_returnflag") == "N", 500).otherwise(250)
    return table(spark, sf, "lineitem").groupBy(
        F.to_date(F.trunc(F.to_date("l_shipdate"), "month")).alias("time"), level.alias("level"), *_cell()
    ).agg(*_fields())
