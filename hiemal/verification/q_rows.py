"""Row-level functions and sources."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from ..session import stage_folder
from ..functions import calendar as cal, geo, numeric as num, parse, text
from ..operators.reconcile import distinct_text
from ..sources import delimited, tables
from .registry import (GRID_DAILY_SQL, GRID_MONTHLY_SQL, R, SOURCE_SQL, STATION_DAILY_SQL, STATION_XY_SQL, grid_daily,
                       grid_monthly, query, r6, source_rows, station_daily, station_xy, table)


# ---------------------------------------------------------------- names and identifiers
@query("name_key", "S01", """
SELECT c_custkey AS id, regexp_replace(lower(strip_accents(replace(c_name, 'o', 'ö') || ' St.')), '[^a-z0-9]', '', 'g') AS full_key,
       regexp_replace(lower(c_name || ' (' || c_mktsegment || ')'), '[^a-z0-9]', '', 'g') AS ascii_key
FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    accented = F.concat(F.replace(F.col("c_name"), F.lit("o"), F.lit("ö")), F.lit(" St."))
    return c.select(F.col("c_custkey").alias("id"), text.name_key(accented).alias("full_key"),
                    text.name_key(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")), True).alias("ascii_key"))


@query("identifier_clean", "S02", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS id_text, CAST(o_orderkey AS VARCHAR) AS id_plain FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", parse.clean_identifier(F.col("o_custkey").cast("double").cast("decimal(20,1)")).alias("id_text"),
        parse.clean_identifier(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).alias("id_plain"))


@query("parse_measurement", "S03", f"""WITH {SOURCE_SQL}
SELECT source_no, parse_status, count(*) AS n, {R('sum(value)')} AS total, count(value) AS n_value
FROM source_rows GROUP BY 1, 2""")
def _(spark, sf):
    return source_rows(spark, sf).groupBy("source_no", "parse_status").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"), F.count("value").alias("n_value"))


@query("parse_whole_number", "S04", """
WITH t AS (SELECT CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber = 6 THEN 'x'
  ELSE CAST(l_quantity / 2 AS VARCHAR) END AS raw, l_quantity, l_linenumber FROM lineitem)
SELECT CASE WHEN l_linenumber = 7 THEN 'missing' WHEN l_linenumber = 6 THEN 'non_numeric'
            WHEN l_quantity % 2 <> 0 THEN 'non_integer' ELSE 'valid_integer' END AS status,
       count(*) AS n,
       CAST(sum(CASE WHEN l_linenumber < 6 AND l_quantity % 2 = 0 THEN l_quantity / 2 END) AS BIGINT) AS total
FROM t GROUP BY 1""")
def _(spark, sf):
    raw = (F.when(F.col("l_linenumber") == 7, "").when(F.col("l_linenumber") == 6, "x")
           .otherwise((F.col("l_quantity") / 2).cast("string")))
    return (table(spark, sf, "lineitem").select(parse.parse_whole_number(raw).alias("p"))
            .groupBy(F.col("p.status").alias("status"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("p.value").alias("total")))


@query("parse_date_parts", "S05", """
WITH t AS (SELECT year(l_shipdate) AS y, 1 + CAST(l_quantity AS INT) % 14 AS m, CAST(l_quantity AS INT) - 15 AS d, l_linenumber FROM lineitem),
u AS (SELECT *, try_cast(lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) AS made FROM t)
SELECT CASE WHEN l_linenumber = 7 THEN 'missing_date_component' WHEN l_linenumber = 6 THEN 'invalid_date_component'
            WHEN d < 1 OR made IS NULL THEN 'invalid_calendar_date' ELSE 'valid' END AS status,
       count(*) AS n,
       max(CASE WHEN l_linenumber < 6 AND d >= 1 THEN made END) AS latest
FROM u GROUP BY 1""")
def _(spark, sf):
    q = F.col("l_quantity").cast("int")
    day = (q - 15).cast("string")
    month = F.when(F.col("l_linenumber") == 7, "****").when(F.col("l_linenumber") == 6, "Jan").otherwise(
        (1 + q % 14).cast("string"))
    df = parse.with_date(table(spark, sf, "lineitem"), F.year("l_shipdate").cast("string"), month, day)
    return df.groupBy(F.col("date_status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("latest"))


@query("parse_flag", "S06", """
SELECT o_orderstatus, o_orderpriority,
  CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END AS flag,
  count(*) AS n FROM orders GROUP BY 1, 2, 3""")
def _(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", F.lit(" Yes ")).when(F.col("o_orderstatus") == "O", "0.0").otherwise("maybe")
    raw = F.when(raw == "0.0", F.lit("0")).otherwise(raw)
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", parse.parse_flag(raw).alias("flag")) \
        .groupBy("o_orderstatus", "o_orderpriority", "flag").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- calendars
@query("season_keys", "S07 S10", f"""WITH {STATION_DAILY_SQL}, d AS (SELECT DISTINCT date FROM station_daily),
k AS (SELECT date, year(date) - CASE WHEN month(date) <= 2 THEN 1 ELSE 0 END AS season FROM d)
SELECT date, CAST(season AS INTEGER) AS season, CAST(season AS VARCHAR) || '/' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS label,
  CAST(date_diff('day', make_date(season, 12, 1), date) + 1 AS INTEGER) AS day_index,
  CAST(date_diff('day', make_date(season, 12, 1), make_date(season + 1, 3, 1)) AS INTEGER) AS season_days,
  CAST(year(date) - CASE WHEN month(date) <= 6 THEN 1 ELSE 0 END AS INTEGER) AS cold_half_year
FROM k""")
def _(spark, sf):
    d = station_daily(spark, sf).select("date").distinct()
    return d.select(
        "date", cal.season_year(F.col("date")).alias("season"),
        cal.season_label(cal.season_year(F.col("date"))).alias("label"),
        cal.season_day_index(F.col("date")).alias("day_index"),
        cal.season_length(cal.season_year(F.col("date"))).alias("season_days"),
        cal.season_year(F.col("date"), 6).alias("cold_half_year"))


LEAP = "(year(date) % 4 = 0 AND (year(date) % 100 <> 0 OR year(date) % 400 = 0))"


@query("calendar_slots", "S08 S09", f"""WITH {STATION_DAILY_SQL}, d AS (SELECT DISTINCT date FROM station_daily),
k AS (SELECT date, dayofyear(make_date(2000, month(date), day(date))) AS s366,
  CASE WHEN month(date) = 2 AND day(date) = 29 THEN 59 ELSE dayofyear(date) - CASE WHEN {LEAP} AND dayofyear(date) > 60 THEN 1 ELSE 0 END END AS s365 FROM d)
SELECT date, CAST(s366 AS INTEGER) AS slot_366, CAST(s365 AS INTEGER) AS slot_365, strftime(date, '%m-%d') AS month_day,
  CAST(least(abs(s366 - 15), 366 - abs(s366 - 15)) AS INTEGER) AS from_mid_january FROM k""")
def _(spark, sf):
    d = station_daily(spark, sf).select("date").distinct()
    s = cal.slot_366(F.col("date"))
    return d.select("date", s.alias("slot_366"), cal.slot_365(F.col("date")).alias("slot_365"),
                    cal.month_day(F.col("date")).alias("month_day"),
                    cal.circular_distance(s, F.lit(15)).alias("from_mid_january"))


@query("shift_to_season", "S25", f"""WITH {STATION_DAILY_SQL}, d AS (SELECT DISTINCT date FROM station_daily),
k AS (SELECT date, s.season, s.season + CASE WHEN month(date) >= 7 THEN 0 ELSE 1 END AS y FROM d, (SELECT unnest([1996, 1999, 2003]) AS season) s)
SELECT date, CAST(season AS INTEGER) AS season,
  CAST(least(make_date(y, month(date), 1) + INTERVAL (day(date) - 1) DAY,
             make_date(y, month(date), 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY) AS DATE) AS shifted FROM k""")
def _(spark, sf):
    d = station_daily(spark, sf).select("date").distinct().withColumn("season", F.explode(F.array(*map(F.lit, (1996, 1999, 2003)))))
    return d.select("date", "season", cal.shift_to_season(F.col("date"), F.col("season")).alias("shifted"))


# ---------------------------------------------------------------- arithmetic
@query("unit_conversions", "S11", f"""
SELECT l_orderkey, l_linenumber, {R('l_extendedprice - 273.15')} AS celsius, {R('l_extendedprice / 100.0')} AS hpa,
  {R('l_extendedprice / 9.80665')} AS height, {R('l_extendedprice / 3600.0')} AS watts, {R('l_discount * 1000.0')} AS mm, {R('l_tax * 1.0e6')} AS pvu
FROM lineitem""")
def _(spark, sf):
    p = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(num.kelvin_to_celsius(p)).alias("celsius"), r6(num.pascal_to_hecto(p)).alias("hpa"),
        r6(num.geopotential_to_height(p)).alias("height"), r6(num.joules_to_watts(p)).alias("watts"),
        r6(num.metres_to_mm(F.col("l_discount"))).alias("mm"), r6(num.pv_to_pvu(F.col("l_tax"))).alias("pvu"))


@query("flag_codes", "S12", """
SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_quantity > 45 THEN 'HIGH' END, CASE WHEN l_discount = 0 THEN 'ZERO_DISCOUNT' END,
   CASE WHEN l_returnflag = 'R' THEN 'RETURNED' END) AS codes,
  CAST(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END + CASE WHEN l_discount = 0 THEN 1 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS code_count
FROM lineitem""")
def _(spark, sf):
    codes, n = text.pack_codes({"HIGH": F.col("l_quantity") > 45, "ZERO_DISCOUNT": F.col("l_discount") == 0,
                                "RETURNED": F.col("l_returnflag") == "R"})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", codes.alias("codes"), n.alias("code_count"))


@query("distinct_text_in_order", "S13", f"""WITH {SOURCE_SQL}, f AS (
  SELECT station, date, trim(raw) AS txt, min(src_row) AS r FROM source_rows WHERE trim(raw) <> '' GROUP BY 1, 2, 3)
SELECT k.station, k.date, coalesce(string_agg(f.txt, ';' ORDER BY f.r), '') AS texts
FROM (SELECT DISTINCT station, date FROM source_rows) k LEFT JOIN f ON f.station = k.station AND f.date = k.date GROUP BY 1, 2""")
def _(spark, sf):
    return distinct_text(source_rows(spark, sf), ["station", "date"], "raw", "src_row", "texts")


@query("safe_fraction", "S14", f"""
SELECT l_orderkey, l_linenumber, {R('CASE WHEN l_discount <> 0 THEN l_tax / l_discount END')} AS ratio FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                               r6(num.fraction(F.col("l_tax"), F.col("l_discount"))).alias("ratio"))


@query("change_mask", "S15", """
WITH t AS (SELECT CASE WHEN l_quantity > 40 THEN NULL ELSE l_discount END AS a, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS b FROM lineitem)
SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN abs(a - b) > 0.015 ELSE (a IS NULL) <> (b IS NULL) END AS changed, count(*) AS n FROM t GROUP BY 1""")
def _(spark, sf):
    a = F.when(F.col("l_quantity") <= 40, F.col("l_discount"))
    b = F.when(F.col("l_linenumber") != 1, F.col("l_tax"))
    return table(spark, sf, "lineitem").select(num.changed(a, b, 0.015).alias("changed")).groupBy("changed").agg(F.count(F.lit(1)).alias("n"))


@query("decision_list", "S16", """
SELECT CASE WHEN l_quantity > 45 AND l_returnflag = 'R' THEN 'critical' WHEN l_quantity > 45 THEN 'high' WHEN l_discount = 0 THEN 'review' ELSE 'none' END AS priority,
  count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, sf):
    hi = F.col("l_quantity") > 45
    p = num.first_match([(hi & (F.col("l_returnflag") == "R"), "critical"), (hi, "high"), (F.col("l_discount") == 0, "review")], "none")
    return table(spark, sf, "lineitem").groupBy(p.alias("priority")).agg(F.count(F.lit(1)).alias("n"))


BAND_SQL = """CASE WHEN x IS NULL THEN 'missing' WHEN x <= 4 THEN 'very_severe' WHEN x <= 6 THEN 'severe' WHEN x <= 8 THEN 'moderate'
  WHEN x <= 10 THEN 'mild' ELSE 'above_cold_wave_threshold' END"""
RANK_SQL = "CASE WHEN x IS NULL THEN -1 WHEN x <= 4 THEN 4 WHEN x <= 6 THEN 3 WHEN x <= 8 THEN 2 WHEN x <= 10 THEN 1 ELSE 0 END"


@query("cold_bands", "S17", f"""WITH {SOURCE_SQL}, t AS (SELECT value AS x FROM source_rows)
SELECT {BAND_SQL} AS category, CAST({RANK_SQL} AS INTEGER) AS severity, count(*) AS n FROM t GROUP BY 1, 2""")
def _(spark, sf):
    x = F.col("value")
    return source_rows(spark, sf).groupBy(num.cold_band(x).alias("category"), num.cold_band_rank(x).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("great_circle", "S18", f"""WITH {STATION_XY_SQL}
SELECT station, {R('2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(23.8 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(23.8)) * pow(sin(radians(90.4 - lon) / 2), 2))))')} AS km
FROM station_xy""")
def _(spark, sf):
    return station_xy(spark, sf).select("station", r6(geo.great_circle_km(F.col("lat"), F.col("lon"), F.lit(23.8), F.lit(90.4))).alias("km"))


@query("humidity_and_wind", "S19 S24", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS t, l_quantity - 10 * l_discount AS td, l_discount * 100 AS u, l_tax * 100 AS v, 1000 + l_tax * 100 AS msl, l_extendedprice / 100 AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, {R('100.0 * exp(17.625 * td / (243.04 + td)) / exp(17.625 * t / (243.04 + t))', 5)} AS rh,
 {R('t - td', 5)} AS depression, {R('sqrt(u * u + v * v)', 5)} AS speed,
 {R('msl * exp(-z / (287.05::DOUBLE / 9.80665::DOUBLE * (t + 273.15 + 0.0065 * z / 2.0)))', 5)} AS surface_hpa FROM t""")
def _(spark, sf):
    q = F.col("l_quantity")
    td, u, v = q - 10 * F.col("l_discount"), F.col("l_discount") * 100, F.col("l_tax") * 100
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(num.relative_humidity(q, td), 5).alias("rh"), r6(num.dewpoint_depression(q, td), 5).alias("depression"),
        r6(num.wind_speed(u, v), 5).alias("speed"),
        r6(num.pressure_at_height(F.lit(1000) + v, q, F.col("l_extendedprice") / 100), 5).alias("surface_hpa"))


@query("index_and_duration_labels", "S20 S21 S22", """
WITH t AS (SELECT CAST(l_quantity AS INTEGER) - 25 AS lag, l_linenumber AS dur, (l_quantity - 25) / 20 AS x, year(l_shipdate) AS y FROM lineitem)
SELECT CASE WHEN x >= 0.5 THEN 'el_nino' WHEN x <= -0.5 THEN 'la_nina' ELSE 'neutral' END AS phase,
  CASE WHEN lag < -10 THEN 'extended_precursor_minus45_to_minus11' WHEN lag < 0 THEN 'synoptic_precursor_minus10_to_minus1' WHEN lag < dur THEN 'event_period' ELSE 'post_event' END AS lag_class,
  CASE WHEN dur = 3 THEN 'short' WHEN dur >= 6 THEN 'persistent' ELSE 'intermediate' END AS duration_group,
  CAST(floor((y - 1985) / 10.0) * 10 + 1985 AS INTEGER) AS decade, count(*) AS n FROM t GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    lag, dur = F.col("l_quantity").cast("int") - 25, F.col("l_linenumber")
    return table(spark, sf, "lineitem").groupBy(
        num.index_phase((F.col("l_quantity") - 25) / 20).alias("phase"), num.lag_class(lag, dur).alias("lag_class"),
        num.duration_group(dur).alias("duration_group"), num.decade_bin(F.year("l_shipdate")).alias("decade")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("event_identifiers", "S23", """
SELECT o_orderkey, upper(regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS token,
  upper(regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) || '_' || CAST(year(o_orderdate) AS VARCHAR) || '_' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS event_id
FROM orders""")
def _(spark, sf):
    tok = text.scenario_token(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", tok.alias("token"),
                                             text.event_id(tok, F.year("o_orderdate"), F.month("o_orderdate")).alias("event_id"))


# ---------------------------------------------------------------- sources
@query("preamble_file_rows", "R01", """WITH t AS (SELECT c_nationkey, c_custkey, c_acctbal, CASE WHEN c_nationkey = 3 THEN 'missing_header' WHEN c_nationkey = 4 THEN 'header_mismatch'
   WHEN c_mktsegment = 'FURNITURE' THEN 'field_count' ELSE 'ok' END AS row_status FROM customer)
SELECT c_nationkey AS file_no, row_status, CASE WHEN row_status = 'missing_header' THEN 1 ELSE count(*) END AS n,
  CAST(sum(CASE WHEN row_status = 'ok' THEN c_custkey END) AS BIGINT) AS id_sum, round(sum(CASE WHEN row_status = 'ok' THEN c_acctbal END), 4) AS balance
FROM t GROUP BY 1, 2""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_nationkey")
    body = c.select(k.alias("file"), (F.col("c_custkey") + 10).alias("line_key"),
                    F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"),
                                F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("x,extra")).otherwise(F.lit("x"))).alias("line"))
    files = c.select(k.alias("file")).distinct()
    pre = files.select("file", F.lit(1).cast("long").alias("line_key"), F.lit("Monthly report").alias("line"))
    head = files.filter("file <> 3").select("file", F.lit(5).cast("long").alias("line_key"),
                                            F.when(F.col("file") == 4, "id,amount,note").otherwise("id,balance,note").alias("line"))
    schema = T.StructType().add("id", "long").add("balance", "double").add("note", "string")
    # one text file per nation, preamble and header first, read again by the file reader
    lines = body.unionByName(pre).unionByName(head).repartition("file").sortWithinPartitions("file", "line_key")
    path = f"{stage_folder(spark)}/reports/{uuid.uuid4().hex}"
    lines.select("file", "line").write.partitionBy("file").text(path)
    rows = delimited.read_with_preamble(spark, path, "id,", schema)
    number = F.regexp_extract("file", r"/file=(\d+)/", 1).cast(c.schema["c_nationkey"].dataType)
    return rows.groupBy(number.alias("file_no"), "row_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"), F.round(F.sum("balance"), 4).alias("balance"))


@query("pruned_columnar_read", "R02", f"""
SELECT o_orderpriority, count(*) AS n, {R('avg(o_totalprice)', 4)} AS mean_price FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1""")
def _(spark, sf):
    df = tables.read_table(spark, f"{sf}/orders.parquet", ["o_orderpriority", "o_totalprice", "o_orderdate"])
    return df.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("fixed_format_rows", "R03 R04", """
SELECT s_suppkey, CAST(round(s_acctbal / 7, 2) AS VARCHAR) IS NOT NULL AS has_value,
  CASE WHEN s_acctbal < 1000 THEN '' ELSE printf('%.4f', round(s_acctbal * 3, 4)) END AS balance FROM supplier""")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.lit(True).alias("has_value"),
                                            F.when(F.col("s_acctbal") >= 1000, F.col("s_acctbal") * 3).alias("balance"))
    folder = f"{stage_folder(spark)}/sinks/{uuid.uuid4().hex}"
    kinds = T.StructType().add("s_suppkey", s.schema["s_suppkey"].dataType).add("has_value", "boolean").add("balance", "double")
    tables.write_table(s, f"{folder}/typed", kinds, cluster_by=["s_suppkey"])
    typed = tables.read_table(spark, f"{folder}/typed")
    tables.write_csv(typed, f"{folder}/rows.csv")
    back = tables.read_table(spark, f"{folder}/rows.csv", schema=T.StructType(kinds.fields[:2]).add("balance", "string"))
    return back.withColumn("balance", F.coalesce("balance", F.lit("")))


@query("month_file_coverage", "R05", f"""WITH {GRID_DAILY_SQL}, n AS (
  SELECT DISTINCT 'field_daily_' || strftime(time, '%Y_%m') || '.nc' AS file FROM grid),
p AS (SELECT CAST(regexp_extract(file, '((19|20)[0-9]{{2}})[-_]?(0[1-9]|1[0-2])', 1) AS INTEGER) AS year,
             CAST(regexp_extract(file, '((19|20)[0-9]{{2}})[-_]?(0[1-9]|1[0-2])', 3) AS INTEGER) AS month FROM n)
SELECT CAST(y.y AS INTEGER) AS year, CAST(m.m AS INTEGER) AS month, p.year IS NOT NULL AS present
FROM (SELECT unnest(range(1994, 2003)) AS y) y CROSS JOIN (SELECT unnest(range(1, 13)) AS m) m LEFT JOIN p ON p.year = y.y AND p.month = m.m""")
def _(spark, sf):
    names = grid_daily(spark, sf).select(F.concat(F.lit("field_daily_"), F.date_format("time", "yyyy_MM"), F.lit(".nc")).alias("file")).distinct()
    present = names.select(tables.month_from_name(F.col("file")).alias("m")).select("m.*")
    want = tables.expected_months(spark, 1994, 2002)
    missing = tables.missing_months(want, present).withColumn("present", F.lit(False))
    return want.join(present.distinct().withColumn("present", F.lit(True)), ["year", "month"]).unionByName(missing)


@query("grid_rows_for_event_dates", "R06", f"""WITH {GRID_DAILY_SQL}
SELECT time, count(*) AS cells, {R('avg(t)')} AS mean_t FROM grid WHERE time IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 400000) GROUP BY 1""")
def _(spark, sf):
    want = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.to_date("o_orderdate").alias("date"))
    return tables.rows_for_dates(grid_daily(spark, sf), want).groupBy("time").agg(F.count(F.lit(1)).alias("cells"), r6(F.avg("t")).alias("mean_t"))


@query("month_inventory", "R07 R08", f"""WITH {GRID_DAILY_SQL}, m AS (
 SELECT CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, count(DISTINCT time) AS day_count, min(time) AS first_date, max(time) AS last_date, count(*) AS row_count,
   count(CASE WHEN n > 1 THEN t END) AS finite_count, string_agg(DISTINCT CAST(CAST(lat AS INTEGER) AS VARCHAR), ',' ORDER BY CAST(CAST(lat AS INTEGER) AS VARCHAR)) AS levels FROM grid GROUP BY 1, 2),
e AS (SELECT *, make_date(year, month, 1) AS s, CAST(make_date(year, month, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS f FROM m)
SELECT year, month, day_count, first_date, last_date, row_count, finite_count, levels, CAST(day(f) AS INTEGER) AS expected_days,
 CASE WHEN finite_count = 0 THEN 'empty' WHEN day_count < day(f) THEN 'short' WHEN first_date <> s OR last_date <> f THEN 'misdated' ELSE 'ok' END AS status FROM e""")
def _(spark, sf):
    g = grid_daily(spark, sf).withColumn("t", F.when(F.col("n") > 1, F.col("t")))
    return tables.month_inventory(g, "t", level="lat")


@query("common_dates", "R09", """
SELECT CAST(l_shipdate AS DATE) AS date, count(DISTINCT l_returnflag) AS group_count FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_returnflag")
    return tables.common_dates(d, "l_returnflag", 3)


@query("file_checksums", "R07 R10")
def _(spark, sf):
    return tables.file_checksums(spark, sf, "*.parquet")


@query("merged_month_parts", "R12", """
WITH a AS (SELECT 0 AS p, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <= 3
 UNION ALL SELECT 1, CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber > 3)
SELECT date, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY p, l_orderkey, l_linenumber, l_quantity) AS rn FROM a) WHERE rn = 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_quantity")
    return tables.merge_parts([li.filter("l_linenumber <= 3"), li.filter("l_linenumber > 3")], ["date"], ["l_orderkey", "l_linenumber"])
