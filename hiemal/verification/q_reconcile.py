"""Identity, duplicates and source reconciliation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import reconcile as rc
from .registry import R, SOURCE_SQL, STATION_DAILY_SQL, query, r6, source_rows, station_daily, station_xy, table

KEYS = ["station", "date"]


def _names(spark, sf):
    raw = F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier "))
    names = table(spark, sf, "customer").select(raw.alias("name"), text.name_key(raw, True).alias("name_key"))
    official = table(spark, sf, "supplier").select(text.name_key(F.col("s_name"), True).alias("official_key"),
                                                   F.col("s_suppkey").alias("station"))
    aliases = table(spark, sf, "nation").select(
        F.format_string("supplier%09d", F.col("n_nationkey") + 100).alias("name_key"),
        F.format_string("supplier%09d", F.pmod(F.col("n_nationkey"), F.lit(7))).alias("alias_target"))
    return names, official, aliases


NAMES_SQL = """names AS (SELECT replace(c_name, 'Customer', 'Supplier ') AS name, regexp_replace(lower(replace(c_name, 'Customer', 'Supplier ')), '[^a-z0-9]', '', 'g') AS name_key FROM customer),
off AS (SELECT regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS official_key, s_suppkey AS station FROM supplier),
ali AS (SELECT printf('supplier%09d', n_nationkey + 100) AS name_key, printf('supplier%09d', n_nationkey % 7) AS alias_target FROM nation)"""


@query("name_crosswalk", "C01", f"""WITH {NAMES_SQL}
SELECT n.name, n.name_key, o.station, CASE WHEN o.station IS NULL THEN 'unmatched' WHEN a.alias_target IS NOT NULL THEN 'manual_alias' ELSE 'normalized_exact' END AS match_method,
  CASE WHEN o.station IS NOT NULL THEN 100.0::DOUBLE END AS match_score, o.station IS NULL AS action_required
FROM names n LEFT JOIN ali a USING (name_key) LEFT JOIN off o ON o.official_key = coalesce(a.alias_target, n.name_key)""")
def _(spark, sf):
    return rc.crosswalk(*_names(spark, sf))


@query("name_suggestions", "C01")
def _(spark, sf):
    names, official, aliases = _names(spark, sf)
    cw = rc.crosswalk(names, official, aliases).filter("action_required")
    return rc.suggest_names(cw, official).withColumn("suggestion_score", r6("suggestion_score", 4))


@query("identity_extension", "C02", f"""WITH {NAMES_SQL}, f AS (SELECT name_key, min(name) AS found FROM names GROUP BY 1),
k AS (SELECT regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS name_key, CAST(s_suppkey AS VARCHAR) AS st, s_name FROM supplier WHERE s_acctbal > 0)
SELECT coalesce(k.name_key, f.name_key) AS name_key, coalesce(st, 'PROV_' || substr(sha256(f.name_key), 1, 12)) AS station_uid, coalesce(s_name, found) AS name,
  CASE WHEN st IS NULL THEN 'provisional' WHEN found IS NULL THEN 'known_only' ELSE 'matched' END AS identity_status
FROM k FULL OUTER JOIN f ON k.name_key = f.name_key""")
def _(spark, sf):
    names, _, _ = _names(spark, sf)
    known = table(spark, sf, "supplier").filter("s_acctbal > 0").select(
        text.name_key(F.col("s_name"), True).alias("name_key"), F.col("s_suppkey").alias("station"), F.col("s_name").alias("name"))
    return rc.extend_identity(known, names)


@query("metadata_issues", "C03", """
WITH m AS (SELECT CASE WHEN p_size = 50 THEN NULL WHEN p_size = 49 THEN 7 ELSE p_partkey END AS station, p_name AS name_key,
   CASE WHEN p_size <> 1 THEN p_retailprice / 50 END AS lat, 90.0::DOUBLE AS lon FROM part)
SELECT station, 'duplicate_id' AS issue FROM m WHERE station IS NOT NULL GROUP BY station HAVING count(*) > 1
UNION ALL SELECT station, 'duplicate_name_key' FROM m WHERE name_key IN (SELECT name_key FROM m GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT station, 'blank_id' FROM m WHERE station IS NULL
UNION ALL SELECT station, 'missing_coordinates' FROM m WHERE lat IS NULL
UNION ALL SELECT station, 'coordinates_out_of_range' FROM m WHERE lat NOT BETWEEN 20 AND 27.5""")
def _(spark, sf):
    p = table(spark, sf, "part")
    st = F.when(F.col("p_size") == 49, F.lit(7).cast("long")).when(F.col("p_size") != 50, F.col("p_partkey"))
    m = p.select(st.alias("station"), F.col("p_name").alias("name_key"),
                 F.when(F.col("p_size") != 1, F.col("p_retailprice") / 50).alias("lat"), F.lit(90.0).alias("lon"))
    return rc.metadata_issues(m, (20.0, 27.5), (88.0, 93.5))


def _wide(spark, sf):
    d = station_daily(spark, sf)
    aggs = [F.max(F.when(F.dayofmonth("date") == i, F.col("tmin").cast("int").cast("string"))).alias(f"Day{i}") for i in range(1, 32)]
    w = d.groupBy("station", F.year("date").alias("year"), F.month("date").alias("month")).agg(*aggs)
    return w.withColumn("Day31", F.coalesce("Day31", F.when(F.col("month") == 2, F.lit("**"))))


@query("month_rows_to_days", "C04", f"""WITH {STATION_DAILY_SQL}, w AS (SELECT DISTINCT station, year(date) AS year, month(date) AS month FROM station_daily),
c AS (SELECT w.station, w.year, w.month, d.day FROM w, (SELECT unnest(range(1, 32)) AS day) d),
x AS (SELECT c.*, try_cast(printf('%04d-%02d-%02d', c.year, c.month, c.day) AS DATE) AS date FROM c),
j AS (SELECT x.*, coalesce(CAST(CAST(floor(s.tmin) AS INTEGER) AS VARCHAR), CASE WHEN x.month = 2 AND x.day = 31 THEN '**' END) AS raw
  FROM x LEFT JOIN station_daily s ON s.station = x.station AND s.date = x.date)
SELECT station, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(day AS INTEGER) AS day, date,
  CASE WHEN date IS NULL THEN 'invalid_calendar_date' ELSE 'valid' END AS date_status, raw,
  try_cast(raw AS DOUBLE) AS value, CASE WHEN raw IS NULL THEN 'missing_cell' WHEN raw = '**' THEN 'missing_code' ELSE 'numeric' END AS parse_status
FROM j WHERE date IS NOT NULL OR raw IS NOT NULL""")
def _(spark, sf):
    return rc.month_rows_to_days(_wide(spark, sf), ["station"])


@query("repeated_station_months", "C05", """
SELECT l_suppkey AS station, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS row_count FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    rows = source_rows(spark, sf).filter("source_no = 0").withColumn("month", F.to_date(F.trunc("date", "month")))
    return rc.repeated_keys(rows, ["station", "month"])


COLLAPSE_SQL = f"""{SOURCE_SQL}, sig AS (SELECT *, coalesce(CAST(value AS VARCHAR), '~') || '|' || parse_status || '|' || raw AS s FROM source_rows),
fr AS (SELECT *, row_number() OVER (PARTITION BY source_no, station, date ORDER BY src_row, s) AS rn FROM sig),
collapsed AS (SELECT source_no, station, date, count(*) AS source_row_count, min(src_row) AS first_source_row, max(src_row) AS last_source_row,
  CASE WHEN count(*) = 1 THEN 'unique' WHEN count(DISTINCT s) = 1 THEN 'exact_duplicate_same_value' ELSE 'conflicting_duplicate' END AS duplicate_status,
  CASE WHEN count(DISTINCT s) = 1 THEN max(CASE WHEN rn = 1 THEN value END) END AS value,
  CASE WHEN count(DISTINCT s) = 1 THEN max(CASE WHEN rn = 1 THEN parse_status END) ELSE 'duplicate_conflict' END AS parse_status
  FROM fr GROUP BY 1, 2, 3)"""


def collapsed(spark, sf, n):
    return rc.collapse_duplicates(source_rows(spark, sf).filter(F.col("source_no") == n), KEYS)


@query("collapsed_duplicates", "C06", f"WITH {COLLAPSE_SQL} SELECT * FROM collapsed")
def _(spark, sf):
    return rc.collapse_duplicates(source_rows(spark, sf), ["source_no", *KEYS])


@query("duplicate_source_rows", "C06", """WITH n AS (SELECT DISTINCT l_linenumber % 2 AS source_no, l_suppkey AS station, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS r FROM lineitem),
g AS (SELECT *, r - row_number() OVER (PARTITION BY source_no, station ORDER BY r) AS g FROM n) SELECT source_no, station, min(r) AS first_row, max(r) AS last_row, count(*) AS run_rows FROM g GROUP BY source_no, station, g""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 2).alias("source_no"), F.col("l_suppkey").alias("station"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("src_row"))
    return rc.source_row_runs(rows, ["source_no", "station"])


@query("all_source_rows_of_orders", "C06", """WITH n AS (SELECT DISTINCT o_orderstatus AS status, CAST(o_orderkey AS BIGINT) AS r FROM orders),
g AS (SELECT *, r - row_number() OVER (PARTITION BY status ORDER BY r) AS g FROM n) SELECT status, min(r) AS first_row, max(r) AS last_row, count(*) AS run_rows FROM g GROUP BY status, g""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("src_row"))
    return rc.source_row_runs(rows, ["status"])


RECONCILED_SQL = COLLAPSE_SQL + """, rec0 AS (
 SELECT coalesce(o.station, n.station) AS station, coalesce(o.date, n.date) AS date, o.value AS old_value, n.value AS new_value, o.station IS NOT NULL AS has_o, n.station IS NOT NULL AS has_n,
  coalesce(o.duplicate_status, '') = 'conflicting_duplicate' AS clash
 FROM (SELECT * FROM collapsed WHERE source_no = 0) o FULL OUTER JOIN (SELECT * FROM collapsed WHERE source_no = 1) n ON o.station = n.station AND o.date = n.date),
rec1 AS (SELECT *, CASE WHEN new_value = 0 THEN 'new_zero_requires_review' WHEN clash AND new_value IS NOT NULL THEN 'old_conflicting_duplicate_new_selected'
  WHEN clash THEN 'old_conflicting_duplicate_unresolved'
  WHEN has_o AND has_n THEN CASE WHEN old_value IS NOT NULL AND new_value IS NOT NULL THEN CASE WHEN abs(new_value - old_value) <= 1e-6 THEN 'exact_agreement' ELSE 'numeric_conflict_new_selected' END
     WHEN new_value IS NOT NULL THEN 'new_fills_old_missing' WHEN old_value IS NOT NULL THEN 'old_fills_new_missing' ELSE 'both_missing' END
  WHEN has_n THEN CASE WHEN new_value IS NOT NULL THEN 'new_only_record' ELSE 'new_only_missing' END
  WHEN old_value IS NOT NULL THEN 'old_only_record' ELSE 'old_only_missing' END AS reconciliation_status FROM rec0),
reconciled AS (SELECT station, date, old_value, new_value, new_value - old_value AS difference, abs(new_value - old_value) AS absolute_difference, reconciliation_status,
  CASE WHEN reconciliation_status IN ('new_zero_requires_review','old_conflicting_duplicate_new_selected','exact_agreement','numeric_conflict_new_selected','new_fills_old_missing','new_only_record') THEN new_value
       WHEN reconciliation_status IN ('old_fills_new_missing','old_only_record') THEN old_value END AS selected_value,
  CASE WHEN reconciliation_status IN ('new_zero_requires_review','old_conflicting_duplicate_new_selected','exact_agreement','numeric_conflict_new_selected','new_fills_old_missing','new_only_record') THEN 'new_csv'
       WHEN reconciliation_status IN ('old_fills_new_missing','old_only_record') THEN 'old_xlsx' ELSE 'none' END AS selected_source,
  reconciliation_status NOT IN ('exact_agreement','new_fills_old_missing','old_fills_new_missing','both_missing') AS review_required FROM rec1)"""


def reconciled(spark, sf):
    return rc.reconcile(collapsed(spark, sf, 0), collapsed(spark, sf, 1), KEYS)


@query("reconciled_sources", "C07", f"WITH {RECONCILED_SQL} SELECT * FROM reconciled")
def _(spark, sf):
    return reconciled(spark, sf)


@query("precedence_merge", "C08", f"""WITH {COLLAPSE_SQL}, j AS (
 SELECT coalesce(o.station, n.station) AS station, coalesce(o.date, n.date) AS date, o.value AS ov, n.value AS nv
 FROM (SELECT * FROM collapsed WHERE source_no = 0) o FULL OUTER JOIN (SELECT * FROM collapsed WHERE source_no = 1) n ON o.station = n.station AND o.date = n.date)
SELECT station, date, CASE WHEN date >= DATE '1999-01-01' AND nv IS NOT NULL THEN nv ELSE ov END AS value,
 CASE WHEN date >= DATE '1999-01-01' AND nv IS NOT NULL THEN 'new' WHEN ov IS NOT NULL THEN 'old' ELSE 'none' END AS value_source FROM j""")
def _(spark, sf):
    return rc.precedence_merge(collapsed(spark, sf, 0), collapsed(spark, sf, 1), KEYS, "1999-01-01")


@query("overlap_agreement", "C09", f"""WITH {COLLAPSE_SQL}
SELECT CAST(year(o.date) AS INTEGER) AS year, count(*) AS pairs, {R('100.0 * avg(CASE WHEN abs(n.value - o.value) < 0.05 THEN 1.0 ELSE 0.0 END)')} AS identical_percent,
 {R('100.0 * avg(CASE WHEN abs(n.value - o.value) <= 0.5 THEN 1.0 ELSE 0.0 END)')} AS within_half_percent, {R('avg(n.value - o.value)')} AS mean_difference, {R('max(abs(n.value - o.value))')} AS largest_difference
FROM (SELECT * FROM collapsed WHERE source_no = 0 AND value IS NOT NULL) o JOIN (SELECT * FROM collapsed WHERE source_no = 1 AND value IS NOT NULL) n ON o.station = n.station AND o.date = n.date GROUP BY 1""")
def _(spark, sf):
    d = rc.overlap_agreement(collapsed(spark, sf, 0), collapsed(spark, sf, 1), KEYS, [F.year("date").alias("year")])
    return d.select("year", "pairs", *[r6(c).alias(c) for c in ("identical_percent", "within_half_percent", "mean_difference", "largest_difference")])


@query("stacked_segments", "C10", f"""WITH {COLLAPSE_SQL}
SELECT station, date, value AS tmin, 'none' AS note, CAST(first_source_row AS INTEGER) AS source_row, 'early' AS record_origin FROM collapsed WHERE source_no = 0 AND date < DATE '1998-01-01'
UNION ALL SELECT station, date, value, duplicate_status, NULL, 'late' FROM collapsed WHERE source_no = 1 AND date >= DATE '1998-01-01'""")
def _(spark, sf):
    early = collapsed(spark, sf, 0).filter("date < DATE '1998-01-01'").select(*KEYS, F.col("value").alias("tmin"), F.col("first_source_row").alias("source_row"))
    late = collapsed(spark, sf, 1).filter("date >= DATE '1998-01-01'").select(*KEYS, F.col("value").alias("tmin"), F.col("duplicate_status").alias("note"))
    return rc.stack_segments([("early", early), ("late", late)],
                             {"station": "long", "date": "date", "tmin": "double", "note": "string", "source_row": "int"}, {"note": "none"})


@query("metadata_attached", "C11", f"""WITH {STATION_DAILY_SQL}
SELECT station, date, s_name AS name, CASE WHEN s_suppkey IS NULL THEN 'unmatched' ELSE 'matched' END AS metadata_status
FROM station_daily LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 500) s ON s.s_suppkey = station""")
def _(spark, sf):
    meta = table(spark, sf, "supplier").filter("s_acctbal > 500").select(F.col("s_suppkey").alias("station"), F.col("s_name").alias("name"))
    return rc.attach_metadata(station_daily(spark, sf).select(*KEYS), meta, "station")


@query("first_row_per_key", "C12", f"""WITH {SOURCE_SQL}
SELECT station, date, src_row, raw, value, parse_status, source_no FROM (SELECT *, row_number() OVER (PARTITION BY station, date ORDER BY src_row, source_no, raw, value, parse_status) AS rn FROM source_rows) WHERE rn = 1""")
def _(spark, sf):
    return rc.first_per_key(source_rows(spark, sf), KEYS, ["src_row"])


@query("source_composition", "C13", f"""WITH {RECONCILED_SQL}, n AS (SELECT station, selected_source, count(*) AS row_count FROM reconciled GROUP BY 1, 2)
SELECT station, selected_source, row_count, {R('100.0 * row_count / sum(row_count) OVER (PARTITION BY station)')} AS percent,
  row_number() OVER (PARTITION BY station ORDER BY row_count DESC, selected_source) = 1 AS dominant FROM n""")
def _(spark, sf):
    return rc.source_composition(reconciled(spark, sf), ["station"], "selected_source").withColumn("percent", r6("percent"))
