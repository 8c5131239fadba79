"""Identity, duplicate rows and reconciliation of overlapping sources."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import first_match
from ..functions.parse import parse_measurement, parse_whole_number
from ..session import stage_table

AGREEMENT = 1e-6
ZERO = 1e-12


# ---------------------------------------------------------------- names
def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-integer row per character of b."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _lcs(a, b) / total


_BEST = "name_key string, suggested_key string, suggestion_score double"
DELETIONS = ((1, 256), (2, 48))  # characters left out by each step of the index, of keys up to this length


def _remainders(key: Column, gone: int) -> Column:
    """Distinct texts that are left of ``key`` without 0 to ``gone`` of its characters."""
    def shorter(t):
        n = F.length(t)
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n)))

    last = F.array(key)
    out = [last]
    for _ in range(gone):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        out.append(last)
    return F.array_distinct(F.concat(*out))


def _score(common: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common / total)


def _near_names(asked: DataFrame, keys: DataFrame, gone: int, longest: int, lengths: list[int]) -> DataFrame:
    """(name_key, _b, _settled): the best official key that has a remainder in common, and whether no other pair can reach its score.

    Of the official keys with one remainder and length only the smallest is kept: they all have the same score by it. So no pair
    rows arise but one for each remainder and length.
    """
    n, deletions = F.length("name_key"), lambda m: F.when(m <= longest, F.lit(gone)).otherwise(F.lit(-1))

    def unseen(m):
        common = F.least(n, m, F.greatest(n - deletions(n) - 1, m - deletions(m) - 1))
        return F.when(common >= 0, _score(common, n + m)).otherwise(F.lit(-1.0))

    index = (keys.filter(F.length("official_key") <= longest).select("official_key", F.explode(_remainders(F.col("official_key"), gone)).alias("_text"))
             .groupBy("_text", F.length("official_key").alias("_m")).agg(F.min("official_key").alias("key")))
    hits = asked.filter(n <= longest).select("name_key", F.explode(_remainders(F.col("name_key"), gone)).alias("_text"))
    hits = hits.join(index.hint("merge"), "_text")  # Spark sizes both sides as before their explodes and would broadcast one
    hits = hits.select("name_key", F.struct((-_score(F.length("_text"), n + F.col("_m"))).alias("loss"), "key").alias("_b"))
    found = asked.join(hits.groupBy("name_key").agg(F.min("_b").alias("_b")), "name_key", "left")
    bound = F.array_max(F.transform(F.array(*[F.lit(m) for m in lengths]), unseen))
    return found.withColumn("_settled", F.coalesce(-F.col("_b.loss") > bound, F.lit(False)))


def _best_in_pool(asked: pa.Table, pool: pa.Table) -> pa.Table:
    """Best key of one pool for every key of one block; a bit row of the common subsequence for each key of the pool."""
    cands = sorted(pool.column("official_key").to_pylist())
    sizes = np.array([len(c) for c in cands])
    letters = {ch: i for i, ch in enumerate(sorted(set("".join(cands))), 1)}
    codes = np.zeros((max(sizes, default=0), len(cands)), np.int64)
    for j, c in enumerate(cands):
        codes[:len(c), j] = [letters[ch] for ch in c]
    out = []
    for key in asked.column("name_key").to_pylist() if cands else []:
        if len(key) > 64:
            scores = np.array([indel_ratio(key, c) for c in cands])
        else:
            where = np.zeros(len(letters) + 1, np.uint64)
            for i, ch in enumerate(key):
                where[letters.get(ch, 0)] |= np.uint64(1 << i)
            where[0] = 0
            full = np.uint64((1 << len(key)) - 1)
            row = np.full(len(cands), full)
            for line in codes:
                hit = row & where[line]
                row = (row + hit) | (row - hit)
            total = len(key) + sizes
            scores = np.where(total == 0, 100.0, 200.0 * (len(key) - np.bitwise_count(row & full).astype(np.int64)) / np.maximum(total, 1))
        at = int(np.argmax(scores))  # the first of the best, which is the smallest key
        out.append((key, cands[at], float(scores[at])))
    return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("name_key", pa.string()), ("suggested_key", pa.string()), ("suggestion_score", pa.float64())))})


def _compared(asked: DataFrame, keys: DataFrame, pool_size: int) -> DataFrame:
    """Best official key of every asked key, each block of asked keys beside each pool of official ones as a group of its own."""
    blocks, pools = (max(1, math.ceil(d.count() / pool_size)) for d in (asked, keys))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.select("name_key", part("name_key", blocks).alias("_block"), every(pools).alias("_pool")).groupBy("_block", "_pool")
    k = keys.select("official_key", part("official_key", pools).alias("_pool"), every(blocks).alias("_block")).groupBy("_block", "_pool")
    best = a.cogroup(k).applyInArrow(_best_in_pool, _BEST)
    return best.groupBy("name_key").agg(F.min(F.struct((-F.col("suggestion_score")).alias("loss"), F.col("suggested_key").alias("key"))).alias("_b"))


def suggest_names(unmatched: DataFrame, official: DataFrame, pool_size: int = 2000) -> DataFrame:
    """Best similar official key for every distinct unmatched key; of equal scores the smallest key.

    Two keys have a common subsequence of L characters if both leave the same text of that length when the others are taken out. Texts
    without one and then two characters are joined on equality, which grows with the keys and not with their product. A key leaves
    as soon as no pair outside that index can reach its score; only those without a close official key are compared with all of them,
    in blocks and pools of bounded size.
    """
    keys = stage_table(official.select("official_key").filter("official_key IS NOT NULL").distinct())
    asked = stage_table(unmatched.select("name_key").filter("name_key IS NOT NULL").distinct())
    lengths = sorted(r[0] for r in keys.select(F.length("official_key")).distinct().collect())
    done = []
    for gone, longest in DELETIONS if lengths else ():
        found = stage_table(_near_names(asked, keys, gone, longest, lengths))
        done.append(found.filter("_settled").select("name_key", "_b"))
        asked = found.filter("NOT _settled").select("name_key")
    out = _compared(asked, keys, pool_size)
    for d in done:
        out = out.unionByName(d)
    return out.select("name_key", F.col("_b.key").alias("suggested_key"), (-F.col("_b.loss")).alias("suggestion_score"))


def crosswalk(names: DataFrame, official: DataFrame, aliases: DataFrame) -> DataFrame:
    """Match names (name, name_key) by alias, then by exact key; the rest stay unmatched.

    ``official``: official_key, station; ``aliases``: name_key, alias_target.
    """
    off = official.select("official_key", "station")
    out = names.join(aliases, "name_key", "left").withColumn("official_key", F.coalesce("alias_target", "name_key"))
    out = out.join(off.hint("merge"), "official_key", "left")  # grows with the input, and compressed names are sized too low for a broadcast
    method = first_match([(F.col("station").isNull(), "unmatched"), (F.col("alias_target").isNotNull(), "manual_alias")],
                         "normalized_exact")
    return out.select(
        "name", "name_key", "station", method.alias("match_method"),
        F.when(F.col("station").isNotNull(), F.lit(100.0)).alias("match_score"),
        F.col("station").isNull().alias("action_required"))


def extend_identity(known: DataFrame, found: DataFrame, prefix: str = "PROV") -> DataFrame:
    """Known stations (name_key, station, name) joined with names found in another source.

    Unmatched names get a provisional id derived from the key itself, so ids do not depend on
    which other names are present.
    """
    k = known.select("name_key", F.col("station").cast("string").alias("_station"), F.col("name").alias("_known"))
    f = found.groupBy("name_key").agg(F.min("name").alias("_found"))
    both = k.join(f, "name_key", "full")
    provisional = F.concat(F.lit(prefix + "_"), F.substring(F.sha2("name_key", 256), 1, 12))
    status = first_match([(F.col("_station").isNull(), "provisional"), (F.col("_found").isNull(), "known_only")], "matched")
    return both.select("name_key", F.coalesce("_station", provisional).alias("station_uid"),
                       F.coalesce("_known", "_found").alias("name"), status.alias("identity_status"))


def metadata_issues(meta: DataFrame, lat_range=(-90.0, 90.0), lon_range=(-180.0, 360.0)) -> DataFrame:
    """(station, issue) rows: blank or duplicate id, duplicate name key, bad coordinates."""
    repeated_id = meta.groupBy("station").count().filter("count > 1 AND station IS NOT NULL").select(
        "station", F.lit("duplicate_id").alias("issue"))
    keys = meta.groupBy("name_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name_key")
    repeated_key = meta.join(keys, "name_key", "left_semi").select("station", F.lit("duplicate_name_key").alias("issue"))
    lat, lon = F.col("lat"), F.col("lon")
    rows = meta.select("station", F.explode(F.array_compact(F.array(
        F.when(F.trim(F.coalesce(F.col("station").cast("string"), F.lit(""))) == "", F.lit("blank_id")),
        F.when(lat.isNull() | lon.isNull(), F.lit("missing_coordinates")),
        F.when(~lat.between(*lat_range) | ~lon.between(*lon_range), F.lit("coordinates_out_of_range")),
    ))).alias("issue"))
    return rows.unionByName(repeated_id).unionByName(repeated_key)


# ---------------------------------------------------------------- shape
def month_rows_to_days(wide: DataFrame, keys: list[str], year: str = "year", month: str = "month",
                       day_prefix: str = "Day") -> DataFrame:
    """Month rows with Day1..Day31 text cells to one row per day.

    Cells of days that do not exist stay in the result with status ``invalid_calendar_date`` only
    if they hold text, so nothing written by a station is lost silently.
    """
    # Year and month are parsed once per row; the 31 cells then only compare day numbers.
    df = wide.withColumn("_y", parse_whole_number(F.col(year).cast("string"))["value"]).withColumn(
        "_m", parse_whole_number(F.col(month).cast("string"))["value"])
    first = F.when(F.col("_m").between(1, 12) & F.col("_y").between(1, 9999), F.make_date("_y", "_m", F.lit(1)))
    df = df.withColumn("_first", first).withColumn("_days", F.coalesce(F.dayofmonth(F.last_day("_first")), F.lit(0)))
    cells = F.array(*[F.struct(F.lit(d).alias("day"), F.col(f"{day_prefix}{d}").alias("raw")) for d in range(1, 32)])
    long = df.select(*keys, F.col(year), F.col(month), "_first", "_days", F.inline(cells))
    real = F.col("day") <= F.col("_days")
    long = long.filter(real | (F.trim(F.coalesce("raw", F.lit(""))) != "")).withColumn("_p", parse_measurement(F.col("raw")))
    return long.select(
        *keys, year, month, "day", F.when(real, F.date_add("_first", F.col("day") - 1)).alias("date"),
        F.when(real, "valid").otherwise("invalid_calendar_date").alias("date_status"), "raw",
        F.col("_p.value").alias("value"), F.col("_p.status").alias("parse_status"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def distinct_text(df: DataFrame, keys: list[str], text: str, order: str, out: str, sep: str = ";") -> DataFrame:
    """Distinct non-blank texts per key joined in the order of their first row."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    first = df.groupBy(*keys, t.alias("_t")).agg(F.min(order).alias("_o"))
    entry = F.when(F.col("_t") != "", F.struct(F.col("_o"), F.col("_t")))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    return listed.select(*keys, F.concat_ws(sep, F.transform("_l", lambda x: x["_t"])).alias(out))


def collapse_duplicates(rows: DataFrame, keys: list[str], value: str = "value", status: str = "parse_status",
                        raw: str = "raw", order: str = "src_row") -> DataFrame:
    """One row per key without choosing between rows that disagree.

    Everything is a mergeable aggregate, so a key repeated many times is reduced before the
    shuffle. A row's signature is its value, status and raw text; disagreement means the smallest
    and largest signature differ.
    """
    sig = F.struct(F.coalesce(F.col(value).cast("string"), F.lit("~")), F.coalesce(status, F.lit("~")), F.coalesce(raw, F.lit("~")))
    rank = F.struct(order, sig)
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_row_count"), F.min(order).alias("first_source_row"), F.max(order).alias("last_source_row"),
        F.min(sig).alias("_lo"), F.max(sig).alias("_hi"),
        F.min_by(value, rank).alias("_v"), F.min_by(status, rank).alias("_s"))
    dup = first_match([(F.col("source_row_count") == 1, "unique"), (F.col("_lo") == F.col("_hi"), "exact_duplicate_same_value")],
                      "conflicting_duplicate")
    g = g.withColumn("duplicate_status", dup)
    clash = F.col("duplicate_status") == "conflicting_duplicate"
    return g.select(
        *keys, "source_row_count", "first_source_row", "last_source_row", "duplicate_status",
        F.when(~clash, F.col("_v")).alias("value"),
        F.when(clash, "duplicate_conflict").otherwise(F.col("_s")).alias("parse_status"))


def source_row_runs(rows: DataFrame, keys: list[str], order: str = "src_row", stretch: int = 1 << 16) -> DataFrame:
    """(keys, first_row, last_row, run_rows): every source row number of every key, as maximal runs of consecutive numbers.

    The numbers of a key are never packed into one row. Runs are found inside stretches of ``stretch`` numbers; only those at an
    edge of their stretch, at most two for each, are joined up by a window over the key. Repeated numbers count once; rows without a
    number are left out.
    """
    n = F.col(order).cast("long")
    d = rows.where(F.col(order).isNotNull()).select(*keys, n.alias("_n"), F.floor(n / stretch).alias("_p")).distinct()
    inside = W.partitionBy(*keys, "_p").orderBy("_n")
    d = d.withColumn("_g", F.col("_n") - F.row_number().over(inside))
    runs = d.groupBy(*keys, "_p", "_g").agg(F.min("_n").alias("first_row"), F.max("_n").alias("last_row")).drop("_g")
    edge = (F.pmod("first_row", F.lit(stretch)) == 0) | (F.pmod("last_row", F.lit(stretch)) == stretch - 1)
    along = W.partitionBy(*keys).orderBy("first_row")
    touching = runs.where(edge).withColumn("_new", (F.col("first_row") != F.lag("last_row", 1, None).over(along) + 1).cast("int"))
    joined = touching.withColumn("_g", F.sum(F.coalesce("_new", F.lit(1))).over(along)).groupBy(*keys, "_g").agg(F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"))
    out = runs.where(~edge).select(*keys, "first_row", "last_row").unionByName(joined.drop("_g"))
    return out.withColumn("run_rows", F.col("last_row") - F.col("first_row") + 1)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order``, as an aggregate instead of a window sort.

    Rows that tie on ``order`` are told apart by their other columns.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


# ---------------------------------------------------------------- two sources
def reconcile(old: DataFrame, new: DataFrame, keys: list[str], tolerance: float = AGREEMENT) -> DataFrame:
    """Full outer reconciliation of a collapsed old source and a collapsed new source.

    Inputs have ``value`` and ``duplicate_status``. The order of the rules matters: a zero in the
    new source is looked at first, then unresolved duplicates of the old source.
    """
    o = old.select(*keys, F.col("value").alias("old_value"), F.col("duplicate_status").alias("old_duplicate_status"),
                   F.lit(True).alias("_o"))
    n = new.select(*keys, F.col("value").alias("new_value"), F.lit(True).alias("_n"))
    j = o.join(n, keys, "full")
    has_o, has_n = F.col("_o").isNotNull(), F.col("_n").isNotNull()
    num_o, num_n = F.col("old_value").isNotNull(), F.col("new_value").isNotNull()
    clash = F.coalesce(F.col("old_duplicate_status") == "conflicting_duplicate", F.lit(False))
    gap = F.col("new_value") - F.col("old_value")
    # fixed values: reconciliation outcomes
    status = first_match([
        (num_n & (F.abs("new_value") <= ZERO), "new_zero_requires_review"),
        (clash & num_n, "old_conflicting_duplicate_new_selected"),
        (clash, "old_conflicting_duplicate_unresolved"),
        (has_o & has_n & num_o & num_n & (F.abs(gap) <= tolerance), "exact_agreement"),
        (has_o & has_n & num_o & num_n, "numeric_conflict_new_selected"),
        (has_o & has_n & num_n, "new_fills_old_missing"),
        (has_o & has_n & num_o, "old_fills_new_missing"),
        (has_o & has_n, "both_missing"),
        (has_n & num_n, "new_only_record"),
        (has_n, "new_only_missing"),
        (has_o & num_o, "old_only_record"),
    ], "old_only_missing")
    j = j.withColumn("reconciliation_status", status)
    s = F.col("reconciliation_status")
    takes_new = s.isin("new_zero_requires_review", "old_conflicting_duplicate_new_selected", "exact_agreement",
                       "numeric_conflict_new_selected", "new_fills_old_missing", "new_only_record")
    takes_old = s.isin("old_fills_new_missing", "old_only_record")
    quiet = s.isin("exact_agreement", "new_fills_old_missing", "old_fills_new_missing", "both_missing")
    return j.select(
        *keys, "old_value", "new_value", gap.alias("difference"), F.abs(gap).alias("absolute_difference"), s,
        F.when(takes_new, F.col("new_value")).when(takes_old, F.col("old_value")).alias("selected_value"),
        F.when(takes_new, "new_csv").when(takes_old, "old_xlsx").otherwise("none").alias("selected_source"),
        (~quiet).alias("review_required"))


def precedence_merge(old: DataFrame, new: DataFrame, keys: list[str], cutover: str, date: str = "date") -> DataFrame:
    """Before the cutover the old source only; from it on the new source where it has a value."""
    j = (old.select(*keys, F.col("value").alias("_o")).join(new.select(*keys, F.col("value").alias("_n")), keys, "full"))
    use_new = (F.col(date) >= F.lit(cutover).cast("date")) & F.col("_n").isNotNull()
    value = F.when(use_new, F.col("_n")).otherwise(F.col("_o"))
    return j.select(*keys, value.alias("value"),
                    F.when(value.isNull(), "none").when(use_new, "new").otherwise("old").alias("value_source"))


def overlap_agreement(old: DataFrame, new: DataFrame, keys: list[str], by: list[Column | str]) -> DataFrame:
    """Agreement of two sources on the keys where both have a value."""
    j = (old.filter("value IS NOT NULL").select(*keys, F.col("value").alias("_o"))
         .join(new.filter("value IS NOT NULL").select(*keys, F.col("value").alias("_n")), keys))
    d = F.col("_n") - F.col("_o")
    share = lambda c: F.lit(100.0) * F.avg(F.when(c, 1.0).otherwise(0.0))
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), share(F.abs(d) < 0.05).alias("identical_percent"),
        share(F.abs(d) <= 0.5).alias("within_half_percent"), F.avg(d).alias("mean_difference"),
        F.max(F.abs(d)).alias("largest_difference"))


def stack_segments(segments: list[tuple[str, DataFrame]], columns: dict[str, str],
                   defaults: dict[str, object]) -> DataFrame:
    """Period segments aligned to one typed column list; absent columns take defaults."""
    out = None
    for name, seg in segments:
        cols = []
        for c, dtype in columns.items():
            x = F.col(c).cast(dtype) if c in seg.columns else F.lit(None).cast(dtype)
            cols.append((F.coalesce(x, F.lit(defaults[c]).cast(dtype)) if c in defaults else x).alias(c))
        part = seg.select(*cols, F.lit(name).alias("record_origin"))
        out = part if out is None else out.unionByName(part)
    return out


def attach_metadata(rows: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Left join of metadata with a ``metadata_status``; unmatched rows are kept and marked."""
    m = meta.withColumn("_hit", F.lit(True))
    return (rows.join(m, key, "left")
            .withColumn("metadata_status", F.when(F.col("_hit"), "matched").otherwise("unmatched")).drop("_hit"))


def require_matched(rows: DataFrame) -> DataFrame:
    """The same rows; the job fails if any of them has no metadata."""
    ok = F.assert_true(F.col("metadata_status") == "matched", F.lit("row without station metadata"))
    return rows.filter(ok.isNull())


def source_composition(df: DataFrame, group: list[str], source: str) -> DataFrame:
    """Rows and percent per source in a group, and whether it is the dominant source."""
    n = df.groupBy(*group, source).agg(F.count(F.lit(1)).alias("row_count"))
    w = W.partitionBy(*group)
    n = n.withColumn("percent", F.lit(100.0) * F.col("row_count") / F.sum("row_count").over(w))
    first = F.row_number().over(w.orderBy(F.desc("row_count"), source))
    return n.withColumn("dominant", first == 1)
