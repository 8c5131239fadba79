"""Run detection, event catalogues and comparisons of event sets.

Days of one season are one window partition, so no partition holds more than a season of rows per
rule set, however many seasons, scenarios, sectors or stations there are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.single import attach
from ..functions import calendar as cal
from ..functions.numeric import duration_group, first_match, lag_class
from ..functions.text import event_id as make_id
from ..plans.ordered import minimum_rank
from ..session import cut_lineage


def assign_runs(daily: DataFrame, keys: list[str], flag: str, min_days: int | Column, date: str = "date") -> DataFrame:
    """Label runs of consecutive flagged dates inside each key group.

    Adds candidate_run_length (kept for short runs), qualifying, event_seq and event_day. A date
    gap breaks a run.
    """
    hit = F.coalesce(F.col(flag), F.lit(False))
    d = daily.withColumn("_f", hit)
    order = W.partitionBy(*keys, "_f").orderBy(date)
    d = d.withColumn("_i", F.when(F.col("_f"), F.unix_date(F.col(date)) - F.row_number().over(order)))
    run = W.partitionBy(*keys, "_f", "_i")
    d = d.withColumn("candidate_run_length", F.when(F.col("_f"), F.count(F.lit(1)).over(run)).otherwise(0).cast("long"))
    d = d.withColumn("qualifying", F.col("_f") & (F.col("candidate_run_length") >= min_days))
    d = d.withColumn("event_day", F.when(F.col("qualifying"), F.row_number().over(run.orderBy(date))))
    first = F.when(F.col("event_day") == 1, 1).otherwise(0)
    seq = F.sum(first).over(W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("event_seq", F.when(F.col("qualifying"), seq)).drop("_f", "_i")


def bridge_gaps(daily: DataFrame, keys: list[str], base: str, usable: str, share: str, marginal: Column, date: str = "date") -> DataFrame:
    """Mark single non-base usable days between two contiguous base days whose share is marginal."""
    w = W.partitionBy(*keys).orderBy(date)
    b = F.coalesce(F.col(base), F.lit(False))
    before = F.coalesce(F.lag(b).over(w), F.lit(False)) & (F.datediff(F.col(date), F.lag(date).over(w)) == 1)
    after = F.coalesce(F.lead(b).over(w), F.lit(False)) & (F.datediff(F.lead(date).over(w), F.col(date)) == 1)
    bridge = F.coalesce(F.col(usable) & ~b & (F.col(share) >= marginal) & before & after, F.lit(False))
    return daily.withColumn("bridge_day", bridge).withColumn("candidate_day", b | F.col("bridge_day"))


def sweep(daily: DataFrame, scenarios: list[dict], season: str = "season", usable: str = "usable", date: str = "date", keep: list[str] | None = None) -> DataFrame:
    """Event days of the same daily table under several rule sets.

    Each scenario: id, column, share, min_days and optionally marginal (one-day gap bridging).
    The short scenario list is exploded beside every day, so all rule sets run in one job.
    """
    spec = F.array(*[F.struct(
        F.lit(s["id"]).alias("scenario"), F.lit(float(s["share"])).alias("_share"), F.lit(int(s["min_days"])).alias("_min"),
        F.lit(s.get("marginal")).cast("double").alias("_marginal"), F.col(s["column"]).cast("double").alias("area_share")) for s in scenarios])
    d = daily.select(date, season, usable, *(keep or []), F.inline(spec)).withColumn("area_share", F.round("area_share", 9))
    d = d.withColumn("base_day", F.col(usable) & F.coalesce(F.col("area_share") >= F.col("_share"), F.lit(False)))
    keys = ["scenario", season]
    d = bridge_gaps(d, keys, "base_day", usable, "area_share", F.col("_marginal"), date)
    d = assign_runs(d, keys, "candidate_day", F.col("_min"), date)
    return d.withColumn("event_id", F.when(F.col("qualifying"), make_id(F.col("scenario"), F.col(season), F.col("event_seq")))).drop("_share", "_min", "_marginal")


def catalogue(days: DataFrame, keys: list[str], metrics: dict[str, list[str]], peak: str, tie: str, date: str = "date") -> DataFrame:
    """One row per event: dates, duration, chosen statistics of metrics, and the peak day.

    The peak day has the largest ``peak``, then the largest ``tie``, then the earliest date.
    """
    fn = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum}
    aggs = [F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("duration_days"),
            F.max_by(date, F.struct(F.round(peak, 9), F.col(tie), -F.unix_date(F.col(date)))).alias("peak_date")]
    for c, stats in metrics.items():
        aggs += [fn[s](c).alias(f"{s}_{c}") for s in stats]
    out = days.filter("event_id IS NOT NULL").groupBy(*keys, "event_id").agg(*aggs)
    return out.withColumn("duration_group", duration_group(F.col("duration_days")))


def event_days(cat: DataFrame, before: int = 0, after: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Every day from ``before`` days ahead of the onset to ``after`` days past the end, with its offset."""
    day = F.explode(F.sequence(F.date_sub("start_date", before), F.date_add("end_date", after)))
    return cat.select("event_id", *(keep or []), "start_date", "end_date", day.alias("date")).withColumn("offset", F.datediff("date", "start_date"))


# ---------------------------------------------------------------- joins back to stations
def with_membership(rows: DataFrame, days: DataFrame, cold: str = "cold") -> DataFrame:
    """Station-days with the event of their date and whether the station took part in it."""
    d = days.filter("event_id IS NOT NULL").select("date", "event_id", "event_day")
    j = rows.join(d, "date", "left")
    return j.withColumn("participates", F.coalesce(F.col("event_id").isNotNull() & F.col(cold), F.lit(False)))


def footprint(members: DataFrame, weights: DataFrame) -> DataFrame:
    """Area ever affected in each event; cells do not overlap, so distinct stations' weights add up."""
    hit = members.filter("participates").select("event_id", "station").distinct()
    return hit.join(weights.select("station", "weight"), "station").groupBy("event_id").agg(
        F.count(F.lit(1)).alias("station_count"), F.sum("weight").alias("footprint_area"))


def footprint_shape(members: DataFrame, points: DataFrame) -> DataFrame:
    """Centroid and east-west / north-south extent (km) of the region points ever affected."""
    hit = members.filter("participates").select("event_id", "station").distinct()
    km = 111.195
    p = points.withColumn("_x", F.col("lon") * F.cos(F.radians("lat")) * F.lit(km)).withColumn("_y", F.col("lat") * F.lit(km))
    # points are summed per station first, so the join carries one row per event and station
    per = p.groupBy("station").agg(
        F.sum("area").alias("a"), F.sum(F.col("lat") * F.col("area")).alias("la"), F.sum(F.col("lon") * F.col("area")).alias("lo"),
        F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"))
    return hit.join(per, "station").groupBy("event_id").agg(
        (F.sum("la") / F.sum("a")).alias("centroid_lat"), (F.sum("lo") / F.sum("a")).alias("centroid_lon"),
        (F.max("x1") - F.min("x0")).alias("east_west_km"), (F.max("y1") - F.min("y0")).alias("north_south_km"))


def participation(members: DataFrame, cat: DataFrame, weights: DataFrame) -> DataFrame:
    """Per event and station: cold days, first and last, lowest value, deficits, weighted days, share."""
    hit = members.filter("participates").groupBy("event_id", "station").agg(
        F.count(F.lit(1)).alias("cold_days"), F.min("date").alias("first_cold_date"), F.max("date").alias("last_cold_date"),
        F.min("value").alias("lowest_value"), F.sum("deficit").alias("total_deficit"))
    j = hit.join(cat.select("event_id", "duration_days"), "event_id").join(weights.select("station", "weight"), "station")
    return j.withColumn("weighted_days", F.col("cold_days") * F.col("weight")).withColumn("share_of_event", F.col("cold_days") / F.col("duration_days"))


def catalogue_issues(days: DataFrame, cat: DataFrame, min_days: int, min_share: float, share: str = "cold_area", usable: str = "usable") -> DataFrame:
    """(event_id, issue) rows; an empty result means every invariant holds."""
    e = days.filter("event_id IS NOT NULL")
    per = e.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("nd"), F.min("date").alias("a"), F.max("date").alias("b"),
                                    F.min(F.round(share, 9)).alias("low"), F.max(share).alias("high"), F.count_if(~F.col(usable)).alias("bad"))
    j = per.join(cat.select("event_id", "start_date", "end_date", "duration_days"), "event_id", "full")
    found = F.array_compact(F.array(
        F.when(F.col("n").isNull() | F.col("duration_days").isNull(), F.lit("missing_side")),
        F.when(F.datediff("b", "a") + 1 != F.col("nd"), F.lit("not_contiguous")), F.when(F.col("n") != F.col("nd"), F.lit("repeated_date")),
        F.when((F.col("start_date") != F.col("a")) | (F.col("end_date") != F.col("b")) | (F.col("duration_days") != F.col("n")), F.lit("catalogue_differs")),
        F.when(F.col("n") < min_days, F.lit("too_short")), F.when(F.col("low") < min_share, F.lit("below_threshold")),
        F.when((F.col("high") > 1 + 1e-9) | (F.col("low") < 0), F.lit("share_out_of_range")), F.when(F.col("bad") > 0, F.lit("unusable_day"))))
    return j.select("event_id", F.explode(found).alias("issue"))


def season_summary(cat: DataFrame, seasons: DataFrame, keys: list[str]) -> DataFrame:
    """Events per season, with zeros for seasons that have none."""
    g = cat.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), F.sum("duration_days").alias("event_day_count"), F.max("duration_days").alias("longest_event"),
                               F.avg("duration_days").alias("mean_duration"))
    j = seasons.join(g, keys, "left")
    return j.select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("event_count", "event_day_count", "longest_event")], "mean_duration")


# ---------------------------------------------------------------- comparisons
def compare_sets(primary: DataFrame, other: DataFrame, season: str = "season", by: list[str] | None = None, reproduced_at: float = 0.5) -> DataFrame:
    """Best match in ``other`` for every primary event; unmatched events stay with zeros.

    Both inputs are event days (event_id, season, date); ``by`` names columns of ``other`` that
    tell several compared sets apart. Days are joined on (season, date), never event by event.
    """
    by = by or []
    p = primary.select("event_id", season, "date").distinct()
    o = other.select(*by, F.col("event_id").alias("matching_event_id"), season, "date").distinct()
    np_ = p.groupBy("event_id").agg(F.count(F.lit(1)).alias("primary_duration"))
    no = o.groupBy(*by, "matching_event_id").agg(F.count(F.lit(1)).alias("matching_duration"))
    m = p.join(o, [season, "date"]).groupBy(*by, "event_id", "matching_event_id").agg(F.count(F.lit(1)).alias("intersection_days"))
    m = m.join(np_, "event_id").join(no, [*by, "matching_event_id"])
    m = (m.withColumn("jaccard", F.col("intersection_days") / (F.col("primary_duration") + F.col("matching_duration") - F.col("intersection_days")))
         .withColumn("primary_overlap", F.col("intersection_days") / F.col("primary_duration"))
         .withColumn("matching_overlap", F.col("intersection_days") / F.col("matching_duration")))
    w = W.partitionBy(*by, "event_id")
    best = F.row_number().over(w.orderBy(F.desc("intersection_days"), F.desc("jaccard"), F.desc("primary_overlap"), "matching_event_id"))
    m = m.withColumn("overlapping_events", F.count(F.lit(1)).over(w)).withColumn("_r", best).filter("_r = 1").drop("_r", "primary_duration")
    base = np_
    if by:
        sets = F.collect_set(F.struct(*by)).alias("_sets")
        base = attach(np_, o.agg(sets)).select(
            "event_id", "primary_duration", F.inline("_sets"))
    j = base.join(m, [*by, "event_id"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("overlapping_events", "intersection_days", "matching_duration")]
    share = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("primary_overlap", "matching_overlap", "jaccard")]
    exact = F.coalesce((F.col("intersection_days") == F.col("primary_duration")) & (F.col("intersection_days") == F.col("matching_duration")), F.lit(False))
    return j.select(*by, "event_id", "primary_duration", F.coalesce("matching_event_id", F.lit("")).alias("matching_event_id"), *zero, *share,
                    exact.alias("exact_match"), F.coalesce(F.col("primary_overlap") >= reproduced_at, F.lit(False)).alias("reproduced"))


def signature_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Start, end and length of events found in only one of two catalogues; empty when equal."""
    sig = lambda d: d.select("start_date", "end_date", F.col("duration_days").cast("long").alias("duration_days"))
    return (sig(a).exceptAll(sig(b)).withColumn("side", F.lit("first_only"))
            .unionByName(sig(b).exceptAll(sig(a)).withColumn("side", F.lit("second_only"))))


def robustness(matches: DataFrame, scenario: str = "scenario", high: float = 0.8, moderate: float = 0.5) -> DataFrame:
    g = matches.groupBy("event_id").agg(
        F.count_distinct(scenario).alias("scenarios_tested"), F.count_if("reproduced").alias("scenarios_reproduced"), F.count_if("exact_match").alias("exact_matches"),
        F.avg("primary_overlap").alias("mean_overlap"), F.min("primary_overlap").alias("lowest_overlap"), F.avg("jaccard").alias("mean_jaccard"))
    share = F.col("scenarios_reproduced") / F.col("scenarios_tested")
    return g.withColumn("robust_fraction", share).withColumn("robustness_class", first_match([(share >= high, "high"), (share >= moderate, "moderate")], "low"))


def strength_ranks(cat: DataFrame, metrics: list[str]) -> DataFrame:
    """Competition rank per metric (largest first), their sum, and the rank of the sum."""
    base = cut_lineage(cat)  # ranked twice below; a catalogue is far smaller than what it came from
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    ranked = minimum_rank(base.select("event_id", F.inline(entries)), ["metric"], "x", "r")
    wide = cut_lineage(ranked.groupBy("event_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("r"))).alias(f"{m}_rank") for m in metrics], F.sum("r").alias("rank_sum")))
    return base.join(minimum_rank(wide, [], "rank_sum", "strength_rank", descending=False), "event_id")


def freeze(cat: DataFrame, robust: DataFrame, before: int = 10, after: int = 10) -> DataFrame:
    """Catalogue with robustness and the analysis window around each event."""
    return (cat.join(robust.select("event_id", "robust_fraction", "robustness_class"), "event_id", "left")
            .withColumn("window_start", F.date_sub("start_date", before)).withColumn("window_end", F.date_add("end_date", after)))


def overlap_flags(a: DataFrame, b: DataFrame) -> DataFrame:
    """Catalogue ``a`` with ``overlaps``: shares at least one day with an event of ``b``."""
    days_b = event_days(b).select("date").distinct()
    hit = event_days(a).select("event_id", "date").join(days_b, "date", "left_semi").select("event_id").distinct()
    return a.join(hit.withColumn("overlaps", F.lit(True)), "event_id", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def pure_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """Events of ``a`` without any day in common with ``b``."""
    return overlap_flags(a, b).filter(~F.col("overlaps")).drop("overlaps")


def day_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Event days in both catalogues or in one only, by class."""
    x = event_days(a).select("date").distinct().withColumn("_a", F.lit(True))
    y = event_days(b).select("date").distinct().withColumn("_b", F.lit(True))
    j = x.join(y, "date", "full")
    return j.select("date", F.when(F.col("_b").isNull(), "first_only").when(F.col("_a").isNull(), "second_only").otherwise("shared").alias("day_class"))


# ---------------------------------------------------------------- lags
def event_lags(cat: DataFrame, first: int, last: int, keep: list[str] | None = None) -> DataFrame:
    """Event x lag rows from onset with date, month-day key and lag class."""
    out = cat.select("event_id", *(keep or []), "start_date", "end_date", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("lag"))
    out = out.withColumn("date", F.date_add("start_date", F.col("lag"))).withColumn("month_day", F.date_format("date", "MM-dd"))
    return out.withColumn("lag_class", lag_class(F.col("lag"), F.datediff("end_date", "start_date") + 1))


def lag_coverage(lags: DataFrame, available: DataFrame) -> DataFrame:
    """Available and missing dates per event and lag class."""
    a = available.select("date").distinct().withColumn("_ok", F.lit(True))
    j = lags.join(a, "date", "left")
    return j.groupBy("event_id", "lag_class").agg(F.count(F.lit(1)).alias("day_count"), F.count("_ok").alias("available_count")).withColumn(
        "complete", F.col("day_count") == F.col("available_count"))


# ---------------------------------------------------------------- sign reversals
def sign_reversals(daily: DataFrame, value: str, refractory: int = 20, recovery: int = 10, months=(11, 12, 1, 2, 3), last_month: int = 4,
                   keys: list[str] | None = None, date: str = "date") -> DataFrame:
    """First negative day after a non-negative one, with a refractory and a final rule.

    A candidate is final (rejected) unless a positive run of ``recovery`` rows fits before the end
    of April. Among the others one is accepted per stretch between completed positive runs of
    ``refractory`` rows: neither the last accepted date nor the next candidate is positive, so a
    long run lies between them exactly when more long runs are complete at the candidate.
    """
    keys = keys or []
    w = W.partitionBy(*keys).orderBy(date)
    x = F.col(value)
    d = daily.filter(x.isNotNull())
    d = d.withColumn("_pos", x > 0).withColumn("_n", F.row_number().over(w))
    d = d.withColumn("_run", F.when(F.col("_pos"), F.col("_n") - F.row_number().over(W.partitionBy(*keys, "_pos").orderBy(date))))
    runs = W.partitionBy(*keys, "_pos", "_run")
    d = d.withColumn("_at", F.when(F.col("_pos"), F.row_number().over(runs.orderBy(date))))
    d = d.withColumn("_done", F.sum(F.when(F.col("_at") == refractory, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    prev_ok = (F.datediff(F.col(date), F.lag(date).over(w)) == 1) & (F.lag(value).over(w) >= 0)
    d = d.withColumn("_cand", F.coalesce((x < 0) & prev_ok & F.month(date).isin(*months), F.lit(False)))
    # earliest later date on which some positive run reaches `recovery` rows
    later = W.partitionBy(*keys).orderBy(F.desc(date)).rowsBetween(W.unboundedPreceding, -1)
    nxt = F.min(F.when(F.col("_at") == recovery, F.col(date))).over(later)
    limit = F.last_day(F.make_date(F.year(date) + F.when(F.month(date) <= last_month, 0).otherwise(1), F.lit(last_month), F.lit(1)))
    d = d.withColumn("_ok", F.col("_cand") & F.coalesce(nxt <= limit, F.lit(False)))
    c = d.filter("_ok")
    first = F.row_number().over(W.partitionBy(*keys, "_done").orderBy(date))
    return c.withColumn("_f", first).filter("_f = 1").select(*keys, F.col(date).alias("central_date"), F.col(value).alias("central_value"))


def reversal_attributes(found: DataFrame, daily: DataFrame, value: str, index: str, days: int = 10, date: str = "date") -> DataFrame:
    """Length of the negative run, lowest value of the next days, index mean of the previous days."""
    w = W.orderBy(date)
    d = daily.filter(F.col(value).isNotNull()).withColumn("_neg", F.col(value) < 0)
    d = d.withColumn("_g", F.row_number().over(w) - F.row_number().over(W.partitionBy("_neg").orderBy(date)))
    length = d.filter("_neg").groupBy("_g").agg(F.min(date).alias("central_date"), F.count(F.lit(1)).alias("negative_run_days"))
    near = found.select("central_date", F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_o")).withColumn(date, F.date_add("central_date", F.col("_o")))
    got = near.join(daily.select(date, value, index), date).groupBy("central_date").agg(
        F.min(F.when(F.col("_o") >= 0, F.col(value))).alias("lowest_next"), F.avg(F.when(F.col("_o") <= 0, F.col(index))).alias("mean_previous"))
    return found.join(length.select("central_date", "negative_run_days"), "central_date", "left").join(got, "central_date", "left")


def nearest_dates(reference: DataFrame, found: DataFrame, ref: str = "reference_date", got: str = "central_date") -> DataFrame:
    """Nearest found date of every reference date with offset and match classes.

    Found dates are packed per year (at most one entry per day); a reference looks at its own
    year and at the closest dates of the nearest non-empty years, which always include the nearest.
    """
    y = found.select(F.col(got).alias("_d")).distinct().groupBy(F.year("_d").alias("_y")).agg(F.collect_list("_d").alias("_own"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    years = y.select("_y", "_own", "_lo", "_hi").unionByName(
        reference.select(F.year(ref).alias("_y")).distinct().join(y.select("_y"), "_y", "left_anti"), allowMissingColumns=True)
    w = W.orderBy("_y")
    years = years.withColumn("_before", F.last("_hi", True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn(
        "_after", F.first("_lo", True).over(w.rowsBetween(1, W.unboundedFollowing)))
    j = reference.withColumn("_y", F.year(ref)).join(years, "_y")
    pool = F.array_compact(F.concat(F.coalesce("_own", F.array().cast("array<date>")), F.array("_before", "_after")))
    best = F.array_min(F.transform(pool, lambda d: F.struct(F.abs(F.datediff(d, F.col(ref))).alias("gap"), d.alias("d"))))
    j = j.withColumn("_b", best)
    off = F.datediff(F.col("_b.d"), F.col(ref))
    return j.select(*reference.columns, F.col("_b.d").alias("nearest_date"), off.alias("offset_days"), (F.abs(off) == 0).alias("exact_match"),
                    (F.abs(off) <= 1).alias("within_1_day"), (F.abs(off) <= 2).alias("within_2_days"))


# ---------------------------------------------------------------- episodes and periods
def episodes(daily: DataFrame, keys: list[str], value: str, limit: str, min_days: int, date: str = "date") -> DataFrame:
    """Runs of a daily index above its limit: dates, duration, mean, max, excess sum, peak date."""
    d = daily.withColumn("_above", F.coalesce(F.col(value) > F.col(limit), F.lit(False)))
    d = assign_runs(d, keys, "_above", min_days, date).filter("qualifying")
    over = F.col(value) - F.col(limit)
    return d.groupBy(*keys, "event_seq").agg(
        F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("duration_days"), F.avg(value).alias("mean_value"),
        F.max(value).alias("max_value"), F.sum(over).alias("excess_sum"), F.max_by(date, F.struct(F.col(value), -F.unix_date(F.col(date)))).alias("peak_date"))


def period_summary(cat: DataFrame, period: Column) -> DataFrame:
    """Events, mean and median duration and group counts per period."""
    return cat.groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("event_count"), F.avg("duration_days").alias("mean_duration"), F.percentile("duration_days", 0.5).alias("median_duration"),
        F.count_if(F.col("duration_days") >= 6).alias("persistent_events"), F.count_if(F.col("duration_days") == 3).alias("short_events"))
