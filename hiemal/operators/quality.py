"""Rule, climatological, temporal and spatial quality control of station series."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import quantile as q
from ..functions.numeric import changed, first_match
from ..functions.text import pack_codes
from ..plans.ordered import family_quantiles
from .climatology import pooled_moments

def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# ---------------------------------------------------------------- first pass
# fixed values: flag codes of the first pass, in output order
CODES = {
    "TMIN_MISSING": "tmin_missing", "TMAX_MISSING": "tmax_missing", "TMIN_ZERO": "tmin_zero",
    "TMIN_PHYSICAL_RANGE": "tmin_physical_range", "TMAX_PHYSICAL_RANGE": "tmax_physical_range",
    "TMAX_LT_TMIN": "tmax_lt_tmin", "DTR_ZERO": "dtr_zero", "DTR_HIGH": "dtr_high",
    "OLD_DUPLICATE_CONFLICT": "duplicate_conflict", "SOURCE_NUMERIC_CONFLICT": "source_numeric_conflict",
    "METADATA_PENDING": "metadata_pending",
}


def first_pass(df: DataFrame, tmin_range=(-5.0, 40.0), tmax_range=(0.0, 50.0), high_range: float = 30.0, zero_tol: float = 1e-9,
               season=(12, 1, 2), expected_missing_from: int = 9999) -> DataFrame:
    """Boolean rule flags, flag codes, priority and status; one projection, no shuffle.

    Needs date, tmin, tmax; ``reconciliation_status``, ``duplicate_status`` and
    ``metadata_pending`` are used when present.
    """
    tmin, tmax = F.col("tmin"), F.col("tmax")
    has = set(df.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("")
    both = tmin.isNotNull() & tmax.isNotNull()
    zero = _true(F.abs(tmin) <= zero_tol)
    rng = tmax - tmin
    flags = {
        "tmin_missing": tmin.isNull(), "tmax_missing": tmax.isNull(),
        "tmax_missing_expected": tmax.isNull() & (F.year("date") >= expected_missing_from),
        "tmin_zero": zero, "tmin_zero_season": zero & F.month("date").isin(*season),
        "tmin_physical_range": _true(~tmin.between(*tmin_range)), "tmax_physical_range": _true(~tmax.between(*tmax_range)),
        "tmax_lt_tmin": both & _true(rng < 0), "dtr_zero": both & _true(F.abs(rng) <= zero_tol),
        "dtr_high": both & _true(rng > high_range),
        "duplicate_conflict": text("duplicate_status").contains("conflict"),
        "source_numeric_conflict": text("reconciliation_status").contains("numeric_conflict"),
        "source_duplicate_conflict": text("reconciliation_status").contains("conflicting_duplicate"),
        "metadata_pending": _true(F.col("metadata_pending")) if "metadata_pending" in has else F.lit(False),
    }
    out = df.select(*[c for c in df.columns if c != "metadata_pending"], rng.alias("diurnal_range"),
                    *[c.alias(k) for k, c in flags.items()])
    f = F.col
    critical = f("tmin_physical_range") | f("tmax_physical_range") | f("tmax_lt_tmin") | f("duplicate_conflict")
    high = f("tmin_zero_season") | f("source_numeric_conflict") | f("source_duplicate_conflict")
    soft = f("tmin_zero") | f("dtr_zero") | f("dtr_high")
    codes, n = pack_codes({code: f(col) for code, col in CODES.items()})
    return (
        out.withColumn("review_required", critical | high | soft)
        .withColumn("priority", first_match([(critical, "critical"), (high, "high"), (soft, "review"),
                                             (f("metadata_pending"), "metadata_pending")], "none"))
        .withColumn("status", first_match([(f("review_required"), "review_required"), (f("metadata_pending"), "metadata_pending"),
                                           (f("tmin_missing") | f("tmax_missing"), "pass_with_missing_data")], "pass_stage1"))
        .withColumn("flag_codes", codes).withColumn("flag_count", n))


# ---------------------------------------------------------------- review ledgers
# fixed values: decisions a value ledger may hold
VALUE_DECISIONS = ("keep", "set_tmin_missing", "set_tmax_missing", "set_both_missing", "select_old_tmin", "select_new_tmin")


def review_ledger(flagged: DataFrame, keys: list[str], kind: str = "VALUE") -> DataFrame:
    """Rows that need review with a stable id built from their key, and a recommended action."""
    parts = [F.date_format(k, "yyyy-MM-dd") if k == "date" else F.col(k).cast("string") for k in keys]
    action = first_match([
        (F.col("tmax_lt_tmin") | F.col("dtr_zero"), "check_pair"), (F.col("tmin_physical_range") | F.col("tmax_physical_range"), "check_value"),
        (F.col("tmin_zero"), "verify_zero"), (F.col("duplicate_conflict") | F.col("source_numeric_conflict"), "choose_source"),
    ], "keep_unless_evidence")
    return (flagged.filter("review_required")
            .withColumn("review_id", F.concat_ws("|", F.lit(kind), *parts)).withColumn("recommended_action", action)
            .withColumn("review_status", F.lit("pending")))


def automatic_decisions(ledger: DataFrame, tmin_range=(-5.0, 40.0), min_range: float = 0.5, high_range: float = 30.0,
                        zero_tol: float = 1e-9, min_change: float = 1e-6) -> DataFrame:
    """Keep, set missing or switch source, by plausibility of the alternates.

    Needs tmin, tmax, old_value, new_value and the first-pass flags.
    """
    tmax, tmin = F.col("tmax"), F.col("tmin")

    def plausible(x: Column) -> Column:
        ok = x.between(*tmin_range) & (F.abs(x) > zero_tol)
        pair = tmax.isNull() | (tmax - x).between(min_range, high_range)
        return _true(ok & pair)

    def alternate(x: Column) -> Column:
        return plausible(x) & (tmin.isNull() | (F.abs(x - tmin) > min_change))

    new, old, f = F.col("new_value"), F.col("old_value"), F.col
    swap = [(alternate(new), "select_new_tmin"), (alternate(old), "select_old_tmin")]

    def ladder(when: Column, options, default):
        return [(when & c, d) for c, d in options] + [(when, default)]

    rules = [(f("tmin_physical_range") & f("tmax_physical_range"), "set_both_missing")]
    rules += ladder(f("tmax_lt_tmin"), swap, "set_both_missing")
    rules += ladder(f("dtr_zero"), swap, "set_both_missing")
    rules += ladder(f("tmin_physical_range") | f("tmin_zero"), swap, "set_tmin_missing")
    rules += [(f("tmax_physical_range"), "set_tmax_missing")]
    rules += ladder(f("duplicate_conflict"), [(plausible(new), "select_new_tmin")], "set_tmin_missing")
    rules += ladder(f("source_numeric_conflict") | f("source_duplicate_conflict"),
                    [(plausible(new), "select_new_tmin"), (plausible(old), "select_old_tmin")], "set_tmin_missing")
    return (ledger.withColumn("decision", first_match(rules, "keep")).withColumn("review_status", F.lit("completed"))
            .withColumn("decision_reason", F.concat(F.lit("rule:"), F.coalesce(F.element_at(F.split("flag_codes", ";"), 1), F.lit("none"))))
            .withColumn("reviewer", F.lit("automatic")))


def ledger_issues(ledger: DataFrame, allowed=VALUE_DECISIONS, evidence=("decision_reason", "reviewer")) -> DataFrame:
    """(review_id, issue) rows; an empty result means the ledger may be applied."""
    missing = {"review_id", "review_status", "decision", *evidence} - set(ledger.columns)
    if missing:
        raise ValueError(f"ledger lacks columns {sorted(missing)}")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    word = F.lower(F.trim(F.coalesce(F.col("decision"), F.lit(""))))
    found = F.array_compact(F.array(
        F.when(F.lower(F.trim(F.coalesce(F.col("review_status"), F.lit("")))) != "completed", F.lit("pending")),
        F.when(~word.isin(*allowed), F.lit("invalid_decision")),
        *[F.when(blank(c), F.lit(f"missing_{c}")) for c in evidence]))
    rows = ledger.select("review_id", F.explode(found).alias("issue"))
    twice = ledger.groupBy("review_id").count().filter("count > 1").select("review_id", F.lit("duplicate_review_id").alias("issue"))
    return rows.unionByName(twice)


def apply_value_decisions(df: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Cleaned values beside the originals, with a change mark for the audit."""
    led = ledger.select(*keys, "decision", F.col("old_value").alias("_old"), F.col("new_value").alias("_new"))
    j = df.join(led, keys, "left")
    d = F.coalesce(F.col("decision"), F.lit("not_reviewed"))
    tmin = (F.when(d.isin("set_tmin_missing", "set_both_missing"), F.lit(None).cast("double"))
            .when(d == "select_old_tmin", F.col("_old")).when(d == "select_new_tmin", F.col("_new")).otherwise(F.col("tmin")))
    tmax = F.when(d.isin("set_tmax_missing", "set_both_missing"), F.lit(None).cast("double")).otherwise(F.col("tmax"))
    return (j.withColumn("decision", d).withColumn("tmin_clean", tmin).withColumn("tmax_clean", tmax)
            .withColumn("tmin_changed", changed(F.col("tmin"), F.col("tmin_clean")))
            .withColumn("tmax_changed", changed(F.col("tmax"), F.col("tmax_clean"))).drop("_old", "_new"))


def apply_date_decisions(df: DataFrame, decisions: DataFrame, keys: list[str], value_columns: list[str]) -> DataFrame:
    """Insert rows at corrected dates, replace existing rows, or leave rejected source rows out.

    ``decisions``: keys, date_decision in (reject_row, insert_corrected_date, replace_existing)
    and the value columns. Inserting over an existing key is reported as ``insert_collision``.
    """
    act = decisions.filter(F.col("date_decision") != "reject_row")
    replace = act.filter("date_decision = 'replace_existing'").select(*keys, *value_columns)
    insert = act.filter("date_decision = 'insert_corrected_date'").select(*keys, *value_columns)
    kept = df.select(*keys, *value_columns).join(replace.select(*keys), keys, "left_anti").withColumn("row_origin", F.lit("original"))
    hit = df.select(*keys, F.lit(True).alias("_hit"))
    fresh = insert.join(hit, keys, "left").withColumn(
        "row_origin", F.when(F.col("_hit"), "insert_collision").otherwise("inserted")).drop("_hit")
    return kept.unionByName(replace.withColumn("row_origin", F.lit("replaced"))).unionByName(fresh)


# ---------------------------------------------------------------- baseline and temporal checks
def baseline_coverage(df: DataFrame, key: str, value: str, first: str, last: str, min_years: int) -> DataFrame:
    inside = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col(value).isNotNull()
    years = df.filter(inside).groupBy(key, F.year("date").alias("_y")).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    got = years.groupBy(key).agg(F.min("a").alias("first_date"), F.max("b").alias("last_date"), F.sum("n").alias("observation_count"),
                                 F.count(F.lit(1)).alias("year_count"))
    return df.select(key).distinct().join(got, key, "left").select(
        key, "first_date", "last_date", F.coalesce("observation_count", F.lit(0)).cast("long").alias("observation_count"),
        F.coalesce("year_count", F.lit(0)).cast("long").alias("year_count"),
        (F.coalesce("year_count", F.lit(0)) >= min_years).alias("eligible"))


def climatological_outliers(df: DataFrame, clim: DataFrame, keys: list[str], value: str, min_anomaly: float, min_z: float) -> DataFrame:
    """Outlier where both the anomaly and its robust z are large; a missing baseline is its own flag."""
    j = df.join(clim, keys, "left")
    a = F.col(value) - F.col("clim_median")
    z = a / F.col("clim_scale")
    return j.select(*df.columns, a.alias("anomaly"), z.alias("robust_z"),
                    (F.col(value).isNotNull() & F.col("clim_median").isNull()).alias("climatology_unavailable"),
                    (_true(F.abs(a) >= min_anomaly) & _true(F.abs(z) >= min_z)).alias("climatological_outlier"))


def temporal_checks(df: DataFrame, key: str, value: str, jump: float, spike: float, agree: float) -> DataFrame:
    """Large day-to-day change and isolated spike, only across consecutive dates."""
    w = W.partitionBy(key).orderBy("date")
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    before = F.datediff("date", F.lag("date").over(w)) == 1
    after = F.datediff(F.lead("date").over(w), "date") == 1
    x = F.col(value)
    out = df.withColumn("previous_value", F.when(before, prev)).withColumn("next_value", F.when(after, nxt))
    p, n = F.col("previous_value"), F.col("next_value")
    return (out.withColumn("daily_change", x - p)
            .withColumn("large_daily_change", _true(F.abs(x - p) >= jump))
            .withColumn("isolated_spike", _true((F.abs(x - p) >= spike) & (F.abs(x - n) >= spike) & (F.abs(p - n) <= agree))))


def flat_lines(df: DataFrame, key: str, value: str, min_run: int, decimals: int = 1) -> DataFrame:
    """Runs of the same rounded value; missing values and date gaps break a run."""
    w = W.partitionBy(key).orderBy("date")
    v = F.round(F.col(value), decimals)
    same = _true((v == F.lag(v).over(w)) & (F.datediff("date", F.lag("date").over(w)) == 1))
    out = df.withColumn("_new", F.when(same, 0).otherwise(1))
    out = out.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(W.partitionBy(key, "_run"))
    out = out.withColumn("identical_run_length", F.when(F.col(value).isNull(), 0).otherwise(size).cast("long"))
    return out.withColumn("flat_line", F.col("identical_run_length") >= min_run).drop("_new", "_run")


def carried_without_evidence(df: DataFrame) -> DataFrame:
    """Status of rows that could not be judged; they are kept, never dropped."""
    return df.withColumn("temporal_status", first_match([
        (F.col("climatological_outlier") | F.col("isolated_spike") | F.col("large_daily_change") | F.col("flat_line"), "candidate_for_spatial_qc"),
        (F.col("climatology_unavailable"), "pass_temporal_baseline_unavailable")], "pass_temporal"))


# ---------------------------------------------------------------- spatial checks
def spatial_metrics(candidates: DataFrame, network: DataFrame, values: DataFrame, min_neighbours: int = 3, min_scale: float = 0.5,
                    residual_limit: float = 5.0, z_limit: float = 4.0, support_median: float = 1.0, support_residual: float = 3.0,
                    support_share: float = 0.6, cold_target: float = -1.0, cold_neighbour: float = -0.5) -> DataFrame:
    """Same-day neighbour statistics of candidate rows only.

    ``candidates`` and ``values``: station, date, anomaly; ``network``: id, neighbour (at most k
    rows per station, so a candidate meets at most k values).
    """
    net = network.select(F.col("id").alias("station"), "neighbour")
    v = values.filter("anomaly IS NOT NULL").select(F.col("station").alias("neighbour"), "date", F.col("anomaly").alias("_na"))
    met = candidates.select("station", "date").join(net, "station").join(v, ["neighbour", "date"]).groupBy("station", "date").agg(
        F.array_sort(F.collect_list("_na")).alias("_l"))
    j = candidates.join(met, ["station", "date"], "left").withColumn("_l", F.coalesce("_l", F.array().cast("array<double>")))
    a = F.col("anomaly")
    sign = F.signum(a)
    j = j.withColumn("neighbour_count", F.size("_l")).withColumn("neighbour_median", q.median(F.col("_l")))
    j = j.withColumn("neighbour_mad", q.mad(F.col("_l"), F.col("neighbour_median")))
    same = F.size(F.filter("_l", lambda x: (F.signum(x) == sign) & (sign != 0)))
    j = (j.withColumn("neighbour_min", F.array_min("_l")).withColumn("neighbour_max", F.array_max("_l"))
         .withColumn("same_sign_fraction", F.when(F.size("_l") > 0, same / F.size("_l")))
         .withColumn("neighbour_scale", F.when(F.col("neighbour_mad").isNotNull(), F.greatest(F.lit(1.4826) * F.col("neighbour_mad"), F.lit(min_scale))))
         .withColumn("spatial_residual", a - F.col("neighbour_median")).withColumn("spatial_z", F.col("spatial_residual") / F.col("neighbour_scale")))
    known, enough = a.isNotNull(), F.col("neighbour_count") >= min_neighbours
    med, res = F.col("neighbour_median"), F.abs("spatial_residual")
    support = (known & enough & _true((sign == F.signum(med)) & (a != 0) & (F.abs(med) >= support_median) & (res <= support_residual)
                                      & (F.col("same_sign_fraction") >= support_share)))
    return (j.drop("_l").withColumn("spatial_outlier", known & enough & _true((res >= residual_limit) & (F.abs("spatial_z") >= z_limit)))
            .withColumn("regional_support", support)
            .withColumn("cold_support", support & _true((a <= cold_target) & (med <= cold_neighbour)))
            .withColumn("insufficient_neighbours", known & ~enough))


def spatial_decision(df: DataFrame, value: str = "value", source: str = "source") -> DataFrame:
    """Only isolated outliers are set missing; every other candidate is kept with its reason."""
    decision = first_match([
        (F.col("spatial_outlier"), "set_missing_spatial_outlier"), (F.col("cold_support"), "keep_regional_cold_signal"),
        (F.col("regional_support"), "keep_regional_signal"), (F.col("insufficient_neighbours"), "keep_insufficient_neighbours"),
        (F.col("anomaly").isNull(), "keep_spatial_evidence_unavailable")], "keep_spatially_inconclusive")
    out = df.withColumn("spatial_decision", decision)
    gone = F.col("spatial_decision") == "set_missing_spatial_outlier"
    return (out.withColumn(f"{value}_clean", F.when(~gone, F.col(value)))
            .withColumn(f"{source}_clean", F.when(gone & F.col(value).isNotNull(), "qc_set_missing_spatial_outlier").otherwise(F.col(source)))
            .withColumn("value_changed", changed(F.col(value), F.col(f"{value}_clean"))))


def screen_maximum(df: DataFrame, slot: str, baseline: Column | str, valid_range=(0.0, 45.0), half: int = 7, sd_limit: float = 5.0,
                   min_day_stations: int = 10, departure: float = 10.0) -> DataFrame:
    """Sequential screen of tmax: range, below tmin, calendar SD outlier (rejected); departure from
    the day's median anomaly (flagged, retained). Adds tmax_screened, decision and reason.
    """
    tmax, tmin = F.col("tmax"), F.col("tmin")
    r1 = _true(~tmax.between(*valid_range))
    r2 = ~r1 & _true(tmax < tmin)
    df = df.withColumn("_r", F.when(r1, "physical_range").when(r2, "tmax_below_cleaned_tmin")).withColumn(
        "_x", F.when(~r1 & ~r2, tmax))
    clim = pooled_moments(df.filter(baseline), ["station"], "_x", slot, half, 365)
    j = df.join(clim, ["station", slot], "left")
    dep = F.col("_x") - F.col("mean")
    j = j.withColumn("_out", _true(F.abs(dep / F.when(F.col("sd") != 0, F.col("sd"))) > sd_limit))
    j = j.withColumn("tmax_screened", F.when(~F.col("_out"), F.col("_x"))).withColumn("_a", F.when(~F.col("_out"), dep))
    day = family_quantiles(j, ["date"], "_a", {"_m": 0.5}).select("date", "n_family", "_m")
    j = j.join(day, "date", "left")
    far = _true((F.col("n_family") >= min_day_stations) & (F.abs(F.col("_a") - F.col("_m")) > departure))
    reason = F.coalesce(F.col("_r"), F.when(F.col("_out"), "climatological_outlier").when(far, "spatial_departure"))
    return (j.withColumn("reason", reason)
            .withColumn("decision", F.when(F.col("reason").isNull(), "accepted").when(F.col("reason") == "spatial_departure", "flagged_retained").otherwise("rejected"))
            .drop("_r", "_x", "_out", "_a", "_m", "n_family", "mean", "sd", "n"))


def status_summary(df: DataFrame, by: list[str], flags: list[str], status: str) -> DataFrame:
    """Row counts per group and status with the number of rows under each flag."""
    return df.groupBy(*by, status).agg(F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(f)).alias(f"{f}_count") for f in flags])
