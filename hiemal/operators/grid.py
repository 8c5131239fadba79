"""Gridded fields as long tables (time, level, lat, lon, values)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import fraction, pressure_at_height
from .events import assign_runs

EARTH_M = 6.371e6

# fixed values: names of coordinates in source files and their one convention
COORDINATES = {"valid_time": "time", "latitude": "lat", "longitude": "lon", "pressure_level": "level", "level_hpa": "level"}


# ---------------------------------------------------------------- shape
def standardise(grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One coordinate convention, longitude in 0..360, one row per repeated longitude."""
    from .reconcile import first_per_key
    g = grid.withColumnsRenamed({k: v for k, v in COORDINATES.items() if k in grid.columns})
    g = g.withColumn("_raw_lon", F.col("lon")).withColumn("lon", F.pmod(F.col("lon").cast("double"), F.lit(360.0)))
    keys = keys or [c for c in ("time", "level", "lat", "lon") if c in g.columns]
    return first_per_key(g, keys, ["_raw_lon"]).drop("_raw_lon")


def collapse_versions(grid: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """First non-missing value by version, for every value column."""
    return grid.groupBy(*keys).agg(*[F.min_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(version))).alias(v) for v in values])


def box(lat0: float, lat1: float, lon0: float, lon1: float) -> Column:
    return F.col("lat").between(lat0, lat1) & F.col("lon").between(lon0, lon1)


def nearest_level(grid: DataFrame, target: float, level: str = "level") -> DataFrame:
    """Rows of the level closest to ``target`` at each time."""
    best = grid.groupBy("time").agg(F.min(F.struct(F.abs(F.col(level) - target), F.col(level))).alias("_b"))
    return grid.join(best.select("time", F.col("_b")[level].alias(level)), ["time", level])


def cos_lat() -> Column:
    return F.cos(F.radians("lat"))


def weighted_mean(value: Column, where: Column | None = None) -> Column:
    """Cosine-latitude mean as an aggregate; missing values carry no weight."""
    ok = value.isNotNull() if where is None else value.isNotNull() & where
    return fraction(F.sum(F.when(ok, value * cos_lat())), F.sum(F.when(ok, cos_lat())))


def area_fraction(cond: Column, valid: Column) -> Column:
    """Share of the valid area where a condition holds."""
    return fraction(F.sum(F.when(valid, F.when(cond, cos_lat()).otherwise(0.0))), F.sum(F.when(valid, cos_lat())))


def cap_mean(grid: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Zonal mean first, then the cosine-weighted mean over latitudes."""
    z = grid.groupBy(*keys, "lat").agg(F.avg(value).alias("_z"))
    return z.groupBy(*keys).agg(weighted_mean(F.col("_z")).alias(value))


# ---------------------------------------------------------------- time windows
def daily_means(df: DataFrame, keys: list[str], time: str, values: list[str], samples: int) -> DataFrame:
    """Daily means of days with exactly the expected number of sub-daily samples."""
    g = df.groupBy(*keys, F.to_date(time).alias("date")).agg(F.count(F.lit(1)).alias("sample_count"), *[F.avg(v).alias(v) for v in values])
    return g.filter(F.col("sample_count") == samples)


def day_night_windows(df: DataFrame, keys: list[str], time: str, means: list[str], sums: list[str], day_hours=range(0, 12), at: dict[str, int] | None = None) -> DataFrame:
    """Means, sums and hour counts of the day and night window of each UTC date."""
    hour = F.hour(time)
    day = hour.isin(*day_hours)
    aggs = []
    for label, c in (("day", day), ("night", ~day)):
        aggs += [F.avg(F.when(c, F.col(v))).alias(f"{v}_{label}") for v in means] + [F.sum(F.when(c, F.col(v))).alias(f"{v}_{label}_sum") for v in sums]
        aggs.append(F.count_if(c & F.col((means + sums)[0]).isNotNull()).alias(f"hours_{label}"))
    aggs += [F.sum(v).alias(f"{v}_utcday_sum") for v in sums]
    aggs += [F.avg(F.when(hour == h, F.col(v))).alias(f"{v}_at_{h:02d}") for v, h in (at or {}).items()]
    return df.groupBy(*keys, F.to_date(time).alias("date")).agg(*aggs)


# ---------------------------------------------------------------- resolution and terrain
def coarsen(grid: DataFrame, keys: list[str], value: str, k: int, lat0: float, dlat: float, lon0: float, dlon: float) -> DataFrame:
    """Mean over k x k blocks of the axis index; incomplete edge blocks are dropped."""
    i = F.floor(F.round((F.col("lat") - lat0) / dlat) / k)
    j = F.floor(F.round((F.col("lon") - lon0) / dlon) / k)
    g = grid.groupBy(*keys, i.alias("block_i"), j.alias("block_j")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg(value).alias(value))
    return g.filter(F.col("_n") == k * k).drop("_n")


def cell_elevation(cells: DataFrame, terrain: DataFrame, half: float) -> DataFrame:
    """Mean terrain elevation within +-half degrees of each cell, through a bin equi-join."""
    step = F.lit(2 * half)
    c = cells.select("lat", "lon", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("_o"))
    c = c.select("lat", "lon", (F.floor(F.col("lat") / step) + F.col("_o.a")).alias("_bi"), (F.floor(F.col("lon") / step) + F.col("_o.b")).alias("_bj"))
    t = terrain.select(F.col("lat").alias("_tl"), F.col("lon").alias("_to"), "elevation", F.floor(F.col("lat") / step).alias("_bi"), F.floor(F.col("lon") / step).alias("_bj"))
    hit = c.join(t, ["_bi", "_bj"]).filter((F.abs(F.col("lat") - F.col("_tl")) <= half) & (F.abs(F.col("lon") - F.col("_to")) <= half))
    e = hit.groupBy("lat", "lon").agg(F.avg("elevation").alias("elevation"))
    return cells.join(e, ["lat", "lon"], "left")


def below_ground(level: Column, elevation: Column, max_m: float = 1000.0, max_700_m: float = 2500.0) -> Column:
    """True where a pressure level lies below the terrain; unknown elevation stays valid.

    A null level stands for sea-level pressure.
    """
    e = F.coalesce(elevation, F.lit(-1e9))
    return F.when(level.isNull() | (level >= 850), e > max_m).when(level >= 700, e > max_700_m).otherwise(False)


def dilate(mask: DataFrame, flag: str = "masked", keys: list[str] | None = None) -> DataFrame:
    """Add the four neighbours of every masked cell of a static mask table."""
    keys = keys or []
    row, col = W.partitionBy(*keys, "lat").orderBy("lon"), W.partitionBy(*keys, "lon").orderBy("lat")
    f, no = F.col(flag), F.lit(False)
    near = [F.coalesce(fn(flag).over(w), no) for w in (row, col) for fn in (F.lag, F.lead)]
    return mask.withColumn("dilated", f | near[0] | near[1] | near[2] | near[3])


def box_means(grid: DataFrame, keys: list[str], value: str, boxes: dict[str, tuple], masked: Column | None = None) -> DataFrame:
    """Box means, and with a mask the masked mean and masked area share, one row per box."""
    spec = F.array(*[F.struct(F.lit(n).alias("box"), *[F.lit(float(x)).alias(k) for k, x in zip(("_a", "_b", "_c", "_d"), b)]) for n, b in boxes.items()])
    g = grid.withColumn("_m", masked if masked is not None else F.lit(False)).select("*", F.inline(spec))
    g = g.filter(F.col("lat").between(F.col("_a"), F.col("_b")) & F.col("lon").between(F.col("_c"), F.col("_d")))
    aggs = [weighted_mean(F.col(value)).alias("box_mean")]
    if masked is not None:
        aggs += [weighted_mean(F.col(value), ~F.col("_m")).alias("masked_mean"), area_fraction(F.col("_m"), F.lit(True)).alias("masked_fraction")]
    return g.groupBy(*keys, "box").agg(*aggs)


def box_series(grid: DataFrame, boxes: dict[str, tuple], values: list[str], levels: list[int] | None = None) -> DataFrame:
    """Wide daily series, one column per box, variable and level, from a single pass."""
    aggs = []
    for n, b in boxes.items():
        for v in values:
            for lv in levels or [None]:
                c = box(*b) if lv is None else box(*b) & (F.col("level") == lv)
                aggs.append(weighted_mean(F.when(c, F.col(v))).alias(f"{n}_{v}" + (f"_{lv}" if lv is not None else "")))
    return grid.groupBy("time").agg(*aggs)


def level_difference(grid: DataFrame, value: str, upper: int, lower: int, out: str, keys=("time", "lat", "lon")) -> DataFrame:
    """Pointwise difference of two levels (thickness, stability), before any averaging."""
    at = lambda lv: F.max(F.when(F.col("level") == lv, F.col(value)))
    return grid.filter(F.col("level").isin(upper, lower)).groupBy(*keys).agg((at(upper) - at(lower)).alias(out))


# ---------------------------------------------------------------- derivatives, jets, vortex
def derivative(value: str, axis: str, w) -> Column:
    """Centred difference on an uneven axis, one-sided at the ends."""
    x, f = F.col(axis), F.col(value)
    xl, xr, fl, fr = F.lag(axis).over(w), F.lead(axis).over(w), F.lag(value).over(w), F.lead(value).over(w)
    hl, hr = x - xl, xr - x
    mid = (hl * hl * fr + (hr * hr - hl * hl) * f - hr * hr * fl) / (hl * hr * (hl + hr))
    return F.when(xl.isNull(), (fr - f) / hr).when(xr.isNull(), (f - fl) / hl).otherwise(mid)


def advection(grid: DataFrame, keys: list[str], t: str = "t", u: str = "u", v: str = "v", per: float = 86400.0) -> DataFrame:
    """Horizontal advection of t per day; windows are one grid row or column each."""
    gx = derivative(t, "lon", W.partitionBy(*keys, "lat").orderBy("lon"))
    gy = derivative(t, "lat", W.partitionBy(*keys, "lon").orderBy("lat"))
    k = F.lit(180.0 / 3.141592653589793 / EARTH_M)
    return grid.withColumn("_x", gx).withColumn("_y", gy).withColumn(
        "advection", -(F.col(u) * F.col("_x") * k / cos_lat() + F.col(v) * F.col("_y") * k) * F.lit(per)).drop("_x", "_y")


def jet_core(grid: DataFrame, keys: list[str], u: str) -> DataFrame:
    """Latitude and speed of the strongest longitude-mean wind."""
    z = grid.groupBy(*keys, "lat").agg(F.avg(u).alias("_u"))
    return z.groupBy(*keys).agg(F.max_by("lat", F.struct(F.round("_u", 9), -F.col("lat"))).alias("jet_lat"), F.max("_u").alias("jet_speed"))


def minimum_location(grid: DataFrame, keys: list[str], z: str, pole: float = 90.0) -> DataFrame:
    """Where a field is lowest, and how far that is from the pole in degrees."""
    b = grid.filter(F.col(z).isNotNull()).groupBy(*keys).agg(F.min(F.struct(F.round(z, 9).alias("z"), F.col("lat"), F.col("lon"))).alias("_b"))
    return b.select(*keys, F.col("_b.z").alias("minimum"), F.col("_b.lat").alias("min_lat"), F.col("_b.lon").alias("min_lon"), (F.lit(pole) - F.col("_b.lat")).alias("displacement"))


def at_nearest_latitude(grid: DataFrame, keys: list[str], target: float, value: str) -> DataFrame:
    """Zonal mean at the latitude nearest to a target."""
    z = grid.groupBy(*keys, "lat").agg(F.avg(value).alias("_z"))
    return z.groupBy(*keys).agg(F.min_by(F.struct("lat", "_z"), F.struct(F.abs(F.col("lat") - target), F.col("lat"))).alias("_b")).select(
        *keys, F.col("_b.lat").alias("lat"), F.col("_b._z").alias(value))


def polar_cap_index(heights: DataFrame, clim: DataFrame, value: str, weak: float = -1.0, very_weak: float = -2.0) -> DataFrame:
    """Minus the standardised cap height per level, flags, and the mean over levels per time.

    ``heights``: time, level, month_day, value; ``clim``: month_day, level, clim_mean, clim_sd.
    """
    j = heights.join(clim, ["month_day", "level"], "left")
    x = -(F.col(value) - F.col("clim_mean")) / F.when(F.col("clim_sd") != 0, F.col("clim_sd"))
    j = j.withColumn("cap_index", x)
    j = (j.withColumn("weak", F.coalesce(F.col("cap_index") <= weak, F.lit(False))).withColumn("very_weak", F.coalesce(F.col("cap_index") <= very_weak, F.lit(False)))
         .withColumn("negative", F.coalesce(F.col("cap_index") < 0, F.lit(False))))
    return j.withColumn("level_mean", F.avg("cap_index").over(W.partitionBy("time")))


def interpolate_latitude(grid: DataFrame, keys: list[str], targets: list[float], value: str) -> DataFrame:
    """Linear interpolation of every column (keys) to target latitudes; null outside the axis."""
    g = grid.filter(F.col(value).isNotNull()).select(*keys, "lat", value, F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target_lat"))
    here = F.struct(F.col("lat"), F.col(value).alias("v"))
    b = g.groupBy(*keys, "target_lat").agg(F.max(F.when(F.col("lat") <= F.col("target_lat"), here)).alias("_l"), F.min(F.when(F.col("lat") >= F.col("target_lat"), here)).alias("_u"))
    span = F.col("_u.lat") - F.col("_l.lat")
    out = F.when(span == 0, F.col("_l.v")).otherwise(F.col("_l.v") + (F.col("target_lat") - F.col("_l.lat")) / span * (F.col("_u.v") - F.col("_l.v")))
    return b.select(*keys, "target_lat", out.alias(value))


def blocking(grid: DataFrame, z: str, centre: float, south: float, north: float, offsets: list[float], sector: tuple, north_limit: float = -10.0,
             min_width: float = 15.0, spacing: float = 1.0) -> DataFrame:
    """Height-gradient reversal at any offset per longitude, sector share, widest span and day flag."""
    lats = sorted({x + o for o in offsets for x in (centre, south, north)})
    p = interpolate_latitude(grid, ["time", "lon"], lats, z)
    at = lambda lat: F.max(F.when(F.col("target_lat") == float(lat), F.col(z)))
    wide = p.groupBy("time", "lon").agg(*[at(lat).alias(f"z{i}") for i, lat in enumerate(lats)])
    col = {lat: F.col(f"z{i}") for i, lat in enumerate(lats)}
    hit = F.lit(False)
    for o in offsets:
        gs = (col[centre + o] - col[south + o]) / F.lit(centre - south)
        gn = (col[north + o] - col[centre + o]) / F.lit(north - centre)
        hit = hit | F.coalesce((gs > 0) & (gn < north_limit), F.lit(False))
    local = wide.filter(F.col("lon").between(*sector)).select("time", "lon", hit.alias("blocked"))
    share = local.groupBy("time").agg(F.avg(F.col("blocked").cast("double")).alias("blocking_fraction"))
    return share.join(widest_span(local, "blocked", spacing), "time").withColumn("sector_block_day", F.col("widest_span") >= min_width)


def widest_span(local: DataFrame, flag: str, spacing: float) -> DataFrame:
    """Widest contiguous flagged longitude span per time, in degrees."""
    d = local.withColumn("_i", F.round(F.col("lon") / spacing).cast("int"))
    hit = d.filter(F.col(flag)).withColumn("_g", F.col("_i") - F.row_number().over(W.partitionBy("time").orderBy("_i")))
    runs = hit.groupBy("time", "_g").agg(F.count(F.lit(1)).alias("_n")).groupBy("time").agg((F.max("_n") * spacing).alias("widest_span"))
    return local.select("time").distinct().join(runs, "time", "left").withColumn("widest_span", F.coalesce("widest_span", F.lit(0.0)))


def high_pressure_index(grid: DataFrame, p: str, b: tuple) -> DataFrame:
    return grid.filter(box(*b)).groupBy("time").agg(weighted_mean(F.col(p)).alias("box_mean"), F.max(p).alias("box_max"))


# ---------------------------------------------------------------- waves and sectors
def latitude_band_mean(grid: DataFrame, value: str, lat0: float, lat1: float) -> DataFrame:
    return grid.filter(F.col("lat").between(lat0, lat1)).groupBy("time", "lon").agg(weighted_mean(F.col(value)).alias(value))


def sector_metrics(wave: DataFrame, clim: DataFrame, sectors: dict[str, tuple], value: str, position: str = "lon") -> DataFrame:
    """Sector mean and max, standardised value, p90 exceedance day, share of cells above their p90.

    ``clim`` has month_day, position, clim_p90 for cells; sector climatology is taken from the
    sector mean itself.
    """
    spec = F.array(*[F.struct(F.lit(n).alias("sector"), F.lit(float(a)).alias("_a"), F.lit(float(b)).alias("_b")) for n, (a, b) in sectors.items()])
    j = wave.join(clim.select("month_day", position, "clim_p90"), ["month_day", position], "left")
    j = j.select("*", F.inline(spec)).filter(F.col(position).between(F.col("_a"), F.col("_b")))
    s = j.groupBy("sector", "time", "month_day").agg(F.avg(value).alias("sector_mean"), F.max(value).alias("sector_max"),
                                                    F.avg((F.col(value) > F.col("clim_p90")).cast("double")).alias("high_cell_fraction"))
    c = s.groupBy("sector", "month_day").agg(F.avg("sector_mean").alias("_m"), F.stddev_samp("sector_mean").alias("_s"), F.percentile("sector_mean", 0.9).alias("sector_p90"))
    j = s.join(c, ["sector", "month_day"])
    return j.select("sector", "time", "month_day", "sector_mean", "sector_max", "high_cell_fraction", "sector_p90",
                    ((F.col("sector_mean") - F.col("_m")) / F.when(F.col("_s") != 0, F.col("_s"))).alias("standardised"),
                    (F.col("sector_mean") > F.col("sector_p90")).alias("high_day"))


def sector_episodes(daily: DataFrame, min_days: int = 3) -> DataFrame:
    """Daily rows with ``episode`` true inside runs of at least ``min_days`` high days of a sector and year."""
    d = daily.withColumn("_y", F.year("time"))
    return assign_runs(d, ["sector", "_y"], "high_day", min_days, "time").withColumnRenamed("qualifying", "episode").drop("_y", "event_seq", "event_day", "candidate_run_length")


def surface_validity(grid: DataFrame, keys: list[str], level: str, msl: str, t: str, elevation: str) -> DataFrame:
    """Share of box area above ground per level, from the estimated surface pressure."""
    sp = pressure_at_height(F.col(msl), F.col(t), F.col(elevation))
    g = grid.withColumn("_ok", F.col(level) < sp)
    return g.groupBy(*keys, level).agg(area_fraction(F.col("_ok"), F.col(msl).isNotNull()).alias("valid_fraction"))


# ---------------------------------------------------------------- composites
def lag_composite(anom: DataFrame, lags: DataFrame, cell: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """Mean and count over events per lag and cell; each event-lag row brings its own date."""
    j = lags.select("event_id", "lag", *(by or []), F.col("date").alias("time")).join(anom, "time")
    return j.groupBy("lag", *(by or []), *cell).agg(F.avg(value).alias("composite"), F.count(value).alias("event_count"))


def sign_agreement(events: DataFrame, keys: list[str], value: str, levels=(0.55, 0.60, 0.67)) -> DataFrame:
    """Share of events whose sign equals the composite's, from sign counts in one aggregate."""
    x = F.col(value)
    g = events.filter(x.isNotNull()).groupBy(*keys).agg(F.avg(value).alias("composite"), F.count(value).alias("event_count"),
                                                       F.count_if(x > 0).alias("_p"), F.count_if(x < 0).alias("_n"), F.count_if(x == 0).alias("_z"))
    m = F.round("composite", 12)
    same = F.when(m > 0, F.col("_p")).when(m < 0, F.col("_n")).otherwise(F.col("_z"))
    g = g.withColumn("agreement", same / F.col("event_count"))
    for t in levels:
        g = g.withColumn(f"agree_{int(round(t * 100))}", F.col("agreement") >= t)
    return g.drop("_p", "_n", "_z")


def direction_agreement(events: DataFrame, keys: list[str], fx: str, fy: str) -> DataFrame:
    """Share of events whose vector has a positive dot product with the composite vector."""
    e = events.filter(F.col(fx).isNotNull() & F.col(fy).isNotNull())
    m = e.groupBy(*keys).agg(F.avg(fx).alias("mean_x"), F.avg(fy).alias("mean_y"))
    j = e.join(m, keys)
    dot = F.round(F.col(fx) * F.col("mean_x") + F.col(fy) * F.col("mean_y"), 12)
    return j.groupBy(*keys, "mean_x", "mean_y").agg(F.avg((dot > 0).cast("double")).alias("_a")).withColumn(
        "agreement", F.when((F.col("mean_x") != 0) | (F.col("mean_y") != 0), F.col("_a"))).drop("_a")


def group_difference_composite(comp: DataFrame, keys: list[str], group: str, a: str, b: str) -> DataFrame:
    """Composites of two groups side by side with their difference."""
    at = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
    return comp.groupBy(*keys).agg(at(a, "composite").alias(f"{a}_mean"), at(b, "composite").alias(f"{b}_mean"), at(a, "event_count").alias(f"{a}_count"),
                                   at(b, "event_count").alias(f"{b}_count")).withColumn("difference", F.col(f"{a}_mean") - F.col(f"{b}_mean"))


def inside_outside(df: DataFrame, keys: list[str], value: str, inside: Column) -> DataFrame:
    """Means over all, inside and outside days per season and cell."""
    return df.groupBy(*keys).agg(F.avg(value).alias("all_mean"), F.avg(F.when(inside, F.col(value))).alias("inside_mean"), F.avg(F.when(~inside, F.col(value))).alias("outside_mean"),
                                 F.count_if(inside & F.col(value).isNotNull()).alias("inside_count"))


def region_flux_metrics(flux: DataFrame, keys: list[str], regions: dict[str, tuple]) -> DataFrame:
    """Means, coherence and fractions of a flux field per region (columns fx, fy, divergence)."""
    spec = F.array(*[F.struct(F.lit(n).alias("region"), *[F.lit(float(x)).alias(k) for k, x in zip(("_a", "_b", "_c", "_d"), b)]) for n, b in regions.items()])
    g = flux.filter("fx IS NOT NULL AND fy IS NOT NULL").select("*", F.inline(spec))
    g = g.filter(F.col("lat").between(F.col("_a"), F.col("_b")) & F.col("lon").between(F.col("_c"), F.col("_d")))
    fx, fy = F.col("fx"), F.col("fy")
    se = (fx - fy) / F.sqrt(F.lit(2.0))
    m = g.groupBy(*keys, "region").agg(
        weighted_mean(fx).alias("mean_fx"), weighted_mean(fy).alias("mean_fy"), weighted_mean(F.sqrt(fx * fx + fy * fy)).alias("mean_magnitude"),
        weighted_mean(F.col("divergence")).alias("mean_divergence"), F.avg((fx > 0).cast("double")).alias("eastward_fraction"),
        F.avg((se > 0).cast("double")).alias("southeastward_fraction"), F.avg((F.coalesce(F.col("divergence"), F.lit(0.0)) < 0).cast("double")).alias("convergence_fraction"))
    size = F.sqrt(F.col("mean_fx") * F.col("mean_fx") + F.col("mean_fy") * F.col("mean_fy"))
    return m.withColumn("coherence", F.when(F.col("mean_magnitude") > 0, size / F.col("mean_magnitude")))


def metrics_wide(long: DataFrame, keys: list[str], name: Column, names: list[str], value: str) -> DataFrame:
    """Long metric rows to one column per listed name."""
    return long.withColumn("_name", name).groupBy(*keys).pivot("_name", names).agg(F.max(value))
