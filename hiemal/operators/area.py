"""Station area weights and daily area diagnostics."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..plans.single import attach
from ..functions.geo import EARTH_KM
from ..functions.numeric import fraction
from ..plans.nearest import nearest_k


def region_points(spark: SparkSession, lat0: float, lat1: float, lon0: float, lon1: float, step: float) -> DataFrame:
    """Regular points of a region with their cos-latitude area share (id, lat, lon, area)."""
    ny, nx = int(math.floor((lat1 - lat0) / step + 0.5)), int(math.floor((lon1 - lon0) / step + 0.5))
    p = spark.range(ny * nx).select(
        "id", (F.lit(lat0) + (F.floor(F.col("id") / nx) + 0.5) * F.lit(step)).alias("lat"),
        (F.lit(lon0) + (F.col("id") % nx + 0.5) * F.lit(step)).alias("lon"))
    side = math.radians(step) * EARTH_KM
    return p.withColumn("area", F.cos(F.radians("lat")) * F.lit(side * side))


def nearest_station(points: DataFrame, stations: DataFrame, radius_km: float, levels: int | None = None) -> DataFrame:
    """Points with the station whose cell they fall in."""
    s = stations.select(F.col("station").alias("id"), "lat", "lon")
    near = nearest_k(points, s, 1, radius_km, levels=levels).select("id", F.col("neighbour").alias("station"))
    return points.join(near, "id")


def area_weights(assigned: DataFrame, stations: DataFrame) -> DataFrame:
    """Cell area, normalised weight and rank per station; stations without points get weight 0."""
    a = assigned.groupBy("station").agg(F.sum("area").alias("cell_area"))
    j = stations.select("station").join(a, "station", "left").withColumn("cell_area", F.coalesce("cell_area", F.lit(0.0)))
    j = attach(j, assigned.agg(F.sum("area").alias("_t")))
    return j.select("station", "cell_area", (F.col("cell_area") / F.col("_t")).alias("weight"))


def weight_issues(weights: DataFrame, network: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(issue, station, value) rows: sum differs from 1, station on one side only, weight not positive."""
    s = weights.agg(F.sum("weight").alias("value")).filter(F.abs(F.col("value") - 1) > tol).select(
        F.lit("sum_not_one").alias("issue"), F.lit(None).cast("string").alias("station"), "value")
    j = weights.select("station", "weight").join(network.select("station", F.lit(True).alias("_n")), "station", "full")
    ids = j.select(F.when(F.col("_n").isNull(), "not_in_network").when(F.col("weight").isNull(), "no_weight")
                   .when(F.col("weight") <= 0, "weight_not_positive").alias("issue"),
                   F.col("station").cast("string").alias("station"), F.col("weight").alias("value")).filter("issue IS NOT NULL")
    return s.unionByName(ids)


def count_diagnostics(rows: DataFrame, min_fraction: float, min_stations: int, cold_share: float) -> DataFrame:
    """Daily station counts. Needs date, eligible, value, cold, severe, deficit."""
    ok = F.col("eligible") & F.col("value").isNotNull()
    cold = ok & F.col("cold")
    g = rows.groupBy("date").agg(
        F.count_if("eligible").alias("eligible_count"), F.count_if(ok).alias("observed_count"), F.count_if(cold).alias("cold_count"),
        F.count_if(ok & F.col("severe")).alias("severe_count"), F.min(F.when(ok, F.col("value"))).alias("lowest_value"),
        F.sum(F.when(cold, F.col("deficit"))).alias("total_deficit"))
    seen = fraction(F.col("observed_count"), F.col("eligible_count"))
    share = fraction(F.col("cold_count"), F.col("observed_count"))
    usable = F.coalesce((seen >= min_fraction) & (F.col("observed_count") >= min_stations), F.lit(False))
    return (g.withColumn("observed_fraction", seen).withColumn("cold_fraction", share).withColumn("usable", usable)
            .withColumn("candidate", usable & F.coalesce(F.col("cold_fraction") >= cold_share, F.lit(False))))


def area_diagnostics(rows: DataFrame, weights: DataFrame, min_area: float = 0.8, min_stations: int = 15, cold_share: float = 0.2,
                     categories: dict[str, Column] | None = None) -> DataFrame:
    """Daily area-weighted diagnostics over the full area.

    Needs station, date, value, cold, severe, deficit. A missing station lowers the cold share
    instead of being re-weighted. Weights are joined on the station key and everything else is a
    partial aggregate per date.
    """
    j = rows.join(weights.select("station", "weight"), "station")
    w, seen = F.col("weight"), F.col("value").isNotNull()
    cold = seen & F.col("cold")
    part = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    aggs = [F.count_if(seen).alias("observed_count"), F.count_if(cold).alias("cold_count"), F.count_if(seen & F.col("severe")).alias("severe_count"),
            part(seen).alias("observed_area"), part(cold).alias("cold_area"), part(seen & F.col("severe")).alias("severe_area"),
            fraction(F.sum(F.when(seen, F.col("value") * w)), F.sum(F.when(seen, w))).alias("weighted_mean"),
            F.min(F.when(seen, F.col("value"))).alias("lowest_value"),
            F.coalesce(F.sum(F.when(cold, F.col("deficit") * w)), F.lit(0.0)).alias("weighted_deficit")]
    aggs += [part(seen & c).alias(f"{k}_area") for k, c in (categories or {}).items()]
    g = j.groupBy("date").agg(*aggs)
    # Sums of weights differ in the last bits with the order of addition; thresholds are tested on
    # values rounded well below any meaningful difference.
    usable = (F.round("observed_area", 9) >= min_area) & (F.col("observed_count") >= min_stations)
    return g.withColumn("usable", usable).withColumn("cold_day", usable & (F.round("cold_area", 9) >= cold_share))


def weighted_anomaly(rows: DataFrame, weights: DataFrame, value: str, min_weight: float = 0.8) -> DataFrame:
    """Re-weighted mean of the observed stations, null when too little weight is observed."""
    j = rows.join(weights.select("station", "weight"), "station")
    seen = F.col(value).isNotNull()
    g = j.groupBy("date").agg(F.sum(F.when(seen, F.col(value) * F.col("weight"))).alias("_s"), F.sum(F.when(seen, F.col("weight"))).alias("observed_weight"))
    return g.select("date", "observed_weight", F.when(F.round("observed_weight", 9) >= min_weight, F.col("_s") / F.col("observed_weight")).alias("mean_anomaly"))
