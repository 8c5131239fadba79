"""Exact k-nearest neighbours on the sphere without a cross join.

Points are put in cubes of a 3-D grid, so a target only meets the points of its 27 surrounding
cubes. Cubes start small and double until the search radius; a target leaves as soon as it has k
neighbours closer than the cube side, which makes them exactly the k nearest.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.geo import EARTH_KM, great_circle_km, sphere_xyz
from ..session import stage_table


def _cubes(df: DataFrame, side: float, suffix: str) -> DataFrame:
    x, y, z = sphere_xyz(F.col("lat" + suffix), F.col("lon" + suffix))
    for name, c in (("cx", x), ("cy", y), ("cz", z)):
        df = df.withColumn(name, F.floor(c / F.lit(side)).cast("int"))
    return df


def crowding(points: DataFrame, side: float) -> int:
    """Largest number of distinct positions in one cube (one small aggregate)."""
    row = (_cubes(points.select("lat", "lon").distinct(), side, "")
           .groupBy("cx", "cy", "cz").count().agg(F.max("count")).first())
    return int(row[0] or 0)


def nearest_k(targets: DataFrame, candidates: DataFrame, k: int, radius_km: float,
              exclude_self: bool = False, levels: int | None = None) -> DataFrame:
    """Rows (id, neighbour, distance_km, neighbour_rank); ties are broken by neighbour id.

    Both inputs have columns id, lat, lon. ``levels`` is chosen from the crowding of the
    candidates when not given. The neighbours found at a level and the targets left for the next are staged: each level
    reads the one before twice, so that a plan of all levels would work out the first ones 2 ** levels times.
    """
    chord = 2 * EARTH_KM * math.sin(min(radius_km / EARTH_KM, math.pi) / 2)
    # Points at one position tie on distance, so the k+1 smallest ids there are enough.
    here = W.partitionBy("lat_n", "lon_n").orderBy("neighbour")
    pool = (
        candidates.select(F.col("id").alias("neighbour"), F.col("lat").alias("lat_n"),
                          F.col("lon").alias("lon_n"))
        .withColumn("_at", F.row_number().over(here)).filter(F.col("_at") <= k + 1).drop("_at")
    )
    if levels is None:
        crowd = crowding(candidates, chord)
        levels = max(1, min(16, 1 + math.ceil(math.log(max(crowd / 32.0, 1.0), 4))))
    open_targets = targets.select("id", "lat", "lon")
    rank = W.partitionBy("id").orderBy("distance_km", "neighbour")
    parts = []
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for level in range(levels):
        last = level == levels - 1
        side = chord / 2 ** (levels - 1 - level)
        reach = radius_km if last else 2 * EARTH_KM * math.asin(side / (2 * EARTH_KM))
        around = (
            _cubes(open_targets, side, "")
            .withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
            .withColumn("dz", F.explode(steps))
            .select("id", "lat", "lon", (F.col("cx") + F.col("dx")).alias("cx"),
                    (F.col("cy") + F.col("dy")).alias("cy"), (F.col("cz") + F.col("dz")).alias("cz"))
        )
        near = around.join(_cubes(pool, side, "_n"), ["cx", "cy", "cz"]).withColumn(
            "distance_km", great_circle_km(F.col("lat"), F.col("lon"), F.col("lat_n"), F.col("lon_n"))
        ).filter(F.col("distance_km") <= reach)
        if exclude_self:
            near = near.filter(F.col("id") != F.col("neighbour"))
        top = (near.select("id", "neighbour", "distance_km")
               .withColumn("neighbour_rank", F.row_number().over(rank)).filter(F.col("neighbour_rank") <= k))
        top = stage_table(top) if levels > 1 else top
        if last:
            parts.append(top)
        else:
            done = top.groupBy("id").count().filter(F.col("count") == k).select("id")
            parts.append(top.join(done, "id", "left_semi"))
            open_targets = stage_table(open_targets.join(done, "id", "left_anti"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
