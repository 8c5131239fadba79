"""Distances on the sphere."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0088


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def sphere_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Cartesian km on the sphere; chords order pairs exactly as great circles do."""
    p, q = F.radians(lat), F.radians(lon)
    return (
        F.lit(EARTH_KM) * F.cos(p) * F.cos(q),
        F.lit(EARTH_KM) * F.cos(p) * F.sin(q),
        F.lit(EARTH_KM) * F.sin(p),
    )
