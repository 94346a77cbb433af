"""Distances and boxes on the ground; latitudes and longitudes in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree of latitude; the Earth's radius in km.
DEGREE_M, EARTH_KM = 111_320.0, 6371.0


def planar_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column, at_lat: Column | None = None) -> Column:
    """Distance on a plane that touches the ground at ``at_lat`` (by default the first point)."""
    per_lon = F.lit(DEGREE_M) * F.cos(F.radians(lat1 if at_lat is None else at_lat))
    return F.hypot((lon2 - lon1) * per_lon, (lat2 - lat1) * DEGREE_M)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    up, over = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * over * over
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bounding_box(lat: Column, lon: Column) -> list[Column]:
    """Aggregates ``south, west, north, east``; points at 0, 0 or without a place don't count."""
    real = lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
    return [F.min(F.when(real, lat)).alias("south"), F.min(F.when(real, lon)).alias("west"), F.max(F.when(real, lat)).alias("north"), F.max(F.when(real, lon)).alias("east")]


def padded_box(south: Column, west: Column, north: Column, east: Column, share: float = 0.18) -> list[Column]:
    """The box with a margin of ``share`` of each side, at least 0.0008 by 0.0010 degrees."""
    tall, wide = F.greatest((north - south) * share, F.lit(0.0008)), F.greatest((east - west) * share, F.lit(0.0010))
    return [(south - tall).alias("south"), (west - wide).alias("west"), (north + tall).alias("north"), (east + wide).alias("east")]


def corner_kind(turned_deg: Column) -> Column:
    """Name of a corner by the angle that it turns."""
    size = F.abs(turned_deg)
    return F.when(size >= 140, "hairpin").when(size >= 60, "square").when(size >= 35, "sweeper").otherwise("kink")


def metres_per_degree_lon(lat_deg: float) -> float:
    return DEGREE_M * math.cos(math.radians(lat_deg))
