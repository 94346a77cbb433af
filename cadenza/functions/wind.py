"""Wind vectors and bearings. A direction is where wind comes from (degrees), a vector where it blows to."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.scalars import clamp, half_up

#: The heights of reported wind and of a rider, in metres.
REPORTED_AT, RIDER_AT = 10.0, 1.3
#: Names of the sixteen points of the compass.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def wind_vector(speed: Column, from_deg: Column) -> tuple[Column, Column]:
    """East and north components of wind from a bearing; null counts as 0."""
    s, r = F.coalesce(speed, F.lit(0.0)), F.radians(F.coalesce(from_deg, F.lit(0.0)))
    return -s * F.sin(r), -s * F.cos(r)


def wind_bearing(east: Column, north: Column) -> Column:
    """Degrees that a wind vector comes from, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(-east, -north)), F.lit(360.0))


def shelter_factor(roughness: float) -> float:
    """How much of the wind at 10 m is left at rider height, by the logarithmic profile."""
    z = min(2.0, max(0.005, roughness or 0.1))
    return min(1.0, max(0.08, math.log(RIDER_AT / z) / math.log(REPORTED_AT / z)))


def shelter_factor_column(roughness: Column) -> Column:
    """The same of a column."""
    z = clamp(F.coalesce(F.nullif(roughness, F.lit(0.0)), F.lit(0.1)), 0.005, 2.0)
    return clamp(F.ln(RIDER_AT / z) / F.ln(REPORTED_AT / z), 0.08, 1.0)


def sector_of(degrees: Column, width: float, count: int) -> Column:
    """Which of ``count`` sectors of ``width`` degrees, from north on, a bearing falls in."""
    return (F.floor(F.pmod(degrees, F.lit(360.0)) / width) % count).cast("int")


def compass_bin(degrees: Column) -> Column:
    """Which of the sixteen points a bearing is nearest to, 0 to 15."""
    return (half_up(F.pmod(F.coalesce(degrees, F.lit(0.0)), F.lit(360.0)) / 22.5) % 16).cast("int")


def compass_name(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), compass_bin(degrees) + 1)
