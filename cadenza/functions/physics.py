"""Power that a lone rider needs, and the air it is ridden through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.scalars import clamp

#: Gravity (m/s2), gas constants of dry air and vapour (J/kg/K), sea-level pressure (Pa).
GRAVITY, DRY_AIR, VAPOUR, SEA_LEVEL = 9.80665, 287.058, 461.495, 101325.0
#: Tetens' saturation pressure (hPa, -, C); lapse and exponent of the standard atmosphere.
TETENS = (6.1078, 7.5, 237.3)
LAPSE, LAPSE_POWER = 2.25577e-5, 5.25588


def pressure_at_altitude(metres: Column) -> Column:
    """Pressure of the standard atmosphere in Pa."""
    return F.lit(SEA_LEVEL) * F.pow(F.lit(1.0) - F.lit(LAPSE) * F.coalesce(metres, F.lit(0.0)), F.lit(LAPSE_POWER))


def air_density(celsius: Column, pascal: Column, humidity_pct: Column) -> Column:
    """Density of humid air in kg/m3, of dry air where the humidity is null."""
    kelvin = F.coalesce(celsius, F.lit(20.0)) + 273.15
    warm = F.coalesce(celsius, F.lit(0.0))
    p = F.coalesce(F.nullif(pascal, F.lit(0.0)), F.lit(SEA_LEVEL))
    base, slope, offset = TETENS
    saturated = F.lit(base * 100) * F.pow(F.lit(10.0), slope * warm / (warm + offset))
    vapour = clamp(humidity_pct, 0.0, 100.0) / 100 * saturated
    humid = F.greatest(p - vapour, F.lit(0.0)) / (DRY_AIR * kelvin) + vapour / (VAPOUR * kelvin)
    return F.coalesce(humid, p / (DRY_AIR * kelvin))


def apparent_wind(v: Column, heading: Column, east: Column, north: Column) -> Column:
    """Struct of ``along`` (positive: into the wind), ``cross``, ``speed`` and ``yaw`` (radians); heading in radians."""
    along = v - (east * F.sin(heading) + north * F.cos(heading))
    cross = east * F.cos(heading) - north * F.sin(heading)
    return F.struct(along.alias("along"), cross.alias("cross"), F.hypot(along, cross).alias("speed"), F.atan2(cross, along).alias("yaw"))


def power_terms(v: Column, theta: Column, accel: Column, heading: Column, east: Column, north: Column, mass: Column, crr: Column, rho: Column, efficiency: Column, rotating: Column, yaw_factor: Column) -> tuple[Column, Column]:
    """(fixed, per_cda): the power needed is ``fixed + per_cda * cda``.

    Both are 0 at up to 0.1 m/s. Calibration takes them as two columns, so that
    trying another drag area costs one multiplication and one sum a row.
    """
    wind = apparent_wind(v, heading, east, north)
    along, cross, speed = wind["along"], wind["cross"], wind["speed"]
    sine = F.when(speed > 1e-6, cross / speed).otherwise(0.0)
    drag = 0.5 * rho * (1 + yaw_factor * sine * sine) * speed * along
    road = mass * GRAVITY * (F.sin(theta) + crr * F.cos(theta)) + (mass + rotating) * accel
    rides = v > 0.1
    return F.when(rides, road * v / efficiency).otherwise(0.0), F.when(rides, drag * v / efficiency).otherwise(0.0)


def required_power(v: Column, theta: Column, accel: Column, heading: Column, east: Column, north: Column, mass: Column, crr: Column, cda: Column, rho: Column, efficiency: Column, rotating: Column, yaw_factor: Column) -> Column:
    """Watts at the pedals for gravity, rolling, drag and inertia; not clamped, 0 at up to 0.1 m/s."""
    fixed, per_cda = power_terms(v, theta, accel, heading, east, north, mass, crr, rho, efficiency, rotating, yaw_factor)
    return fixed + per_cda * cda
