"""Constants of the model and the order in which settings override each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.scalars import finite


@dataclass(frozen=True)
class ModelConfig:
    """Settings that hold for all rides of a run. Fixed values."""

    # rider
    mass: float = 78.0
    crr: float = 0.004
    cda: float = 0.32
    efficiency: float = 0.976
    rotating_mass: float = 1.2
    yaw_factor: float = 0.15
    ftp: float = 250.0
    cp: float = 250.0
    w_prime: float = 20_000.0
    # wind: weather, manual or fit; a manual wind is a reading at 10 m
    wind_source: str = "weather"
    wind_speed: float = 0.0
    wind_dir: float = 0.0
    roughness: float = 0.1
    # conditions
    temp: float = 20.0
    altitude: float = 0.0
    # report
    clean_air_pct: float = 0.85
    exposed_at: float = 0.95
    sheltered_at: float = 0.75
    surge_factor: float = 1.4
    finale_laps: int = 3
    finale_seconds: int = 300
    ratio_window: int = 15
    ratio_floor: float = 50.0
    min_surge_seconds: int = 4
    min_match_kj: float = 1.0
    corner_radius: float = 40.0
    min_corner_deg: float = 35.0
    turn_cluster_m: float = 35.0
    lap_radius: float = 30.0
    min_lap_metres: float = 400.0
    sector_count: int = 8
    moving_speed: float = 2.5
    stop_seconds: int = 20
    max_samples: int = 200_000
    min_samples: int = 10


def first_set(*values: Column) -> Column:
    """The first finite value other than zero, else the first finite one, else 0."""
    known = [finite(v.cast("double")) for v in values]
    return F.coalesce(*(F.nullif(v, F.lit(0.0)) for v in known), *known, F.lit(0.0))


def ride_settings(rides_alias: str, override: dict[str, Column] | None, config: ModelConfig) -> dict[str, Column]:
    """``cp``, ``w_prime``, ``ftp`` and ``mass`` of a ride: override, then the file's own, then the run's setting."""
    override = override or {}
    own = lambda name: F.col(f"{rides_alias}.{name}").cast("double")
    nothing = F.lit(None).cast("double")
    ftp = first_set(override.get("ftp", nothing), own("ftp"), F.lit(config.ftp))
    return {
        "ftp": ftp,
        "cp": first_set(override.get("cp", nothing), own("cp"), F.lit(config.cp)),
        "w_prime": first_set(override.get("w_prime", nothing), own("w_prime"), F.lit(config.w_prime)),
        "mass": first_set(override.get("mass", nothing), F.lit(config.mass)),
    }
