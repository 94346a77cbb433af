"""Schemas of the tables that sources deliver."""

from __future__ import annotations

CHANNELS = ("lat", "lon", "alt", "v", "watts", "hr", "cad", "dist", "temp")
#: One row a sample; ``t`` in seconds, places in degrees, the rest in SI units.
SAMPLES = "ride_id string, seq long, t double, " + ", ".join(f"{c} double" for c in CHANNELS)
#: One row a ride.
RIDES = (
    "ride_id string, name string, source string, source_id string, start_time double, sport string, ftp double, weight_kg double, cp double, w_prime double, "
    "lap_times array<double>, crop_start double, crop_end double, anchor_lat double, anchor_lon double"
)
#: One row a site and hour; time in epoch seconds, wind in m/s at 10 m, pressure in hPa.
WEATHER = "site string, time double, temp double, humidity double, pressure double, wind_speed double, wind_dir double, wind_gust double, precip double, cloud double"
