"""The whole report of any number of rides, as named lazy tables and SQL views."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.config import ModelConfig, ride_settings
from cadenza.plans import calibrate, compare, findings, laps, mean_lap, power, prepare, race_window, sectors, summary, surges, turns, weather
from cadenza.plans.staging import Staging

TABLES = ("grid", "wind", "series", "laps", "mean_lap", "turns", "turn_events", "sector_cells", "sector_totals", "surges", "headings", "summary", "finale", "hr", "shape", "fitness", "circuit", "compare", "findings", "race_window", "lap_info", "phases")


def settings_of(rides: DataFrame, density: DataFrame, config: ModelConfig, override: dict[str, Column] | None = None) -> DataFrame:
    """One row a ride: ``cp, w_prime, ftp, mass, rho``."""
    chosen = rides.alias("r").select("ride_id", *(c.alias(n) for n, c in ride_settings("r", override, config).items()))
    return chosen.join(density.select("ride_id", "rho"), "ride_id")


def analyze(samples: DataFrame, rides: DataFrame, weather_hours: DataFrame | None = None, config: ModelConfig = ModelConfig(), override: dict[str, Column] | None = None, window: bool = False, folder: str | None = None) -> dict[str, DataFrame]:
    """All tables of the report by name. Those that others are made from are written to ``folder`` (by default a new
    one in the shared folder) and read back, so that no plan grows with the length of the report; the rest are lazy.

    ``rides`` may carry a ``site`` that ``weather_hours`` knows. With
    ``window`` the search of the race within the recording is added.
    """
    if "site" not in rides.columns:
        rides = rides.withColumn("site", F.lit(None).cast("string"))
    keep = Staging(samples.sparkSession, folder).put
    grid = keep(prepare.prepare(samples, rides, config), "grid")


    def blow() -> tuple[DataFrame, DataFrame, DataFrame]:
        settings = keep(settings_of(rides, weather.ride_density(grid, rides, weather_hours, config), config, override), "settings")
        if weather_hours is not None and config.wind_source == "weather":
            blown = weather.with_wind(grid, rides, weather_hours, config)
        else:
            blown = grid.withColumns({c: F.lit(None).cast("double") for c in ("we", "wn")})
        blown = blown.join(settings, "ride_id")
        wind = keep(calibrate.resolve_wind(blown, config, keep), "wind")
        return settings, wind, keep(power.ride_series(blown, wind, config), "series")

    def lap() -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        marks = prepare.markers(rides, samples, grid, config) if rides.where("size(lap_times) > 0").head(1) else None
        bounds = keep(laps.detect_laps(grid, rides, marks, config, keep), "lap_bounds")
        line = keep(mean_lap.mean_lap(grid, bounds), "mean_lap")
        return bounds, line, *turns.detect_turns(grid, bounds, line, config, keep)

    # what does not build on each other is written at once: small runs wait for jobs, not for cores
    with ThreadPoolExecutor(3) as pool:
        blowing, lapping = pool.submit(blow), pool.submit(lap)
        settings, wind, series = blowing.result()
        bounds, line, corners, events = lapping.result()
        rows = pool.submit(lambda: keep(summary.summarise_laps(series, bounds, config), "laps"))
        events = keep(turns.price_passes(events, series), "turn_events")
        corners = keep(turns.price_turns(corners, events), "turns")
        cutting = pool.submit(lambda: keep(sectors.build_sectors(series, bounds, corners, config)[0], "sector_cells"))
        efforts = keep(surges.detect_surges(series, bounds, corners, events, config), "surges")
        summing = pool.submit(lambda: keep(summary.summarise(series, bounds, corners, efforts, config), "summary"))
        cells = cutting.result()
        totals = keep(sectors.total_cells(cells, ("ride_id",), "sector", "ratio", "seconds", "label"), "sector_totals")
        lap_rows, ride_rows = rows.result(), summing.result()
    report = {
        "grid": grid, "wind": wind, "series": series, "laps": lap_rows, "lap_bounds": bounds, "mean_lap": line, "turns": corners, "turn_events": events, "sector_cells": cells, "sector_totals": totals, "surges": efforts,
        "headings": summary.exposure_by_heading(series), "summary": ride_rows, "finale": summary.summarise_finale(series, bounds, efforts, config), "hr": summary.summarise_hr(series),
        "shape": summary.race_shape(lap_rows), "fitness": summary.check_fitness(ride_rows, settings), "circuit": mean_lap.fingerprint(line), "settings": settings,
    }
    report["compare"] = compare.compare_rows(rides, report)
    report["findings"] = findings.findings(report, config)
    if window:
        report["race_window"], report["lap_info"], report["phases"] = race_window.race_window(grid, bounds, config, keep=keep, circuit=line)
    return report


def register(report: dict[str, DataFrame], prefix: str = "ride_") -> list[str]:
    """The tables as temporary SQL views; returns their names."""
    names = []
    for name, df in report.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
