"""The whole report on rides that are made of the driver's events: what no single SQL can say. Its parts have SQL in ``composites``."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.geo import DEGREE_M
from cadenza.plans.analyze import analyze
from cadenza.plans.compare import circuit_groups
from cadenza.plans.tables import CHANNELS, RIDES
from cadenza.queries.registry import QUERIES, epoch, table

#: What is read from the report, by query.
TABLES = ("laps", "mean_lap", "turns", "turn_events", "sector_cells", "sector_totals", "surges", "headings", "summary", "finale", "hr", "shape", "fitness", "wind", "compare", "findings", "race_window", "lap_info", "phases")


#: Events of a ride; where it is ridden, half axes of the oval and metres of a lap.
SECONDS, PLACE, HALVES, LAP = 2500, (45.8, 9.1), (150.0, 45.0), 660.0


def rides_of_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rides, samples): every ``SECONDS`` events in the order of their ids are a ride, an event a second in the order of time, so
    rides multiply with the table and none grows. Values are watts and speeds; places follow from the distance ridden
    around an oval."""
    e = table(spark, sf_dir, "events").withColumn("ride_id", F.concat(F.lit("ride-"), F.floor(F.col("event_id") / SECONDS)))
    w = Window.partitionBy("ride_id").orderBy("ts", "event_id")
    e = e.withColumns({"seq": (F.row_number().over(w) - 1).cast("long"), "v": 9.0 + F.col("value") % 3})
    e = e.withColumn("dist", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    angle = 2 * math.pi * F.col("dist") / LAP
    north, east = HALVES[1] * F.sin(angle), HALVES[0] * F.cos(angle)
    made = {
        "t": F.col("seq").cast("double"), "lat": PLACE[0] + north / DEGREE_M, "lon": PLACE[1] + east / (DEGREE_M * math.cos(math.radians(PLACE[0]))), "alt": 80 + 2 * F.sin(angle),
        "watts": F.col("value") * 4, "hr": 120 + F.col("value") % 50, "cad": 80 + F.col("value") % 20, "temp": F.lit(18.0),
    }
    samples = e.withColumns(made).select("ride_id", "seq", "t", *CHANNELS)
    start = e.groupBy("ride_id").agg(F.min(epoch("ts")).alias("start_time"))
    given = {"ride_id": F.col("ride_id"), "name": F.col("ride_id"), "source": F.lit("events"), "start_time": F.col("start_time"), "sport": F.lit("cycling"), "lap_times": F.array().cast("array<double>")}
    fields = [f.split() for f in RIDES.split(", ")]
    return start.select(*(given.get(name, F.lit(None).cast(kind)).alias(name) for name, kind in fields)), samples


_reports: dict[tuple[str, str], dict[str, DataFrame]] = {}


def report(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The report on the rides of the events; its tables are written once a Spark application and folder, for the twenty queries that read them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _reports:
        rides, samples = rides_of_events(spark, sf_dir)
        config = ModelConfig(wind_source="manual", wind_speed=6.0, wind_dir=250.0, mass=79.5, crr=0.0042)
        _reports[key] = analyze(samples, rides, config=config, window=True)
    return _reports[key]


def _part(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(spark, sf_dir)[name]

    run.__name__, run.__doc__ = f"ride_{name}", f"The table {name} of the report on rides made of events."
    return run


for _name in TABLES:
    QUERIES[f"ride_{_name}"] = _part(_name)


def ride_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which races share a circuit."""
    return circuit_groups(report(spark, sf_dir)["circuit"])


QUERIES["ride_circuits"] = ride_circuits
