"""The column functions as SQL functions, and laps and reserves as table functions.

``register_functions`` makes a temporary SQL function of each column builder: its expression is analysed once on columns of
its parameters' types, and its text is the function's body, so Catalyst inlines it as if the Column had been used.
``register_tables`` adds functions of tables that walk each partition in its order:

    SELECT required_power(v, theta, …) FROM seconds
    SELECT * FROM reserve(TABLE(seconds) PARTITION BY ride_id ORDER BY (i), 250D, 20000D)
    SELECT * FROM crossings(TABLE(seconds) PARTITION BY ride_id ORDER BY (i), 45.0D, 7.0D, 30D, 400D)
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, LongType, StructType

from cadenza.functions import geo, physics, scalars, text, wind
from cadenza.functions.geo import DEGREE_M

#: Names, builders and parameters (double unless said otherwise) of what SQL gets.
FUNCTIONS: dict[str, tuple[Callable[..., Column], str]] = {
    "pressure_at_altitude": (physics.pressure_at_altitude, "metres"),
    "air_density": (physics.air_density, "celsius pascal humidity_pct"),
    "required_power": (physics.required_power, "v theta accel heading east north mass crr cda rho efficiency rotating yaw_factor"),
    "apparent_wind": (physics.apparent_wind, "v heading east north"),
    "wind_east": (lambda speed, from_deg: wind.wind_vector(speed, from_deg)[0], "speed from_deg"),
    "wind_north": (lambda speed, from_deg: wind.wind_vector(speed, from_deg)[1], "speed from_deg"),
    "wind_bearing": (wind.wind_bearing, "east north"),
    "shelter_factor": (wind.shelter_factor_column, "roughness"),
    "compass_bin": (wind.compass_bin, "degrees_from"),
    "compass_name": (wind.compass_name, "degrees_from"),
    "angle_delta": (scalars.angle_delta, "a b"),
    "angle_difference": (scalars.angle_difference, "a b"),
    "lerp": (scalars.lerp, "a b share"),
    "finite": (scalars.finite, "x"),
    "planar_metres": (geo.planar_metres, "lat1 lon1 lat2 lon2"),
    "haversine_km": (geo.haversine_km, "lat1 lon1 lat2 lon2"),
    "corner_kind": (geo.corner_kind, "turned_deg"),
    "ride_clock": (text.clock, "seconds"),
    "ride_slug": (text.slug, "name:string"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make temporary SQL functions of all column functions; returns their names."""
    for name, (build, parameters) in FUNCTIONS.items():
        fields = [(p.split(":")[0], (p.split(":") + ["double"])[1]) for p in parameters.split()]
        empty = spark.createDataFrame(spark.sparkContext.parallelize([], 1), ", ".join(f"{p} {kind}" for p, kind in fields))
        one = empty.select(build(*(F.col(p) for p, _ in fields)).alias("out"))
        # optimised, fields of structs that are made on the way are gone: their names would not be in the text
        body = one._jdf.queryExecution().optimizedPlan().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} {kind}' for p, kind in fields)}) RETURNS {one.schema['out'].dataType.simpleString()} RETURN {body}")
    return list(FUNCTIONS)


def _result(rows: AnalyzeArgument, added: dict[str, object], needed: tuple[str, ...]) -> AnalyzeResult:
    """All columns of the table and those that are added."""
    names = rows.dataType.fieldNames() if rows.isTable else []
    if missing := [c for c in needed if c not in names]:
        raise ValueError(f"the table needs the columns {', '.join(missing)}")
    schema = StructType([f for f in rows.dataType.fields if f.name not in added])
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return AnalyzeResult(schema)


class Reserve:
    """The rows of a table with ``balance``: what is left of a reserve that ``watts`` above ``cp`` drain. Each partition begins full.

    Refilling follows the mean shortfall so far, as in a live stream.
    """

    def __init__(self) -> None:
        self.balance: float | None = None
        self.short, self.n = 0.0, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, cp: AnalyzeArgument, capacity: AnalyzeArgument) -> AnalyzeResult:
        return _result(rows, {"balance": DoubleType()}, ("watts",))

    def eval(self, row: Row, cp: float, capacity: float) -> Iterator[tuple]:
        b = capacity if self.balance is None else self.balance
        p = row["watts"] if row["watts"] is not None and math.isfinite(row["watts"]) else 0.0
        if p > cp:
            b = max(0.0, b - (p - cp))
        else:
            self.short, self.n = self.short + cp - p, self.n + 1
            b = capacity - (capacity - b) * math.exp(-1 / (546 * math.exp(-0.01 * self.short / self.n) + 316))
        self.balance = b
        yield (*(v for k, v in row.asDict().items() if k != "balance"), b)


class Crossings:
    """A row for each time that a ride passes a place: the rows of a table (``lat, lon, dist``) nearest to it in each stretch within ``radius`` metres,
    if more than ``least`` metres after the last one; with ``crossing``, their number in the partition."""

    def __init__(self) -> None:
        self.best: tuple[float, Row] | None = None
        self.last: float | None = None
        self.count = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, lat: AnalyzeArgument, lon: AnalyzeArgument, radius: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        return _result(rows, {"crossing": LongType()}, ("lat", "lon", "dist"))

    def eval(self, row: Row, lat: float, lon: float, radius: float, least: float) -> Iterator[tuple]:
        self.least = least
        known = row["lat"] is not None and row["lon"] is not None
        away = math.hypot((row["lon"] - lon) * DEGREE_M * math.cos(math.radians(lat)), (row["lat"] - lat) * DEGREE_M) if known else math.inf
        if away < radius:
            if self.best is None or away < self.best[0]:
                self.best = (away, row)
        else:
            yield from self.passed()

    def passed(self) -> Iterator[tuple]:
        if self.best is not None:
            row, self.best = self.best[1], None
            if self.last is None or row["dist"] - self.last > self.least:
                self.last, self.count = row["dist"], self.count + 1
                yield (*(v for k, v in row.asDict().items() if k != "crossing"), self.count)

    def terminate(self) -> Iterator[tuple]:
        yield from self.passed()


def register_tables(spark: SparkSession) -> list[str]:
    """Make the table functions ``reserve`` and ``crossings`` known to SQL; returns their names."""
    for name, kind in (("reserve", Reserve), ("crossings", Crossings)):
        spark.udtf.register(name, udtf(kind))
    return ["reserve", "crossings"]
