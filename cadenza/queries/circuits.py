"""Rides of 600 events each on circuits, on straight roads and with a way to the circuit: the search of laps and the fit of winds, beside SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.geo import DEGREE_M
from cadenza.functions.physics import GRAVITY, required_power
from cadenza.plans import calibrate, laps
from cadenza.plans.staging import Staging
from cadenza.queries.registry import query, rounded, table

#: Seconds of a ride, metres of a lap, seconds of the way to it.
SECONDS, LAP, APPROACH = 600, 700.0, 90
CONFIG = ModelConfig()

_RIDES = f"""
WITH RECURSIVE e AS (
  SELECT CAST(event_id // {SECONDS} AS VARCHAR) AS ride_id, event_id // {SECONDS} AS r, row_number() OVER (PARTITION BY event_id // {SECONDS} ORDER BY event_id) - 1 AS i, 8 + value % 4 AS v FROM events
), d AS (
  SELECT *, sum(v) OVER (PARTITION BY r ORDER BY i) AS dist FROM e
), p AS (
  SELECT *, 2 * pi() * dist / {LAP} AS angle FROM d
), q AS (
  SELECT *, CASE WHEN r % 4 = 1 THEN dist ELSE {LAP} / (2 * pi()) * cos(angle) + CASE WHEN r % 4 = 2 THEN greatest({APPROACH} - i, 0) * 12 ELSE 0 END END AS x,
         CASE WHEN r % 4 = 1 THEN 0 ELSE {LAP} / (2 * pi()) * sin(angle) + CASE WHEN r % 4 = 2 THEN greatest({APPROACH} - i, 0) * 5 ELSE 0 END END AS y,
         CASE WHEN r % 4 = 1 THEN 0 ELSE atan2(-sin(angle), cos(angle)) END AS heading FROM p
), g AS (
  SELECT ride_id, i, v, dist, heading, v > 8.3 AS moving, 45 + y / {DEGREE_M!r} AS lat, 7 + x / ({DEGREE_M!r} * 0.7071) AS lon FROM q
)"""


def circuit_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 600 events are a ride of a row a second: rides multiply with the table and stay bounded."""
    ride = F.floor(F.col("event_id") / SECONDS)
    w = Window.partitionBy("ride_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("event_id", ride.alias("r"), ride.cast("string").alias("ride_id"), (8 + F.col("value") % 4).alias("v"))
    e = e.withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "dist": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    angle, radius = 2 * math.pi * F.col("dist") / LAP, F.lit(LAP) / (2 * math.pi)
    way = lambda metres: F.when(F.col("r") % 4 == 2, F.greatest(APPROACH - F.col("i"), F.lit(0)) * metres).otherwise(0)
    straight = F.col("r") % 4 == 1
    x = F.when(straight, F.col("dist")).otherwise(radius * F.cos(angle) + way(12))
    y = F.when(straight, 0.0).otherwise(radius * F.sin(angle) + way(5))
    heading = F.when(straight, 0.0).otherwise(F.atan2(-F.sin(angle), F.cos(angle)))
    return e.select("ride_id", "i", "v", "dist", heading.alias("heading"), (F.col("v") > 8.3).alias("moving"), (45 + y / DEGREE_M).alias("lat"), (7 + x / (DEGREE_M * 0.7071)).alias("lon"))


@query(_RIDES + f""", n AS (
  SELECT *, count(*) OVER (PARTITION BY ride_id) AS n, min(CASE WHEN moving THEN i END) OVER (PARTITION BY ride_id) AS first FROM g
), c AS (
  SELECT ride_id, i AS anchor, lat, lon, heading FROM n WHERE moving AND (i - first) % 3 = 0 AND i >= first AND i < floor(n * 0.6)
), k AS (
  SELECT c.ride_id, anchor, g.i, g.dist, sqrt(pow((g.lon - c.lon) * {DEGREE_M!r} * cos(radians(c.lat)), 2) + pow((g.lat - c.lat) * {DEGREE_M!r}, 2)) AS away, g.heading - c.heading AS d FROM c JOIN g ON c.ride_id = g.ride_id
), s AS (
  SELECT *, i - row_number() OVER (PARTITION BY ride_id, anchor ORDER BY i) AS run FROM k WHERE away < {CONFIG.lap_radius} AND abs(d - 2 * pi() * ceil((d - pi()) / (2 * pi()))) < {laps.SAME_WAY}
), a AS (
  SELECT ride_id, anchor, arg_min(i, (away, i)) AS i, arg_min(dist, (away, i)) AS dist, row_number() OVER (PARTITION BY ride_id, anchor ORDER BY min(i)) AS k FROM s GROUP BY ride_id, anchor, run
), f AS (
  SELECT ride_id, anchor, k, i, dist, TRUE AS kept, dist AS last FROM a WHERE k = 1
  UNION ALL
  SELECT a.ride_id, a.anchor, a.k, a.i, a.dist, a.dist - f.last > {CONFIG.min_lap_metres}, CASE WHEN a.dist - f.last > {CONFIG.min_lap_metres} THEN a.dist ELSE f.last END FROM f JOIN a ON a.ride_id = f.ride_id AND a.anchor = f.anchor AND a.k = f.k + 1
), m AS (
  SELECT ride_id, anchor, lag(i) OVER w AS i0, i AS i1, dist - lag(dist) OVER w AS len FROM f WHERE kept WINDOW w AS (PARTITION BY ride_id, anchor ORDER BY k)
), z AS (
  SELECT *, median(len) OVER b AS mid, count(len) OVER b AS laps FROM m WINDOW b AS (PARTITION BY ride_id, anchor)
), o AS (
  SELECT *, sqrt(avg(pow(len - mid, 2)) OVER (PARTITION BY ride_id, anchor)) / mid AS scatter FROM z WHERE i0 IS NOT NULL AND laps >= 2
), h AS (
  SELECT *, count(*) OVER (PARTITION BY ride_id, anchor) AS good FROM o WHERE mid > 0 AND scatter <= {laps.SCATTER} AND len > 0.7 * mid AND len < 1.4 * mid
), b AS (
  SELECT *, min(anchor) OVER (PARTITION BY ride_id) AS least FROM h WHERE good >= 2
), x AS (
  SELECT ride_id, row_number() OVER (PARTITION BY ride_id ORDER BY i0) AS lap, i0, i1, 'gps' AS source FROM b WHERE anchor = least
)
SELECT * FROM x UNION ALL SELECT ride_id, 1, min(i), max(i), 'none' FROM g WHERE ride_id NOT IN (SELECT ride_id FROM x) GROUP BY ride_id
""")
def lap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps found from repeated passes of a place, where nobody marked any."""
    grid = Staging(spark).put(circuit_rides(spark, sf_dir), "grid")
    rides = grid.select("ride_id").distinct().withColumns({"anchor_lat": F.lit(None).cast("double"), "anchor_lon": F.lit(None).cast("double")})
    marks = rides.select("ride_id", F.lit(None).cast("array<long>").alias("marks"))
    return laps.detect_laps(grid, rides, marks, CONFIG)


def _wind_sql() -> str:
    """The search of winds, all candidates against all seconds: three grids, in each a drag area by halving for every wind, then the cost of its octants."""
    c = ModelConfig()
    ratio = lambda cda, q="watts": f"CASE WHEN fixed + per_cda * {cda} > floor THEN {q} / (fixed + per_cda * {cda}) END"
    steps = [
        f"""x AS (
  SELECT ride_id, i, v, heading, 0.01 * sin(i / 9) AS theta, 0.02 * cos(i / 5) AS accel, v - (2.5 * sin(heading) - 1.5 * cos(heading)) AS along, 2.5 * cos(heading) + 1.5 * sin(heading) AS across FROM g
), w AS (
  SELECT *, (0.9 + 0.2 * (i * 0.6180339887 - floor(i * 0.6180339887))) * ((78 * {GRAVITY!r} * (sin(theta) + {c.crr} * cos(theta)) + (78 + {c.rotating_mass}) * accel) * v
    + 0.3 * 0.5 * 1.2 * (1 + {c.yaw_factor} * pow(across / sqrt(along * along + across * across), 2)) * sqrt(along * along + across * across) * along * v) / {c.efficiency} AS watts FROM x
), n AS (
  SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY i) - 1 AS place, count(*) OVER (PARTITION BY ride_id) AS n FROM w
), t AS MATERIALIZED (
  SELECT *, (78 * {GRAVITY!r} * (sin(theta) + {c.crr} * cos(theta)) + (78 + {c.rotating_mass}) * accel) * v / {c.efficiency} AS fixed, greatest(40, 0.5 * 250) AS floor, CAST(floor((degrees(heading) - 360 * floor(degrees(heading) / 360)) / 45) AS INT) % 8 AS octant
  FROM n WHERE n >= 120 AND place % greatest(1, n // {calibrate.SAMPLE}) = 0
), o AS (
  SELECT ride_id, octant, count(*) AS k, sum(count(*)) OVER (PARTITION BY ride_id) AS m FROM t GROUP BY ride_id, octant
), spread AS MATERIALIZED (
  SELECT ride_id, count(*) FILTER (WHERE k >= 0.05 * m) AS spread FROM o GROUP BY ride_id
), best0 AS MATERIALIZED (
  SELECT ride_id, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS n, CAST({c.cda} AS DOUBLE) AS cda, CAST('inf' AS DOUBLE) AS cost FROM spread WHERE spread >= 4
)"""
    ]
    for level, (reach, step) in enumerate(((7.0, 1.0), (1.0, 0.25), (0.3, 0.1))):
        side = [float(x) for x in np.arange(-reach, reach + 1e-9, step)]
        s = f"_{level}"
        steps.append(
            f"""c{s} AS (
  SELECT b.ride_id, ei * {len(side)} + ni AS k, b.e + {side}[ei + 1] AS e, b.n + {side}[ni + 1] AS n FROM best{level} b, (SELECT unnest(range({len(side)})) AS ei), (SELECT unnest(range({len(side)})) AS ni)
), a{s} AS (
  SELECT c.*, watts, fixed, floor, octant, v, v - (e * sin(heading) + n * cos(heading)) AS along, e * cos(heading) - n * sin(heading) AS across FROM c{s} c JOIN (SELECT * EXCLUDE (n) FROM t) t ON c.ride_id = t.ride_id
), r{s} AS MATERIALIZED (
  SELECT *, 0.5 * 1.2 * (1 + {c.yaw_factor} * CASE WHEN sqrt(along * along + across * across) > 1e-6 THEN pow(across / sqrt(along * along + across * across), 2) ELSE 0 END) * sqrt(along * along + across * across) * along * v / {c.efficiency} AS per_cda FROM a{s}
), h{s}_0 AS MATERIALIZED (
  SELECT ride_id, k, CAST({calibrate.LOW} AS DOUBLE) AS low, CAST({calibrate.HIGH} AS DOUBLE) AS high, count({ratio(calibrate.LOW)}) >= 20 AND count({ratio(calibrate.HIGH)}) >= 20 AND count(*) >= 30 AS known,
         quantile_cont({ratio(calibrate.LOW)}, {c.clean_air_pct}) < 1 AS under, quantile_cont({ratio(calibrate.HIGH)}, {c.clean_air_pct}) > 1 AS over FROM r{s} GROUP BY ride_id, k
)"""
        )
        for h in range(calibrate.HALVINGS):
            steps.append(
                f"""h{s}_{h + 1} AS MATERIALIZED (
  SELECT h.ride_id, h.k, CASE WHEN coalesce(q > 1, FALSE) THEN (low + high) / 2 ELSE low END AS low, CASE WHEN coalesce(q > 1, FALSE) THEN high ELSE (low + high) / 2 END AS high, known, under, over
  FROM h{s}_{h} h JOIN (SELECT r.ride_id, r.k, quantile_cont({ratio('((low + high) / 2)')}, {c.clean_air_pct}) AS q FROM r{s} r JOIN h{s}_{h} h ON r.ride_id = h.ride_id AND r.k = h.k GROUP BY r.ride_id, r.k) m ON m.ride_id = h.ride_id AND m.k = h.k
)"""
            )
        steps.append(
            f"""d{s} AS MATERIALIZED (
  SELECT ride_id, k, CASE WHEN NOT known THEN {c.cda} WHEN under THEN {calibrate.LOW} WHEN over THEN {calibrate.HIGH} ELSE (low + high) / 2 END AS cda FROM h{s}_{calibrate.HALVINGS}
), q{s} AS (
  SELECT r.ride_id, r.k, octant, any_value(d.cda) AS cda, quantile_cont({ratio('d.cda')}, {c.clean_air_pct}) AS q, count({ratio('d.cda')}) AS m FROM r{s} r JOIN d{s} d ON r.ride_id = d.ride_id AND r.k = d.k GROUP BY r.ride_id, r.k, octant HAVING count({ratio('d.cda')}) >= 12
), v{s} AS (
  SELECT ride_id, k, sum(m * q * q) / sum(m) - pow(sum(m * q) / sum(m), 2) AS cost FROM q{s} GROUP BY ride_id, k HAVING sum(m) >= 60
), m{s} AS (
  SELECT ride_id, arg_min(k, (cost, k)) AS k, min(cost) AS cost FROM v{s} GROUP BY ride_id
), best{level + 1} AS MATERIALIZED (
  SELECT b.ride_id, CASE WHEN m.cost < b.cost THEN c.e ELSE b.e END AS e, CASE WHEN m.cost < b.cost THEN c.n ELSE b.n END AS n, CASE WHEN m.cost < b.cost THEN d.cda ELSE b.cda END AS cda, least(b.cost, coalesce(m.cost, b.cost)) AS cost
  FROM best{level} b LEFT JOIN m{s} m ON m.ride_id = b.ride_id LEFT JOIN c{s} c ON c.ride_id = b.ride_id AND c.k = m.k LEFT JOIN d{s} d ON d.ride_id = b.ride_id AND d.k = m.k
)"""
        )
    return (
        _RIDES + ", " + ", ".join(steps)
        + f"""
SELECT n.ride_id, round(coalesce(b.e, 0), 4) AS we, round(coalesce(b.n, 0), 4) AS wn, round(coalesce(b.cda, {c.cda}), 5) AS cda, coalesce(isfinite(b.cost), FALSE) AS ok, CAST(coalesce(s.spread, 0) AS INT) AS spread, n.n AS cohort_size
FROM (SELECT ride_id, count(*) AS n FROM w GROUP BY ride_id) n LEFT JOIN spread s ON s.ride_id = n.ride_id LEFT JOIN best3 b ON b.ride_id = n.ride_id
"""
    )


@query(_wind_sql())
def wind_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind and drag area of each ride by the search of winds with which all headings look equally hard; ridden in one of 2.5 m/s to the east and 1.5 to the south."""
    i = F.col("i")
    rides = circuit_rides(spark, sf_dir).withColumns({"theta": 0.01 * F.sin(i / 9), "accel": 0.02 * F.cos(i / 5), "mass": F.lit(78.0), "cp": F.lit(250.0), "rho": F.lit(1.2)})
    need = required_power(*map(F.col, ("v", "theta", "accel", "heading")), F.lit(2.5), F.lit(-1.5), F.col("mass"), F.lit(CONFIG.crr), F.lit(0.3), F.col("rho"), F.lit(CONFIG.efficiency), F.lit(CONFIG.rotating_mass), F.lit(CONFIG.yaw_factor))
    return calibrate.fit_wind(rides.withColumn("watts", (0.9 + 0.2 * (i * 0.6180339887 - F.floor(i * 0.6180339887))) * need), CONFIG).select("ride_id", *rounded("we", "wn", digits=4), F.round("cda", 5).alias("cda"), "ok", "spread", "cohort_size")
