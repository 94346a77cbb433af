"""The functions as a SQL user calls them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.physics import GRAVITY
from cadenza.functions.sql import register_functions, register_tables
from cadenza.queries.circuits import _RIDES, circuit_rides
from cadenza.queries.registry import query, table


@query(f"""
WITH e AS (SELECT event_id, value, event_id % 360 AS b, 5 + event_id % 7 AS v, radians(CAST(event_id % 90 AS DOUBLE)) AS h, -(value / 20) * sin(radians(CAST(event_id % 360 AS DOUBLE))) AS we, -(value / 20) * cos(radians(CAST(event_id % 360 AS DOUBLE))) AS wn FROM events),
a AS (SELECT *, v - (we * sin(h) + wn * cos(h)) AS along, we * cos(h) - wn * sin(h) AS across FROM e)
SELECT event_id, round((78 * {GRAVITY!r} * 0.004 * v + 0.3 * 0.5 * 1.2 * (1 + 0.15 * CASE WHEN sqrt(along * along + across * across) > 1e-6 THEN pow(across / sqrt(along * along + across * across), 2) ELSE 0 END) * sqrt(along * along + across * across) * along * v) / 0.976, 4) AS watts,
       ['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'][1 + CAST(floor(b / 22.5 + 0.5) AS INT) % 16] AS compass
FROM a
""")
def sql_required_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power needed in a wind, by SQL functions."""
    register_functions(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("cadenza_events")
    return spark.sql("""
        SELECT event_id, compass_name(CAST(event_id % 360 AS DOUBLE)) AS compass,
               round(required_power(5 + event_id % 7, 0, 0, radians(event_id % 90), wind_east(value / 20, event_id % 360), wind_north(value / 20, event_id % 360), 78, 0.004, 0.3, 1.2, 0.976, 1.2, 0.15), 4) AS watts
        FROM cadenza_events""")


_PLACE = (45.0, 7.0 + 700.0 / 6.283185307179586 / (111320.0 * 0.7071))


@query(_RIDES + f""", k AS (
  SELECT *, sqrt(pow((lon - {_PLACE[1]!r}) * 111320 * cos(radians({_PLACE[0]})), 2) + pow((lat - {_PLACE[0]}) * 111320, 2)) AS away FROM g
), s AS (
  SELECT *, i - row_number() OVER (PARTITION BY ride_id ORDER BY i) AS run FROM k WHERE away < 30
), a AS (
  SELECT ride_id, arg_min(i, (away, i)) AS i, arg_min(dist, (away, i)) AS dist, row_number() OVER (PARTITION BY ride_id ORDER BY min(i)) AS k FROM s GROUP BY ride_id, run
), f AS (
  SELECT ride_id, k, i, dist AS last, CAST(1 AS BIGINT) AS crossing, TRUE AS kept FROM a WHERE k = 1
  UNION ALL
  SELECT a.ride_id, a.k, a.i, CASE WHEN a.dist - f.last > 400 THEN a.dist ELSE f.last END, CASE WHEN a.dist - f.last > 400 THEN f.crossing + 1 ELSE f.crossing END, a.dist - f.last > 400 FROM f JOIN a ON a.ride_id = f.ride_id AND a.k = f.k + 1
)
SELECT ride_id, i, crossing FROM f WHERE kept
""")
def sql_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When rides pass a line, by a table function."""
    register_tables(spark)
    circuit_rides(spark, sf_dir).createOrReplaceTempView("cadenza_seconds")
    return spark.sql(f"SELECT ride_id, i, crossing FROM crossings(TABLE(cadenza_seconds) PARTITION BY ride_id ORDER BY (i), {_PLACE[0]!r}D, {_PLACE[1]!r}D, 30D, 400D)")


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, coalesce(avg(40 - value) FILTER (WHERE value <= 40) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS d FROM events
), f AS (
  SELECT user_id, event_id, i, CASE WHEN value > 40 THEN greatest(500 - (value - 40), 0) ELSE CAST(500 AS DOUBLE) END AS b FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i, CASE WHEN value > 40 THEN greatest(f.b - (value - 40), 0) ELSE 500 - (500 - f.b) * exp(-1 / (546 * exp(-0.01 * d) + 316)) END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1
)
SELECT event_id, round(b, 6) AS balance FROM f
""")
def sql_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's reserve, by a table function."""
    register_tables(spark)
    table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("watts")).createOrReplaceTempView("cadenza_watts")
    return spark.sql("SELECT event_id, round(balance, 6) AS balance FROM reserve(TABLE(cadenza_watts) PARTITION BY user_id ORDER BY (ts, event_id), 40D, 500D)")
