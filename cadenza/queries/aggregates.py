"""Aggregates, histograms, grids, calibration and scalar functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions import physics
from cadenza.functions.scalars import clamp
from cadenza.functions.wind import COMPASS, compass_bin, compass_name, sector_of, shelter_factor_column
from cadenza.operators import aggregates as agg
from cadenza.operators import ranks
from cadenza.operators.series import Series
from cadenza.plans import calibrate, sectors, summary
from cadenza.plans.mean_lap import stacked
from cadenza.plans.staging import Staging
from cadenza.queries.joins import _POINTS, _points
from cadenza.queries.registry import epoch, query, rounded, table
from cadenza.queries.series import USER, events


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS t, l_discount * 1000 AS rh, l_extendedprice / 50 AS h FROM lineitem),
p AS (SELECT *, 101325 * pow(1 - 2.25577e-5 * h, 5.25588) AS p, least(greatest(rh, 0), 100) / 100 * 610.78 * pow(10, 7.5 * t / (t + 237.3)) AS pv FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(p, 4) AS pressure, round(greatest(p - pv, 0) / (287.058 * (t + 273.15)) + pv / (461.495 * (t + 273.15)), 8) AS density,
       round(p / (287.058 * (t + 273.15)), 8) AS dry FROM p
""")
def humid_air_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Air density for temperatures, humidities and altitudes taken from order lines."""
    t, rh = F.col("l_quantity"), F.col("l_discount") * 1000
    p = physics.pressure_at_altitude(F.col("l_extendedprice") / 50)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").select(*keys, F.round(p, 4).alias("pressure"), F.round(physics.air_density(t, p, rh), 8).alias("density"), F.round(physics.air_density(t, p, F.lit(None).cast("double")), 8).alias("dry"))


@query("""
WITH l AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 3 AS v, l_discount - 0.05 AS th, l_tax - 0.04 AS a, CAST(l_partkey % 360 AS DOUBLE) * pi() / 180 AS h, CAST(2 AS DOUBLE) AS e, CAST(-1 AS DOUBLE) AS n FROM lineitem
), w AS (
  SELECT *, v - (e * sin(h) + n * cos(h)) AS along, e * cos(h) - n * sin(h) AS side FROM l
), s AS (
  SELECT *, sqrt(along * along + side * side) AS app FROM w
)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(atan2(side, along), 7) AS yaw,
       round(CASE WHEN v > 0.1 THEN (78 * 9.80665 * (sin(th) + 0.004 * cos(th)) + 0.5 * 1.2041 * 0.32 * (1 + 0.15 * CASE WHEN app > 1e-6 THEN pow(side / app, 2) ELSE 0 END) * app * along + 79.2 * a) * v / 0.976 ELSE 0 END, 5) AS watts
FROM s
""")
def required_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rider's power model on speeds, slopes and headings taken from order lines."""
    v, theta, accel = F.col("l_quantity") / 3, F.col("l_discount") - 0.05, F.col("l_tax") - 0.04
    heading = F.radians((F.col("l_partkey") % 360).cast("double"))
    east, north = F.lit(2.0), F.lit(-1.0)
    watts = physics.required_power(v, theta, accel, heading, east, north, *map(F.lit, (78.0, 0.004, 0.32, 1.2041, 0.976, 1.2, 0.15)))
    yaw = physics.apparent_wind(v, heading, east, north)["yaw"]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(yaw, 7).alias("yaw"), F.round(watts, 5).alias("watts"))


@query("""
SELECT p_partkey, round(least(greatest(ln(1.3 / z) / ln(10 / z), 0.08), 1), 8) AS shelter
FROM (SELECT p_partkey, least(greatest(CAST(p_size AS DOUBLE) / 40, 0.005), 2) AS z FROM part)
""")
def shelter_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much wind roughness leaves at rider height."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(shelter_factor_column(F.col("p_size") / 40), 8).alias("shelter"))


@query("""
WITH b AS (SELECT event_type, CAST(floor((value * 7.3 % 360) / 22.5 + 0.5) AS INT) % 16 AS bin, value FROM events WHERE value < 20),
g AS (SELECT event_type, bin, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.85) AS p85 FROM b GROUP BY ALL),
e AS (SELECT event_type, CAST(k AS INT) AS bin FROM (SELECT DISTINCT event_type FROM b), range(0, 16) r(k))
SELECT e.event_type, e.bin, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][e.bin + 1] AS label, coalesce(n, 0) AS n, round(p50, 6) AS p50, round(p85, 6) AS p85
FROM e LEFT JOIN g USING (event_type, bin)
""")
def compass_hist_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by compass point; empty points too."""
    degrees = F.pmod(F.col("value") * 7.3, F.lit(360.0))
    df = table(spark, sf_dir, "events").where("value < 20").select("event_type", "value", compass_bin(degrees).alias("bin"))
    found = agg.histogram(df, ("event_type",), "bin", 16, F.count(F.lit(1)).alias("n"), agg.percentile(F.col("value"), 0.5).alias("p50"), agg.percentile(F.col("value"), 0.85).alias("p85"))
    return found.select("event_type", "bin", F.element_at(F.array(*map(F.lit, COMPASS)), F.col("bin") + 1).alias("label"), F.coalesce("n", F.lit(0)).alias("n"), *rounded("p50", "p85"))


@query("""
SELECT p_partkey, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(floor((p_retailprice % 360) / 22.5 + 0.5) AS INT) % 16 + 1] AS point FROM part
""")
def compass_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", compass_name(F.col("p_retailprice")).alias("point"))


@query("""
WITH o AS (SELECT user_id, CAST(floor((value * 7.3 % 360) / 45) AS INT) % 8 AS o, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS share FROM o)
SELECT user_id, count(*) FILTER (WHERE share >= 0.05) AS spread FROM s GROUP BY user_id
""")
def octant_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octants that hold at least a twentieth of a user's rows."""
    df = table(spark, sf_dir, "events").select("user_id", sector_of(F.col("value") * 7.3, 45.0, 8).alias("octant"))
    return calibrate.octant_spread(df, ("user_id",), "octant")


_SECTORS = """
WITH c AS (
  SELECT user_id, event_type, avg(value) AS ratio, count(*) AS seconds FROM events GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY user_id) AS n FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ratio)
), m AS (
  SELECT user_id, ratio AS mid FROM r WHERE place = n // 2 + 1
), g AS (
  SELECT c.*, mid, row_number() OVER (PARTITION BY c.user_id ORDER BY ratio DESC, event_type) = 1 AS worst FROM c JOIN m USING (user_id)
)
"""


@query(_SECTORS + "SELECT user_id, event_type, round(ratio, 6) AS ratio, seconds, round(mid, 6) AS lap_median, ratio > mid + 0.02 AS worse, worst FROM g")
def sector_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps (users) by sectors (event types), each against the upper median of its lap."""
    return _cells(spark, sf_dir).select("user_id", "event_type", "seconds", "worse", "worst", *rounded("ratio", "lap_median"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(agg.steady_mean(F.col("value")).alias("ratio"), F.count(F.lit(1)).alias("seconds"))
    return sectors.judge_cells(cells, ("user_id",), "event_type", "ratio")


_TOTALS = _SECTORS + """, t AS (
SELECT event_type, quantile_cont(ratio, 0.5) AS ratio, avg(ratio) AS mean, stddev_pop(ratio) AS sd, CAST(sum(seconds) AS BIGINT) AS seconds, count(*) AS laps,
       count(*) FILTER (WHERE ratio > mid + 0.02) AS laps_worse, count(*) FILTER (WHERE worst) AS laps_worst FROM g GROUP BY event_type)
"""


@query(_TOTALS + "SELECT event_type, round(ratio, 6) AS ratio, round(mean, 6) AS mean, round(sd, 6) AS sd, seconds, laps, laps_worse, laps_worst, round(laps_worse / laps, 6) AS worse_share, round(laps_worst / laps, 6) AS worst_share FROM t")
def sector_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sectors.total_cells(_cells(spark, sf_dir), (), "event_type", "ratio", "seconds")
    return t.select("event_type", "seconds", "laps", "laps_worse", "laps_worst", *rounded("ratio", "mean", "sd", "worse_share", "worst_share"))


@query(_TOTALS + """SELECT arg_max(event_type, (laps_worst, ratio)) AS leak, arg_max(event_type, ratio) AS dearest, arg_min(event_type, ratio) AS cheapest FROM t WHERE laps >= 2""")
def leak_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector that is most often the worst, the dearest and the cheapest."""
    t = sectors.total_cells(_cells(spark, sf_dir), (), "event_type", "ratio", "seconds")
    return sectors.standouts(t, (), "event_type")


@query("""
SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.85), 6) AS p85,
       round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(stddev_pop(l_extendedprice), 4) AS sd FROM lineitem GROUP BY ALL
""")
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, keys = table(spark, sf_dir, "lineitem"), ("l_returnflag", "l_linestatus")
    shares = {f"p{int(p * 100):02d}": p for p in (0.05, 0.5, 0.85, 0.95)}
    found = ranks.quantiles(df, keys, "l_extendedprice", shares, Staging(spark).put)
    spread = df.groupBy(*keys).agg(F.round(agg.spread(F.col("l_extendedprice")), 4).alias("sd"))
    return found.join(spread, list(keys)).select(*keys, *rounded(*shares), "sd")


_RANKED = "WITH r AS (SELECT l_suppkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) "


@query(_RANKED + "SELECT l_suppkey, x AS upper_median FROM r WHERE i = n // 2")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.ranked(table(spark, sf_dir, "lineitem"), ("l_suppkey",), "l_extendedprice", {"upper_median": 0.5}, Staging(spark).put)


@query(_RANKED + "SELECT l_suppkey, x AS p75 FROM r WHERE i = floor(0.75 * n)")
def floor_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.ranked(table(spark, sf_dir, "lineitem"), ("l_suppkey",), "l_extendedprice", {"p75": 0.75}, Staging(spark).put)


@query("""
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value > 5),
h AS (SELECT *, rn <= n // 2 AS early FROM n),
r AS (SELECT user_id, early, value, avg(value) OVER (PARTITION BY user_id, early ORDER BY rn ROWS 29 PRECEDING) AS m, row_number() OVER (PARTITION BY user_id, early ORDER BY rn) AS k FROM h),
p AS (SELECT user_id, early, coalesce(pow(avg(pow(m, 4)) FILTER (WHERE k >= 30), 0.25), avg(value)) / avg(value) AS q FROM r GROUP BY ALL),
f AS (SELECT user_id, max(q) FILTER (WHERE early) AS first_half, max(q) FILTER (WHERE NOT early) AS second_half FROM p GROUP BY user_id)
SELECT user_id, round(first_half, 6) AS first_half, round(second_half, 6) AS second_half, round((first_half - second_half) / first_half * 100, 5) AS decoupling FROM f
""")
def half_split_decoupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised over plain mean of the first and second half of each user's larger events."""
    f = summary.half_split(events(spark, sf_dir, "value").where("value > 5"), USER, "value", "value")
    return f.select("user_id", *rounded("first_half", "second_half"), F.round("decoupling", 5).alias("decoupling"))


@query("""
WITH m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, avg(o_totalprice) AS np FROM orders GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) - 1 AS idx, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM m),
a AS (SELECT o_orderpriority, count(*) AS laps, avg(np) AS mean, stddev_pop(np) AS sd, regr_slope(np, idx) AS slope, arg_max(idx, (np, -idx)) AS hardest, max(np) AS top,
      avg(np) FILTER (WHERE idx < n // 3) AS opening, avg(np) FILTER (WHERE idx >= n - n // 3) AS closing FROM l GROUP BY o_orderpriority)
SELECT o_orderpriority, laps, round(mean, 4) AS avg_np, round(sd, 4) AS sd, round(slope / mean * 100, 6) AS slope_pct, CASE WHEN slope / mean * 100 < -0.6 THEN 'fading' WHEN slope / mean * 100 > 0.6 THEN 'building' ELSE 'steady' END AS trend,
       round(opening, 4) AS opening_np, round(closing, 4) AS closing_np, round((opening - closing) / closing * 100, 5) AS opening_vs_closing_pct, hardest AS hardest_lap, round((top - mean) / sd, 6) AS hardest_z FROM a
""")
def lap_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether monthly means build or fade, thirds against each other, and the month that stands out."""
    m = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("np"))
    m = m.withColumn("lap", Series(("o_orderpriority",), ("month",)).place)
    shape = summary.shape_of(m, ("o_orderpriority",), "lap", "np")
    return shape.select("o_orderpriority", "laps", "trend", "hardest_lap", *rounded("avg_np", "sd", "opening_np", "closing_np", digits=4), *rounded("slope_pct", "hardest_z"), F.round("opening_vs_closing_pct", 5).alias("opening_vs_closing_pct"))


@query(f"""
WITH p AS ({_POINTS}), c AS (SELECT label, avg(x) AS mx, avg(y) AS my FROM p GROUP BY label),
d AS (SELECT label, mx, my, x - mx AS u, y - my AS v FROM p JOIN c USING (label)),
s AS (SELECT label, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * (u * u + v * v)) AS uz, sum(v * (u * u + v * v)) AS vz FROM d GROUP BY label),
r AS (SELECT *, (uz * vv - vz * uv) / (2 * (uu * vv - uv * uv)) AS a, (vz * uu - uz * uv) / (2 * (uu * vv - uv * uv)) AS b FROM s)
SELECT label, n, round(mx + a, 6) AS cx, round(my + b, 6) AS cy, round(sqrt(a * a + b * b + (uu + vv) / n), 6) AS radius FROM r
""")
def circle_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares circles through the points of each label."""
    return agg.fit_circle(_points(spark, sf_dir), ("label",), "x", "y").select("label", "n", *rounded("cx", "cy", "radius"))


@query("""
WITH f AS (SELECT user_id, event_id, value BETWEEN 20 AND 60 AS strict, value BETWEEN 5 AND 120 AS loose FROM events),
c AS (SELECT *, count(*) FILTER (WHERE strict) OVER (PARTITION BY user_id) AS ns, count(*) FILTER (WHERE loose) OVER (PARTITION BY user_id) AS nl FROM f)
SELECT user_id, event_id, ns < 25 AND nl > ns AS relaxed FROM c WHERE CASE WHEN ns < 25 AND nl > ns THEN loose ELSE strict END
""")
def cohort_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass a strict test, or a loose one where too few of a user's pass the strict one."""
    x = F.col("value")
    return calibrate.relaxed_cohort(events(spark, sf_dir, "value"), ("user_id",), x.between(20, 60), x.between(5, 120), 25).select("user_id", "event_id", "relaxed")


@query()
def bisection_p85(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drag area at which the 85th percentile of actual over needed power is 1. Eighteen percentiles of all rows are too
    slow in SQL; ``tests/test_drag.py`` holds this against NumPy."""
    c = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 8).alias("watts"), (100 + F.col("l_discount") * 500).alias("fixed"), (200 + F.col("l_tax") * 1000).alias("per_cda"))
    found = calibrate.solve_drag(c, ("l_returnflag",), floor=F.lit(40.0), default=F.lit(0.32), pct=0.85)
    return found.select("l_returnflag", F.round("cda", 6).alias("cda"), "ok")


@query("""
WITH c AS (SELECT CAST(e AS DOUBLE) AS e, CAST(n AS DOUBLE) AS n FROM range(-3, 4) a(e), range(-3, 4) b(n)),
v AS (SELECT user_id, e, n, event_id % 8 AS o, value / (60 + 4 * (e * sin(radians((event_id % 8) * 45)) + n * cos(radians((event_id % 8) * 45)))) AS r FROM events, c),
q AS (SELECT user_id, e, n, o, quantile_cont(r, 0.85) AS q, count(*) AS w FROM v GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT user_id, e, n, sum(w * q * q) / sum(w) - pow(sum(w * q) / sum(w), 2) AS cost FROM q GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(cost, 9), e, n) AS k FROM s)
SELECT user_id, e, n, round(cost, 6) AS cost FROM r WHERE k = 1
""")
def grid_search_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate wind at which octants agree best; ties go to the first in scan order. One task solves one user."""
    side = np.arange(-3.0, 4.0)
    winds = np.array([(e, n) for e in side for n in side])

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        octant = frame["octant"].to_numpy(int)
        angle = np.radians(octant * 45)
        need = 60 + 4 * (winds[:, :1] * np.sin(angle) + winds[:, 1:] * np.cos(angle))
        cost = calibrate.octant_costs(frame["value"].to_numpy(float), need, octant, -np.inf, 0.85, 3, 0)
        k = int(np.argmin(np.round(cost, 9)))
        return pd.DataFrame([(*key, *winds[k], cost[k])] if np.isfinite(cost[k]) else [], columns=["user_id", "e", "n", "cost"])

    ev = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 8).alias("octant"), "value")
    return ev.groupBy("user_id").applyInPandas(solve, "user_id long, e double, n double, cost double").withColumn("cost", F.round("cost", 6))


@query("""
WITH h AS (SELECT event_type, user_id, hour(ts) AS h, avg(value) AS x FROM events GROUP BY ALL), g AS (SELECT event_type, h, quantile_cont(x, 0.5) AS x, count(*) AS n FROM h GROUP BY ALL)
SELECT event_type, h, round(x, 6) AS x, n, min(n) OVER (PARTITION BY event_type) >= 3 AS complete FROM g
""")
def median_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over users at each hour, and whether every hour has three of them."""
    h = table(spark, sf_dir, "events").groupBy("event_type", "user_id", F.hour("ts").cast("long").alias("h")).agg(F.avg("value").alias("x"))
    return stacked(h, ("event_type",), "h", ["x"], 3).select("event_type", "h", *rounded("x"), F.col("passes").alias("n"), F.col("sound").alias("complete"))


@query("""
SELECT user_id, event_type, count(*) AS seconds, round(avg(value), 6) AS avg, round(max(value), 6) AS peak, round(100.0 * count(*) FILTER (WHERE value >= 60) / count(*), 6) AS exposed, round(100.0 * count(*) FILTER (WHERE value <= 10) / count(*), 6) AS sheltered,
       round(quantile_cont(value, 0.5), 6) AS median, round(sum(greatest(60 - value, 0)), 6) AS saved, arg_max(value, (ts, event_id)) AS at_end FROM events GROUP BY ALL
""")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user and type with the report's exposure columns and the last value."""
    x = F.col("ratio")
    config = ModelConfig(exposed_at=60.0, sheltered_at=10.0)
    s = events(spark, sf_dir, "event_type", "value").withColumnRenamed("value", "ratio").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("seconds"), F.avg(x).alias("avg"), F.max(x).alias("peak"), *summary.exposure(config),
        F.sum(F.greatest(60 - x, F.lit(0.0))).alias("saved"), agg.exact_argmax("ratio", F.col("ts"), F.col("event_id")).alias("at_end"),
    )
    return s.select("user_id", "event_type", "seconds", "at_end", *rounded("avg", "peak", "exposed", "sheltered", "median", "saved"))


@query("""
SELECT label, round(min(x), 6) AS west, round(max(x), 6) AS east, round(min(y), 6) AS south, round(max(y), 6) AS north,
       round(min(x) - greatest((max(x) - min(x)) * 0.18, 0.0010), 6) AS padded_west, round(max(y) + greatest((max(y) - min(y)) * 0.18, 0.0008), 6) AS padded_north
FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) GROUP BY label
""")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around places, plain and padded."""
    from cadenza.functions.geo import bounding_box, padded_box

    b = _points(spark, sf_dir).groupBy("label").agg(*bounding_box(F.col("y"), F.col("x")))
    padded = [c.alias(n) for c, n in zip(padded_box(*map(F.col, ("south", "west", "north", "east"))), ("ps", "pw", "pn", "pe"))]
    b = b.select("*", *padded)
    return b.select("label", *rounded("west", "east", "south", "north"), F.round("pw", 6).alias("padded_west"), F.round("pn", 6).alias("padded_north"))


@query("""
WITH q AS (SELECT user_id, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.95) AS b FROM events GROUP BY user_id)
SELECT user_id, round(m, 6) AS centre, round(greatest(0.05, m - a, b - m), 6) AS half_span FROM q
""")
def centred_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle and half width of a colour scale."""
    return agg.centred_scale(table(spark, sf_dir, "events"), ("user_id",), "value").select("user_id", *rounded("centre", "half_span"))


@query("""
WITH m AS (SELECT user_id, min(epoch(ts)) AS a, max(epoch(ts)) AS b FROM events GROUP BY user_id)
SELECT e.user_id, least(CAST(floor((epoch(ts) - a) / (b - a) * 40) AS BIGINT), 39) AS pixel, round(avg(value), 6) AS ratio, count(*) AS n FROM events e JOIN m USING (user_id) WHERE b > a GROUP BY ALL
""")
def pixel_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of forty columns of equal time."""
    e = events(spark, sf_dir, "value").withColumn("t", epoch("ts"))
    return agg.pixel_means(e, ("user_id",), "t", "value", 40, "ratio").select("user_id", "pixel", *rounded("ratio"), "n")


@query("""SELECT c_custkey, round(coalesce(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 5000 THEN 5000 ELSE c_acctbal END), 6) AS clamped FROM customer""")
def clamped_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(clamp(F.col("c_acctbal"), 0.0, 5000.0), 6).alias("clamped"))


