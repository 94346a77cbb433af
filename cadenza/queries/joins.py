"""Joins by nearness in time, in intervals and in the plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.geo import haversine_km, planar_metres
from cadenza.functions.wind import wind_bearing, wind_vector
from cadenza.operators.joins import asof_join, band_pairs, interval_join, nearest_place, segments, within_radius
from cadenza.operators.series import Series
from cadenza.plans.staging import Staging
from cadenza.queries.registry import epoch, query, table
from cadenza.queries.series import events, numbered


@query("""
WITH p AS (SELECT user_id, ts AS bought, value AS paid, event_id AS purchase FROM events WHERE event_type = 'purchase')
SELECT e.event_id, coalesce(p.purchase, -1) AS purchase, p.paid FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.bought
""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase at or before each event, -1 where there is none."""
    df = events(spark, sf_dir, "value", "event_type")
    bought = df.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("paid"), F.col("event_id").alias("purchase"))
    found = asof_join(df, bought, ("user_id",), "ts", "at", ["purchase", "paid"], tie=("purchase",), bucket=lambda t: F.date_trunc("day", t))
    return found.select("event_id", F.coalesce("purchase", F.lit(-1)).alias("purchase"), "paid")


@query("""
WITH h AS (
  SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS hr, avg(value) AS speed, CAST(sum(event_id) % 360 AS DOUBLE) AS dir FROM events GROUP BY 1
), w AS (
  SELECT hr, -speed * sin(radians(dir)) AS e, -speed * cos(radians(dir)) AS n, speed FROM h
), s AS (
  SELECT hr, lead(hr) OVER (ORDER BY hr) AS next_hr, e, n, speed, lead(e) OVER (ORDER BY hr) AS next_e, lead(n) OVER (ORDER BY hr) AS next_n, lead(speed) OVER (ORDER BY hr) AS next_speed FROM w
), j AS (
  SELECT event_id, (epoch(ts) - hr) / (next_hr - hr) AS f, s.* FROM events JOIN s ON epoch(ts) >= hr AND epoch(ts) < next_hr
), v AS (
  SELECT event_id, e + (next_e - e) * f AS e, n + (next_n - n) * f AS n, speed + (next_speed - speed) * f AS plain FROM j
)
SELECT event_id, round(sqrt(e * e + n * n), 6) AS speed, round((degrees(atan2(-e, -n)) + 360) % 360, 5) AS bearing, round(plain, 6) AS plain FROM v
""")
def asof_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hourly winds interpolated to each event, as vectors."""
    df = events(spark, sf_dir, "value").withColumn("at_s", epoch("ts"))
    hours = df.groupBy((F.floor(F.col("at_s") / 21600) * 21600).alias("at")).agg(F.avg("value").alias("speed"), (F.sum("event_id") % 360).cast("double").alias("dir"))
    east, north = wind_vector(F.col("speed"), F.col("dir"))
    # the table of hours has four rows a day, so one window over all of it stays small
    steps = segments(hours.select("at", east.alias("e"), north.alias("n"), "speed"), (), "at", ["e", "n", "speed"]).where("next_at is not null")
    j = interval_join(df.select("event_id", "at_s"), steps, (), F.col("at_s"), "at", "next_at", 21600, right_open=True)
    share = (F.col("at_s") - F.col("at")) / (F.col("next_at") - F.col("at"))
    v = j.select("event_id", *((F.col(c) + (F.col(f"next_{c}") - F.col(c)) * share).alias(c) for c in ("e", "n", "speed")))
    return v.select("event_id", F.round(F.hypot("e", "n"), 6).alias("speed"), F.round(wind_bearing(F.col("e"), F.col("n")), 5).alias("bearing"), F.round("speed", 6).alias("plain"))


@query("""
WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
s AS (SELECT user_id, i AS i0, lead(i) OVER (PARTITION BY user_id ORDER BY i) AS i1, row_number() OVER (PARTITION BY user_id ORDER BY i) AS lap FROM n WHERE i % 10 = 0)
SELECT s.user_id, lap, count(*) AS n, round(sum(value), 6) AS total FROM n JOIN s ON n.user_id = s.user_id AND n.i BETWEEN i0 AND i1 GROUP BY s.user_id, lap
""")
def interval_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in laps of ten; rows on a boundary belong to both laps."""
    df = numbered(spark, sf_dir, "value")
    s = Series(("user_id",), ("i",))
    laps = df.where("i % 10 = 0").select("user_id", F.col("i").alias("i0"), F.lead("i").over(s.window).alias("i1"), (s.place + 1).alias("lap")).where("i1 is not null")
    j = interval_join(df, laps, ("user_id",), F.col("i"), "i0", "i1", 16)
    return j.groupBy("user_id", "lap").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""
SELECT e.event_id FROM events e WHERE e.event_type = 'purchase' AND EXISTS (
  SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND epoch(e.ts) >= epoch(s.ts) - 7200 AND epoch(e.ts) <= epoch(s.ts) + 25200)
""")
def semi_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from two hours before to seven hours after some signup of the same user."""
    df = events(spark, sf_dir, "event_type").withColumn("at_s", epoch("ts"))
    spans = df.where("event_type = 'signup'").select("user_id", (F.col("at_s") - 7200).alias("a"), (F.col("at_s") + 25200).alias("b"))
    return interval_join(df.where("event_type = 'purchase'"), spans, ("user_id",), F.col("at_s"), "a", "b", 28800, how="left_semi").select("event_id")


_POINTS = "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@query(f"""
WITH p AS ({_POINTS}), d AS (
  SELECT a.vec_id, b.vec_id AS nearest, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nearest) AS k FROM d WHERE d < 0.05
)
SELECT vec_id, nearest, round(d, 9) AS distance FROM r WHERE k = 1
""")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all points within 0.05, in the plane of the first two coordinates, for each point of the query set (ids divisible by 100)."""
    p = _points(spark, sf_dir).drop("label")
    near = within_radius(p.withColumnRenamed("vec_id", "other"), p.where("vec_id % 100 = 0"), (), "x", "y", 0.05).where("vec_id <> other")
    best = near.groupBy("vec_id").agg(F.min(F.struct("distance", "other")).alias("m"))
    return best.select("vec_id", F.col("m.other").alias("nearest"), F.round("m.distance", 9).alias("distance"))


@query()
def nearest_neighbour_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other point of every point, however far, in the plane of the first two coordinates. In SQL this is a join of all pairs."""
    found = nearest_place(_points(spark, sf_dir), "vec_id", "x", "y", Staging(spark).put)
    return found.select("vec_id", "nearest", F.round("distance", 9).alias("distance"))


@query("""
SELECT a.c_custkey AS a, b.c_custkey AS b, round(b.c_acctbal - a.c_acctbal, 2) AS apart FROM customer a JOIN customer b
ON a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) < 0.5 AND a.c_nationkey = b.c_nationkey
""")
def pair_threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation whose balances differ by less than 0.5."""
    c = table(spark, sf_dir, "customer")
    nation = lambda side: c.select(F.col("c_custkey").alias(side), F.col("c_nationkey").alias(f"n_{side}"))
    pairs = band_pairs(c, "c_custkey", "c_acctbal", 0.5)
    same = pairs.join(nation("a"), "a").join(nation("b"), "b").where("n_a = n_b")
    return same.select("a", "b", F.round(F.col("value_b") - F.col("value_a"), 2).alias("apart"))


@query(f"""
WITH p AS ({_POINTS}), q AS (SELECT vec_id, label, 45 + x AS lat, 7 + y AS lon FROM p), m AS (SELECT label, avg(lat) AS la, avg(lon) AS lo FROM q GROUP BY label)
SELECT vec_id, round(sqrt(pow((lon - lo) * 111320 * cos(radians(la)), 2) + pow((lat - la) * 111320, 2)), 3) AS planar,
       round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))), 6) AS great_circle
FROM q JOIN m USING (label)
""")
def place_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from the middle of each group of places."""
    q = _points(spark, sf_dir).select("vec_id", "label", (F.col("x") + 45).alias("lat"), (F.col("y") + 7).alias("lon"))
    j = q.join(q.groupBy("label").agg(F.avg("lat").alias("la"), F.avg("lon").alias("lo")), "label")
    a = [F.col(c) for c in ("la", "lo", "lat", "lon")]
    return j.select("vec_id", F.round(planar_metres(*a), 3).alias("planar"), F.round(haversine_km(*a), 6).alias("great_circle"))


