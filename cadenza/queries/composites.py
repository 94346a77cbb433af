"""The report's own plans on the driver's tables: each user's events as a ride of one row a second.

A ride's speed, heading and place are made from event ids, its watts are the
events' values, and every 33rd row begins a lap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.scalars import lerp
from cadenza.operators import aggregates, islands
from cadenza.operators.resample import crop, marker_indices, too_short_or_long
from cadenza.operators.series import RIDE
from cadenza.plans import compare, laps, mean_lap, power, prepare, race_window, sectors, summary, surges, weather
from cadenza.plans.analyze import settings_of
from cadenza.plans.tables import CHANNELS
from cadenza.queries.registry import epoch, query, rounded, table
from cadenza.queries.series import USER, events
from cadenza.sources.weather import cache_key

LAP = 33
CONFIG = ModelConfig(exposed_at=1.0, sheltered_at=0.3, finale_laps=1, finale_seconds=20)

_SERIES = f"""
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS ride_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS watts, CAST(3 + event_id % 10 AS DOUBLE) AS v, value > 2 AS moving,
         radians(CAST(event_id % 360 AS DOUBLE)) AS heading, 45 + (event_id % 100) / 9973 AS lat, 7 + (event_id % 77) / 9967 AS lon, CASE WHEN event_type <> 'error' THEN value / 60 END AS ratio, 500 - value AS balance FROM events
), g AS (
  SELECT *, CAST(i AS DOUBLE) AS t, sum(v) OVER (PARTITION BY ride_id ORDER BY i) AS dist, count(*) OVER (PARTITION BY ride_id) AS n FROM e
), l AS (
  SELECT ride_id, i // {LAP} + 1 AS lap, i AS i0, i + {LAP} AS i1 FROM g WHERE i % {LAP} = 0 AND i + {LAP} < n
), s AS (
  SELECT g.*, lap, i0, i1 FROM g JOIN l ON g.ride_id = l.ride_id AND g.i BETWEEN i0 AND i1
)
"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = events(spark, sf_dir, "value", "event_type").select(
        F.col("user_id").cast("string").alias("ride_id"), USER.place.alias("i"), F.col("value").alias("watts"), (3 + k % 10).cast("double").alias("v"), (F.col("value") > 2).alias("moving"),
        F.radians((k % 360).cast("double")).alias("heading"), (45 + (k % 100) / 9973).alias("lat"), (7 + (k % 77) / 9967).alias("lon"),
        F.when(F.col("event_type") != "error", F.col("value") / 60).alias("ratio"), (500 - F.col("value")).alias("balance"),
    )
    return e.withColumns({"t": F.col("i").cast("double"), "dist": F.sum("v").over(RIDE.so_far), "solo": F.lit(60.0), "ftp": F.lit(50.0), "cp": F.lit(40.0), "w_prime": F.lit(500.0), "gap": F.lit(False), "alt": F.col("v") * 3, "theta": F.lit(0.0)})


def _laps(series: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).over(RIDE.whole)
    starts = series.select("ride_id", "i", n.alias("n")).where((F.col("i") % LAP == 0) & (F.col("i") + LAP < F.col("n")))
    return starts.select("ride_id", (F.floor(F.col("i") / LAP) + 1).alias("lap"), F.col("i").alias("i0"), (F.col("i") + LAP).alias("i1"), F.lit("device").alias("source"))


@query(_SERIES + "SELECT ride_id, lap, i0, i1, count(*) AS rows, min(dist) AS d0, max(dist) - min(dist) AS len FROM s GROUP BY ride_id, lap, i0, i1")
def lap_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds with the laps they belong to, and the laps' lengths."""
    series = _series(spark, sf_dir)
    samples = laps.lap_samples(series.select("ride_id", "i", "dist"), _laps(series))
    sizes = samples.groupBy("ride_id", "lap").agg(F.count(F.lit(1)).alias("rows"))
    return laps.lap_lengths(samples).drop("source").join(sizes, ["ride_id", "lap"])


@query(_SERIES + """, m AS (
  SELECT *, avg(watts) OVER w AS m, row_number() OVER w AS k FROM s WHERE moving WINDOW w AS (PARTITION BY ride_id, lap ORDER BY i ROWS 29 PRECEDING)
), a AS (
  SELECT ride_id, lap, coalesce(pow(avg(pow(m, 4)) FILTER (WHERE k >= 30), 0.25), avg(watts)) AS np, avg(watts) AS mean, count(*) AS seconds, max(v) AS top, sum(greatest(60 - watts, 0)) / 1000 AS saved,
         100.0 * count(*) FILTER (WHERE ratio >= 1) / nullif(count(ratio), 0) AS exposed, 100.0 * count(*) FILTER (WHERE ratio <= 0.3) / nullif(count(ratio), 0) AS sheltered, quantile_cont(ratio, 0.5) AS median FROM m GROUP BY ride_id, lap
), d AS (
  SELECT ride_id, lap, max(dist) - min(dist) AS distance, arg_max(balance, i) / 1000 AS wbal FROM s GROUP BY ride_id, lap
)
SELECT ride_id, lap, seconds, distance, round(mean, 6) AS avg, round(np, 6) AS np, round(np / mean, 6) AS vi, round(mean * seconds / 1000, 6) AS kj, top AS max_speed, round(distance / seconds, 6) AS avg_speed,
       round(exposed, 6) AS exposed, round(sheltered, 6) AS sheltered, round(median, 6) AS median, round(saved, 6) AS saved_kj, round(wbal, 6) AS wbal_end FROM a JOIN d USING (ride_id, lap)
""")
def lap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a lap: load, exposure, speeds, and the reserve at its end."""
    series = _series(spark, sf_dir)
    found = summary.summarise_laps(series, _laps(series), CONFIG)
    return found.select("ride_id", "lap", "seconds", "distance", "max_speed", *rounded("avg", "np", "vi", "kj", "avg_speed", "exposed", "sheltered", "median", "saved_kj", "wbal_end"))


@query(_SERIES + """, k AS (
  SELECT ride_id, i AS mark, dist FROM g WHERE i = 0 OR i = n - 1 OR (i % 11 = 0) OR (i % 25 = 0)
), p AS (
  SELECT ride_id, mark AS i0, lead(mark) OVER w AS i1, lead(dist) OVER w - dist AS len FROM k WINDOW w AS (PARTITION BY ride_id ORDER BY mark)
), q AS (
  SELECT *, quantile_cont(len, 0.5) OVER (PARTITION BY ride_id) AS mid, count(*) OVER (PARTITION BY ride_id) AS c FROM p WHERE i1 - i0 > 2
), r AS (
  SELECT *, sqrt(avg(pow(len - mid, 2)) OVER (PARTITION BY ride_id)) / mid AS cv FROM q
)
SELECT ride_id, row_number() OVER (PARTITION BY ride_id ORDER BY i0) AS lap, i0, i1 FROM r WHERE c >= 3 AND mid > 30 AND cv <= 0.5 AND len > 0.75 * mid AND len < 1.35 * mid
""")
def marker_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps between markers, where these describe a circuit."""
    g = _series(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(RIDE.whole))
    i = F.col("i")
    marks = g.where((i == 0) | (i == F.col("n") - 1) | (i % 11 == 0) | (i % 25 == 0)).groupBy("ride_id").agg(F.array_sort(F.collect_list("i")).alias("marks"))
    return laps.marker_laps(marks, g, seconds=2, metres=30.0, scatter=0.5).select("ride_id", "lap", "i0", "i1")


@query(_SERIES + "SELECT ride_id, round(avg(lat), 7) AS lat, round(avg(lon), 7) AS lon, max(n) AS lap_len FROM g GROUP BY ride_id")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle and length of each line."""
    line = _series(spark, sf_dir).withColumn("lap_len", F.count(F.lit(1)).over(RIDE.whole))
    return mean_lap.fingerprint(line).select("ride_id", *rounded("lat", "lon", digits=7), "lap_len")


@query(_SERIES + """, b AS (
  SELECT ride_id, CAST(floor(degrees(heading) / 22.5 + 0.5) AS INT) % 16 AS bin, count(*) AS seconds, quantile_cont(ratio, 0.5) AS ratio, quantile_cont(ratio, 0.85) AS p85 FROM g WHERE moving AND ratio IS NOT NULL GROUP BY ALL
), r AS (
  SELECT DISTINCT ride_id FROM g WHERE moving AND ratio IS NOT NULL
)
SELECT r.ride_id, CAST(k AS INT) AS bin, CAST(k * 22.5 AS DOUBLE) AS dir, coalesce(seconds, 0) AS seconds, round(ratio, 6) AS ratio, round(p85, 6) AS p85 FROM r CROSS JOIN range(0, 16) x(k) LEFT JOIN b ON b.ride_id = r.ride_id AND b.bin = k
""")
def heading_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen bearings of each ride, ridden or not."""
    return summary.exposure_by_heading(_series(spark, sf_dir)).select("ride_id", "bin", "dir", "seconds", *rounded("ratio", "p85"))


@query(_SERIES + """, a AS (
  SELECT ride_id, avg(watts) AS np, CAST(count(*) FILTER (WHERE balance <= 300) AS DOUBLE) AS empty, count(*) AS moving, sum(greatest(watts - 40, 0)) AS over FROM g GROUP BY ride_id
)
SELECT ride_id, NOT (np > 50) AND NOT (empty / moving > 0.1 * 5) AS ok, np > 50 AS impossible, empty / moving > 0.5 AS pinned, round(empty / moving, 6) AS empty_frac, CASE WHEN np > 50 OR empty / moving > 0.5 THEN CAST(floor(np * 1.02 + 0.5) AS BIGINT) END AS suggested_cp FROM a WHERE np > 0
""")
def fitness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether critical power and reserve can be right."""
    rides = _series(spark, sf_dir).groupBy("ride_id").agg(F.avg("watts").alias("np"), F.sum(F.when(F.col("balance") <= 300, 1.0).otherwise(0.0)).alias("wbal_empty_seconds"), F.count(F.lit(1)).alias("moving_seconds"), F.sum(F.greatest(F.col("watts") - 40, F.lit(0.0))).alias("wbal_overdraft"))
    settings = rides.select("ride_id", F.lit(50.0).alias("cp"), F.lit(500.0).alias("w_prime"))
    return summary.check_fitness(rides, settings).select("ride_id", "ok", "impossible", "pinned", *rounded("empty_frac"), F.col("suggested_cp").cast("long").alias("suggested_cp"))


@query(_SERIES + """, w AS (
  SELECT *, avg(watts) OVER (PARTITION BY ride_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) > 40 * CAST(1.4 AS DOUBLE) AS high FROM g
), h AS (
  SELECT *, i - row_number() OVER (PARTITION BY ride_id ORDER BY i) AS run FROM w WHERE high
), r AS (
  SELECT ride_id, min(i) FILTER (WHERE moving) AS i0, max(i) AS i1 FROM h GROUP BY ride_id, run HAVING max(i) - min(i) FILTER (WHERE moving) + 1 >= 2
), c AS (
  SELECT *, CASE WHEN i0 - lag(i1) OVER (PARTITION BY ride_id ORDER BY i0) > 3 THEN 1 ELSE 0 END AS apart FROM r
), m AS (
  SELECT ride_id, min(i0) AS i0, max(i1) AS i1 FROM (SELECT *, sum(apart) OVER (PARTITION BY ride_id ORDER BY i0) AS part FROM c) GROUP BY ride_id, part
), j AS (
  SELECT m.i0, m.i1, g.* FROM m JOIN g ON g.ride_id = m.ride_id AND g.i BETWEEN greatest(m.i0 - 10, 0) AND m.i1
), x AS (
  SELECT ride_id, i0, i1, CAST(count(*) FILTER (WHERE i >= i0) AS DOUBLE) AS seconds, avg(watts) FILTER (WHERE i >= i0) AS avg, max(watts) FILTER (WHERE i >= i0) AS peak, sum(greatest(watts - 40, 0)) FILTER (WHERE i >= i0) / 1000 AS kj,
         avg(ratio) FILTER (WHERE i <= i0) AS before, (max(balance) FILTER (WHERE i = i0) - max(balance) FILTER (WHERE i = i1)) / 1000 AS fall FROM j GROUP BY ride_id, i0, i1
), f AS (
  SELECT * FROM x WHERE kj >= 0.1
), p AS (
  SELECT f.ride_id, f.i0, min(lap) AS lap FROM f JOIN l ON l.ride_id = f.ride_id AND f.i0 BETWEEN l.i0 AND l.i1 GROUP BY f.ride_id, f.i0
)
SELECT f.ride_id, row_number() OVER (PARTITION BY f.ride_id ORDER BY f.i0) AS idx, f.i0, f.i1, seconds, round(avg, 6) AS avg, round(peak, 6) AS peak, round(kj, 6) AS match_kj, round(fall, 6) AS wbal_drop, coalesce(before < 0.88, FALSE) AS from_shelter, lap, f.i0 % 20 = 7 AS corner_exit
FROM f LEFT JOIN p ON p.ride_id = f.ride_id AND p.i0 = f.i0
""")
def surge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Efforts above 1.4 times a threshold, where they began and what they cost."""
    series = _series(spark, sf_dir)
    config = ModelConfig(min_surge_seconds=2, min_match_kj=0.1)
    turns = spark.createDataFrame([], "ride_id string, name string, lat double, lon double")
    # apexes that only efforts from rows 7, 27, 47, … follow at once
    exits = series.where("i % 20 = 7").select("ride_id", F.col("i").alias("i0"), F.lit(True).alias("apex"))
    found = surges.detect_surges(series, _laps(series), turns, spark.createDataFrame([], "ride_id string, apex long"), config).drop("corner_exit")
    marked = found.join(exits, ["ride_id", "i0"], "left").withColumn("corner_exit", F.coalesce("apex", F.lit(False)))
    return marked.select("ride_id", "idx", "i0", "i1", "seconds", *rounded("avg", "peak", "match_kj", "wbal_drop"), "from_shelter", "lap", "corner_exit")


@query(_SERIES + """, b AS (
  SELECT ride_id, row_number() OVER (PARTITION BY ride_id ORDER BY lap DESC) AS back, i0, count(*) OVER (PARTITION BY ride_id) AS laps FROM l
), f AS (
  SELECT g.ride_id, CASE WHEN max(laps) >= 2 THEN max(b.i0) FILTER (WHERE back = 1) ELSE greatest(max(i) - 20, 0) END AS i0, CASE WHEN max(laps) >= 2 THEN 'last 1 laps' ELSE 'last 5 min' END AS basis FROM g LEFT JOIN b ON b.ride_id = g.ride_id GROUP BY g.ride_id
)
SELECT f.ride_id, f.i0, basis, CAST(count(*) FILTER (WHERE moving) AS DOUBLE) AS seconds, round(avg(watts) FILTER (WHERE moving), 9) AS avg,
       round(100.0 * count(*) FILTER (WHERE moving AND ratio >= 1) / nullif(count(*) FILTER (WHERE moving AND ratio IS NOT NULL), 0), 6) AS exposed, round(arg_min(balance, i) / 1000, 6) AS wbal_at_start, round(arg_min(balance, i) / 5, 6) AS wbal_at_start_pct
FROM g JOIN f ON f.ride_id = g.ride_id AND g.i >= f.i0 GROUP BY f.ride_id, f.i0, basis
""")
def finale_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the last lap on, or the last twenty seconds."""
    series = _series(spark, sf_dir)
    none = spark.createDataFrame([], "ride_id string, i0 long, corner_exit boolean, match_kj double")
    return summary.summarise_finale(series, _laps(series), none, CONFIG).select("ride_id", "i0", "basis", "seconds", F.round("avg", 9).alias("avg"), *rounded("exposed", "wbal_at_start", "wbal_at_start_pct"))


@query(_SERIES + """, u AS (
  SELECT *, v * 3 AS alt, greatest(v * 3 - lag(v * 3) OVER (PARTITION BY ride_id ORDER BY i), 0) AS up FROM g
), x AS (
  SELECT l.*, b.v * 3 - a.v * 3 AS net, a.v * 3 AS low, b.v * 3 AS high FROM l JOIN g a ON a.ride_id = l.ride_id AND a.i = i0 JOIN g b ON b.ride_id = l.ride_id AND b.i = i1
), d AS (
  SELECT ride_id, quantile_cont(net, 0.5) AS net, (arg_max(high, lap) - arg_min(low, lap)) / count(*) AS drift, min(i0) AS a, max(i1) AS b, count(*) AS k FROM x GROUP BY ride_id
), c AS (
  SELECT u.ride_id, sum(up) / any_value(k) AS gain FROM u JOIN d ON d.ride_id = u.ride_id AND i > a AND i <= b GROUP BY u.ride_id
)
SELECT r.ride_id, round(net, 6) AS net_per_lap, round(drift, 6) AS drift, round(gain, 6) AS gain_per_lap, coalesce(abs(drift) <= 1.5, TRUE) AS trustworthy FROM (SELECT DISTINCT ride_id FROM g) r LEFT JOIN d USING (ride_id) LEFT JOIN c USING (ride_id)
""")
def elevation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each ride's altitude nets, drifts and climbs a lap."""
    series = _series(spark, sf_dir)
    e = summary.elevation(series, _laps(series)).select("ride_id", "elevation.*")
    return e.select("ride_id", *rounded("net_per_lap", "drift", "gain_per_lap"), "trustworthy")


@query("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS ride_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS watts, 5 + value % 7 AS v, radians(CAST(event_id % 360 AS DOUBLE)) AS h FROM events),
a AS (SELECT *, v - (2 * sin(h) - cos(h)) AS along, 2 * cos(h) + sin(h) AS side FROM e),
p AS (SELECT *, (78 * 9.80665 * 0.004 + 0.5 * CAST(1.2 AS DOUBLE) * 0.32 * (1 + 0.15 * side * side / (along * along + side * side)) * sqrt(along * along + side * side) * along) * v / 0.976 AS solo FROM a),
s AS (SELECT ride_id, i, solo, avg(watts) OVER w AS ws, avg(solo) OVER w AS ss, atan2(side, along) AS yaw FROM p WINDOW w AS (PARTITION BY ride_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))
SELECT ride_id, i, round(solo, 5) AS solo_raw, round(CASE WHEN ss > 50 THEN ws / ss END, 6) AS ratio, round(yaw, 6) AS yaw FROM s
""")
def draft_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power a lone rider would have needed each second, and the smoothed share of it that was given."""
    k = F.col("event_id")
    grid = events(spark, sf_dir, "value").select(F.col("user_id").cast("string").alias("ride_id"), USER.place.alias("i"), F.col("value").alias("watts"), (5 + F.col("value") % 7).alias("v"), F.radians((k % 360).cast("double")).alias("heading"))
    zero = F.lit(0.0)
    grid = grid.withColumns({"theta": zero, "accel": zero, "we": F.lit(None).cast("double"), "wn": F.lit(None).cast("double"), "mass": F.lit(78.0), "rho": F.lit(1.2), "cp": F.lit(40.0), "w_prime": F.lit(500.0)})
    wind = grid.select("ride_id").distinct().select("ride_id", F.lit(2.0).alias("we"), F.lit(-1.0).alias("wn"), F.lit(0.32).alias("cda"))
    return power.ride_series(grid, wind, ModelConfig()).select("ride_id", "i", F.round("solo_raw", 5).alias("solo_raw"), *rounded("ratio", "yaw"))


@query("""
WITH t AS (SELECT user_id, event_id, epoch(ts) AS t, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id) AS since FROM events), c AS (SELECT *, since BETWEEN 86400 AND 864000 AS inside FROM t), n AS (SELECT *, count(*) FILTER (WHERE inside) OVER (PARTITION BY user_id) AS k FROM c)
SELECT user_id, event_id FROM n WHERE inside OR k < 25
""")
def series_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from a day to ten days after a user's first, or all where these are fewer than 25."""
    df = events(spark, sf_dir).withColumn("t", epoch("ts"))
    return crop(df, ("user_id",), "t", F.lit(86_400.0), F.lit(864_000.0), 25).select("user_id", "event_id")


@query("""
WITH s AS (SELECT user_id, count(*) AS n, floor(max(epoch(ts)) - min(epoch(ts))) + 1 AS grid FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN n < 60 THEN 'too few samples' WHEN grid < 60 THEN 'too short' ELSE 'too long' END AS reason FROM s WHERE n < 60 OR grid < 60 OR grid > 2500000
""")
def series_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of too few rows, or too short or long."""
    return too_short_or_long(events(spark, sf_dir).withColumn("t", epoch("ts")), ("user_id",), "t", 60, 2_500_000)


@query("""
WITH m AS (SELECT o_custkey, list(o_totalprice / 100) AS times, count(*) * 100 AS n FROM orders GROUP BY o_custkey),
k AS (SELECT o_custkey, n, list_sort(list_distinct(list_concat([CAST(0 AS BIGINT), CAST(n - 1 AS BIGINT)], list_filter(list_transform(times, lambda x: CAST(floor(x - 50 + 0.5) AS BIGINT)), lambda i: i > 0 AND i < n)))) AS marks FROM m)
SELECT o_custkey, CASE WHEN len(marks) >= 4 THEN array_to_string(marks, ',') END AS marks FROM k
""")
def lap_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct indices of markers within a series, both ends included."""
    m = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_totalprice") / 100).alias("times"), (F.count(F.lit(1)) * 100).alias("n"))
    return m.select("o_custkey", F.array_join(marker_indices(F.col("times"), F.lit(50.0), F.col("n")), ",").alias("marks"))


_CIRCUITS = "SELECT CAST(c_custkey AS VARCHAR) AS ride_id, 45.49 + (c_custkey * 7919 % 1000) / 50000 AS lat, 7 + (c_custkey * 104729 % 1000) / 50000 AS lon, CAST(1000 + c_nationkey * 40 AS DOUBLE) AS lap_len FROM customer"


def _circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("ride_id"), (45.49 + (k * 7919 % 1000) / 50000).alias("lat"), (7 + (k * 104729 % 1000) / 50000).alias("lon"), (1000 + F.col("c_nationkey") * 40).cast("double").alias("lap_len"))


#: Customers as circuits in three hundred towns, up to 220 m and 16 % of their length apart within one.
_TOWNS = """SELECT CAST(c_custkey AS VARCHAR) AS ride_id, 45 + (c_custkey * 7919 % 300) / 10 + (c_custkey * 31 % 100) / 50000 AS lat, 7 + (c_custkey * 104729 % 10) / 10 + (c_custkey * 17 % 100) / 50000 AS lon,
  CAST(1000 + c_nationkey % 5 * 40 AS DOUBLE) AS lap_len FROM customer"""


@query(f"""
WITH RECURSIVE c AS (
  SELECT *, row_number() OVER (ORDER BY ride_id) AS k FROM ({_TOWNS})
), f AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS ride_id, CAST('' AS VARCHAR) AS circuit_id, CAST([] AS STRUCT(id VARCHAR, lat DOUBLE, lon DOUBLE, len DOUBLE)[]) AS led
  UNION ALL
  SELECT k, ride_id, coalesce(found, ride_id), CASE WHEN found IS NULL THEN list_append(led, struct_pack(id := ride_id, lat := lat, lon := lon, len := lap_len)) ELSE led END FROM (
    SELECT c.k, c.ride_id, c.lat, c.lon, c.lap_len, f.led, list_filter(f.led, lambda l: sqrt(pow((c.lon - l.lon) * 111320 * cos(radians(l.lat)), 2) + pow((c.lat - l.lat) * 111320, 2)) < 250 AND abs(c.lap_len - l.len) / greatest(c.lap_len, l.len) < 0.12)[1].id AS found
    FROM f JOIN c ON c.k = f.k + 1)
)
SELECT ride_id, circuit_id, count(*) OVER (PARTITION BY circuit_id) AS races FROM f WHERE k > 0
""")
def circuit_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in groups, each led by the first of it."""
    k = F.col("c_custkey")
    lat, lon = 45 + (k * 7919 % 300) / 10 + (k * 31 % 100) / 50000, 7 + (k * 104729 % 10) / 10 + (k * 17 % 100) / 50000
    towns = table(spark, sf_dir, "customer").select(k.cast("string").alias("ride_id"), lat.alias("lat"), lon.alias("lon"), (1000 + F.col("c_nationkey") % 5 * 40).cast("double").alias("lap_len"))
    return compare.circuit_groups(towns).select("ride_id", "circuit_id", "races")


@query(f"""
WITH r AS (SELECT DISTINCT * FROM ({_CIRCUITS}) WHERE ride_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND lap_len IS NOT NULL),
c AS (SELECT lat, lon, lap_len, min(ride_id) AS first, max(ride_id) AS last FROM r GROUP BY lat, lon, lap_len), p AS (
  SELECT a.first AS a, b.first AS b, sqrt(pow((b.lon - a.lon) * 111320 * cos(radians(a.lat)), 2) + pow((b.lat - a.lat) * 111320, 2)) AS apart, abs(a.lap_len - b.lap_len) / greatest(a.lap_len, b.lap_len) AS ratio
  FROM c a JOIN c b ON a.first < b.last AND abs(a.lat - b.lat) < 0.01 AND (a.lat, a.lon, a.lap_len) <> (b.lat, b.lon, b.lap_len)
)
SELECT a, b, round(apart, 4) AS apart, round(ratio, 9) AS length_ratio, false AS copy FROM p WHERE apart < 250 AND ratio < 0.12
UNION ALL SELECT first, ride_id, 0, 0, true FROM r JOIN c USING (lat, lon, lap_len) WHERE ride_id > first
""")
def same_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of places less than 250 m apart whose lengths differ by less than 12 %: of equal ones the first stands for all, beside a row for each of the others."""
    return compare.same_circuit_classes(_circuits(spark, sf_dir)).select("a", "b", F.round("apart", 4).alias("apart"), F.round("length_ratio", 9).alias("length_ratio"), "copy")


_WEATHER = """
WITH h AS (SELECT event_type AS site, CAST(epoch(date_trunc('hour', ts)) AS DOUBLE) AS time, avg(value) AS speed, CAST(sum(event_id) % 360 AS DOUBLE) AS dir, avg(value) / 3 AS temp, max(value) AS gust FROM events GROUP BY 1, 2),
w AS (SELECT *, -speed * sin(radians(dir)) AS e, -speed * cos(radians(dir)) AS n FROM h),
s AS (SELECT *, lead(time) OVER o AS next_time, lead(e) OVER o AS next_e, lead(n) OVER o AS next_n, lead(temp) OVER o AS next_temp, lead(gust) OVER o AS next_gust FROM w WINDOW o AS (PARTITION BY site ORDER BY time))
"""
_AT = """SELECT m.*, e + (coalesce(next_e, e) - e) * f AS we, n + (coalesce(next_n, n) - n) * f AS wn, temp + (coalesce(next_temp, temp) - temp) * f AS wtemp, gust + (coalesce(next_gust, gust) - gust) * f AS wgust
FROM (SELECT m.*, s.*, least(greatest(coalesce((m.at - s.time) / (next_time - s.time), 0), 0), 1) AS f FROM m ASOF JOIN s ON m.place = s.site AND m.at >= s.time) m"""


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("time", F.floor(epoch("ts") / 3600).cast("double") * 3600)
    h = e.groupBy(F.col("event_type").alias("site"), "time").agg(F.avg("value").alias("wind_speed"), (F.sum("event_id") % 360).cast("double").alias("wind_dir"), (F.avg("value") / 3).alias("temp"), F.max("value").alias("wind_gust"))
    return h.withColumns({c: F.lit(None).cast("double") for c in ("humidity", "pressure", "precip", "cloud")})


@query(_WEATHER + ", m AS (SELECT event_id, event_type AS place, epoch(ts) AS at FROM events), v AS (" + _AT + ") SELECT event_id, round(we, 6) AS e, round(wn, 6) AS n, round(wtemp, 6) AS temp FROM v")
def weather_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weather of a site at each event, winds interpolated as vectors."""
    times = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("site"), epoch("ts").alias("at"))
    found = weather.at_times(times, _weather(spark, sf_dir), "at")
    return found.select("event_id", *(F.round(f"wx_{c}", 6).alias(c) for c in ("e", "n", "temp")))


@query(_WEATHER + """, r AS (SELECT user_id, event_type AS place, min(epoch(ts)) AS a, max(epoch(ts)) AS b FROM events GROUP BY 1, 2),
k AS (SELECT *, greatest(60, (b - a) / 12) AS step FROM r), m AS (SELECT user_id, place, a + x * step AS at FROM (SELECT *, unnest(range(0, CAST(floor((b - a) / step + 1e-9) AS BIGINT) + 1)) AS x FROM k)), v AS (""" + _AT + """)
SELECT user_id || place AS ride_id, round(sqrt(pow(avg(we), 2) + pow(avg(wn), 2)), 6) AS wind_speed, round(max(wgust), 6) AS wind_gust, round(avg(wtemp), 6) AS temp FROM v GROUP BY user_id, place
""")
def weather_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean weather of spans of time from thirteen moments."""
    e = table(spark, sf_dir, "events").withColumn("t", epoch("ts"))
    spans = e.groupBy(F.concat(F.col("user_id").cast("string"), F.col("event_type")).alias("ride_id"), F.col("event_type").alias("site")).agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"))
    return weather.conditions(spans, _weather(spark, sf_dir)).select("ride_id", *rounded("wind_speed", "wind_gust", "temp"))


@query("""
WITH g AS (SELECT o_custkey, avg(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 9973 END) AS temp, count(CASE WHEN o_orderkey % 3 > 0 THEN 1 END) AS k, count(*) AS n, avg(o_totalprice / 100) AS alt FROM orders GROUP BY o_custkey),
d AS (SELECT o_custkey, CASE WHEN k > 0.5 * n THEN temp ELSE 20 END AS c, 101325 * pow(1 - 2.25577e-5 * alt, 5.25588) AS p FROM g)
SELECT CAST(o_custkey AS VARCHAR) AS ride_id, round(c, 6) AS temp_c, round(p, 4) AS pressure_pa, round(p / (287.058 * (c + 273.15)), 8) AS rho FROM d
""")
def density_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Air density of each ride without weather: the device's temperature where most rows have one, pressure by altitude."""
    grid = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ride_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") / 9973).alias("temp"), (F.col("o_totalprice") / 100).alias("alt"))
    found = weather.ride_density(grid, grid.select("ride_id").distinct(), None, ModelConfig())
    return found.select("ride_id", *rounded("temp_c"), F.round("pressure_pa", 4).alias("pressure_pa"), F.round("rho", 8).alias("rho"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS ride_id, CASE WHEN c_acctbal <> 0 THEN c_acctbal ELSE 250 END AS ftp, CASE WHEN c_nationkey % 4 <> 0 THEN CAST(c_nationkey % 4 AS DOUBLE) ELSE 250 END AS cp, CAST(20000 AS DOUBLE) AS w_prime, CAST(81 AS DOUBLE) AS mass, c_custkey / 1000 AS rho FROM customer
""")
def settings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of rides: what is set for this run, then the file's own, then the defaults."""
    c = table(spark, sf_dir, "customer")
    nothing = F.lit(None).cast("double")
    rides = c.select(F.col("c_custkey").cast("string").alias("ride_id"), F.col("c_acctbal").alias("ftp"), (F.col("c_nationkey") % 4).cast("double").alias("cp"), nothing.alias("w_prime"))
    density = c.select(F.col("c_custkey").cast("string").alias("ride_id"), (F.col("c_custkey") / 1000).alias("rho"))
    return settings_of(rides, density, ModelConfig(), {"mass": F.lit(81.0)})


@query("""
WITH w AS (SELECT CAST(o_orderkey AS VARCHAR) AS ride_id, o_orderstatus <> 'P' AS found, CAST(o_totalprice % 50 AS BIGINT) AS a, CAST(o_totalprice % 31 AS BIGINT) AS b, CAST(o_totalprice % 83 AS BIGINT) AS c, CAST(o_totalprice % 17 AS BIGINT) AS d FROM orders)
SELECT ride_id, found AND a + b + c + d > 60 AS offer, found AND c + d > 60 AS auto_tail FROM w
""")
def trimming_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what lies outside a race is worth cutting off."""
    part = lambda n: F.rint(F.col("o_totalprice") % n).cast("long")
    w = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("ride_id"), (F.col("o_orderstatus") != "P").alias("found"), part(50).alias("approach_seconds"), part(31).alias("warmup_seconds"), part(83).alias("cooldown_seconds"), part(17).alias("home_seconds"), F.lit(60).alias("min_worth_trimming"))
    return race_window.worth_trimming(w)


@query("""
WITH n AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), f AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS grp FROM n WHERE value > 30)
SELECT user_id, min(i) AS i0, max(i) AS i1, count(*) AS size, round(sum(value), 6) AS total FROM f GROUP BY user_id, grp HAVING count(*) >= 2
""")
def value_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more neighbouring large values."""
    from cadenza.queries.series import PLACE, numbered

    return islands.runs(numbered(spark, sf_dir, "value"), PLACE, F.col("value") > 30, F.round(F.sum("value"), 6).alias("total"), least=2).drop("run")


@query("""
SELECT c_nationkey, round(coalesce(avg(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END), 0), 6) AS mean, round(avg(coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END + (2 * c_acctbal - CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END) * 0.25, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END, 2 * c_acctbal)), 6) AS quarter FROM customer GROUP BY c_nationkey
""")
def means_and_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means that are 0 of nothing, and values a quarter of the way to others."""
    c = table(spark, sf_dir, "customer")
    some = F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal"))
    between = lerp(F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")), 2 * F.col("c_acctbal"), F.lit(0.25))
    return c.groupBy("c_nationkey").agg(F.round(aggregates.mean_or_zero(some), 6).alias("mean"), F.round(F.avg(between), 6).alias("quarter"))


@query("""
SELECT c_custkey, printf('%.2f_%.2f_', c_acctbal / 99.7, c_acctbal / 49.9) || strftime(make_timestamp(CAST((c_custkey * 86400 * 3 - 3600) * 1000000 AS BIGINT)), '%Y-%m-%d') || '_' || strftime(make_timestamp(CAST((c_custkey * 86400 * 3 + 7200) * 1000000 AS BIGINT)), '%Y-%m-%d') AS key FROM customer
""")
def weather_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of cached answers: rounded places and the days that an hour around a ride touches."""
    k = F.col("c_custkey") * 86_400 * 3
    return table(spark, sf_dir, "customer").select("c_custkey", cache_key(F.col("c_acctbal") / 99.7, F.col("c_acctbal") / 49.9, k, k + 3600).alias("key"))


@query("""
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS ride_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, value % 17 - 1 AS v, CASE WHEN event_type <> 'error' THEN value END AS w FROM events
), s AS (
  SELECT *, k + 10 * (k // 20) AS t FROM e
), n AS (
  SELECT *, lead(t) OVER o AS t1, lead(v) OVER o AS v1, lead(w) OVER o AS w1, lead(t, 2) OVER o IS NULL AS final, count(*) OVER (PARTITION BY ride_id) AS c FROM s WINDOW o AS (PARTITION BY ride_id ORDER BY t)
), p AS (
  SELECT *, unnest(range(t, CASE WHEN final THEN t1 + 1 ELSE t1 END)) AS i FROM n WHERE t1 IS NOT NULL AND c >= 10
), q AS (
  SELECT ride_id, i, t1 - t > 3 AS gap, v + (v1 - v) * (i - t) / (t1 - t) AS v, CASE WHEN t1 - t > 3 THEN 0 ELSE coalesce(w + (w1 - w) * (i - t) / (t1 - t), w, w1) END AS w FROM p
), r AS (
  SELECT ride_id, i, gap, CASE WHEN gap THEN 0 ELSE greatest(v, 0) END AS v, coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY ride_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS w FROM q
), m AS (
  SELECT *, sum(CASE WHEN i > 0 THEN v ELSE 0 END) OVER (PARTITION BY ride_id ORDER BY i) AS dist, avg(v) OVER (PARTITION BY ride_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM r
), a AS (
  SELECT *, (coalesce(lead(sm) OVER o, sm) - coalesce(lag(sm) OVER o, sm)) / (coalesce(lead(i) OVER o, i) - coalesce(lag(i) OVER o, i)) AS accel FROM m WINDOW o AS (PARTITION BY ride_id ORDER BY i)
)
SELECT ride_id, i, gap, v > 2.5 AND NOT gap AS moving, round(v, 6) AS v, round(w, 6) AS watts, round(dist, 6) AS dist, round(CASE WHEN abs(accel) > 6 THEN 0 ELSE accel END, 6) AS accel FROM a
""")
def prepared_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From samples with a hole after every twentieth to the grid of seconds: what is held, what is 0 in holes, distance from speed, acceleration."""
    e = events(spark, sf_dir, "value", "event_type").withColumn("k", USER.place)
    nothing = {c: F.lit(None).cast("double") for c in ("lat", "lon", "hr", "cad", "dist", "temp")}
    given = {"ride_id": F.col("user_id").cast("string"), "seq": F.col("k"), "t": (F.col("k") + 10 * F.floor(F.col("k") / 20)).cast("double"), "v": F.col("value") % 17 - 1, "watts": F.when(F.col("event_type") != "error", F.col("value")), "alt": F.lit(80.0), **nothing}
    samples = e.withColumns(given).select("ride_id", "seq", "t", *CHANNELS)
    rides = samples.select("ride_id").distinct().withColumns({c: F.lit(None).cast("double") for c in ("crop_start", "crop_end")})
    return prepare.prepare(samples, rides).select("ride_id", "i", "gap", "moving", *rounded("v", "watts", "dist", "accel"))


@query(_SERIES + """, z AS (
  SELECT ride_id, lap, min(dist) AS d0, max(dist) - min(dist) AS len FROM s GROUP BY ride_id, lap
), t AS (
  SELECT ride_id, quantile_cont(len, 0.5) AS lap_len FROM z GROUP BY ride_id HAVING count(*) >= 2
), c AS (
  SELECT s.ride_id, s.lap, least(CAST(floor(least(greatest((dist - d0) / lap_len, 0), 1) * 8) AS BIGINT), 7) AS sector, ratio, watts FROM s JOIN z ON z.ride_id = s.ride_id AND z.lap = s.lap JOIN t ON t.ride_id = s.ride_id WHERE moving
), f AS (
  SELECT ride_id, lap, sector, avg(ratio) AS ratio, avg(watts) AS watts, count(*) AS seconds FROM c GROUP BY ALL
), a AS (
  SELECT z.ride_id, z.lap, k AS sector, ratio, watts, coalesce(seconds, 0) AS seconds FROM z JOIN t ON t.ride_id = z.ride_id CROSS JOIN range(0, 8) x(k) LEFT JOIN f ON f.ride_id = z.ride_id AND f.lap = z.lap AND f.sector = k
), j AS (
  SELECT *, row_number() OVER (PARTITION BY ride_id, lap ORDER BY ratio DESC NULLS LAST, sector) = 1 AND ratio IS NOT NULL AS worst, list_sort(list(ratio) FILTER (WHERE ratio IS NOT NULL) OVER (PARTITION BY ride_id, lap)) AS every FROM a
)
SELECT ride_id, lap, sector, seconds, round(ratio, 6) AS ratio, round(watts, 6) AS watts, coalesce(ratio > every[len(every) // 2 + 1] + 0.02, FALSE) AS worse, worst FROM j
""")
def sector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps cut into eight equal sectors, each against the rest of its lap."""
    series = _series(spark, sf_dir)
    none = spark.createDataFrame([], "ride_id string, lap_offset double, number int")
    cells, _ = sectors.build_sectors(series, _laps(series), none, ModelConfig(sector_count=8))
    return cells.select("ride_id", "lap", "sector", "seconds", *rounded("ratio", "watts"), "worse", "worst")


@query("""
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS ride_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS watts, CAST(5 + event_id % 10 AS DOUBLE) AS v,
         45 + (event_id % 100) / 9973 AS lat, 7 + (event_id % 77) / 9967 AS lon FROM events
), g AS (
  SELECT *, sum(v) OVER (PARTITION BY ride_id ORDER BY i) AS dist, count(*) OVER (PARTITION BY ride_id) AS rows FROM e
), s AS (
  SELECT g.*, l.i // 20 + 1 AS lap, l.i AS i0 FROM g JOIN g l ON g.ride_id = l.ride_id AND l.i % 20 = 0 AND l.i + 20 < l.rows AND g.i BETWEEN l.i AND l.i + 20
), z AS (
  SELECT ride_id, lap, min(dist) AS d0, max(dist) - min(dist) AS len FROM s GROUP BY ride_id, lap
), t AS (
  SELECT ride_id, quantile_cont(len, 0.5) AS lap_len, greatest(48, least(4000, CAST(floor(quantile_cont(len, 0.5) / 2 + 0.5) AS BIGINT))) AS n FROM z GROUP BY ride_id HAVING count(*) >= 3 AND quantile_cont(len, 0.5) > 150
), p AS (
  SELECT s.*, n, (dist - d0) / len * n AS pos FROM s JOIN z ON z.ride_id = s.ride_id AND z.lap = s.lap JOIN t ON t.ride_id = s.ride_id
), q AS (
  SELECT *, lead(pos) OVER w AS pos1, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, lead(v) OVER w AS v1, lead(watts) OVER w AS watts1 FROM p WINDOW w AS (PARTITION BY ride_id, lap ORDER BY i)
), x AS (
  SELECT *, unnest(range(CASE WHEN i = i0 THEN 0 ELSE CAST(floor(pos) AS BIGINT) + 1 END, least(CAST(floor(pos1) AS BIGINT), n - 1) + 1)) AS j FROM q WHERE pos1 IS NOT NULL
), y AS (
  SELECT ride_id, j, quantile_cont(lat + (lat1 - lat) * f, 0.5) AS lat, quantile_cont(lon + (lon1 - lon) * f, 0.5) AS lon, quantile_cont(v + (v1 - v) * f, 0.5) AS v, quantile_cont(watts + (watts1 - watts) * f, 0.5) AS watts, count(*) AS passes
  FROM (SELECT *, (j - pos) / (pos1 - pos) AS f FROM x) GROUP BY ride_id, j
), o AS (
  SELECT y.*, n, lap_len, min(passes) OVER (PARTITION BY y.ride_id) AS least_passes, count(*) OVER (PARTITION BY y.ride_id) AS places FROM y JOIN t ON t.ride_id = y.ride_id
), k AS (
  SELECT *, (lon - first_value(lon) OVER w) * 111320 * cos(radians(first_value(lat) OVER w)) AS px, (lat - first_value(lat) OVER w) * 111320 AS py FROM o WHERE least_passes >= 3 AND places = n WINDOW w AS (PARTITION BY ride_id ORDER BY j)
), h AS (
  SELECT k.*, atan2(b.px - a.px, b.py - a.py) AS heading FROM k JOIN k b ON b.ride_id = k.ride_id AND b.j = (k.j + 3) % k.n JOIN k a ON a.ride_id = k.ride_id AND a.j = (k.j + k.n - 3) % k.n
), c AS (
  SELECT h.*, (b.heading - a.heading - 2 * pi() * ceil((b.heading - a.heading - pi()) / (2 * pi()))) / 12 AS curve FROM h JOIN h b ON b.ride_id = h.ride_id AND b.j = (h.j + 3) % h.n JOIN h a ON a.ride_id = h.ride_id AND a.j = (h.j + h.n - 3) % h.n
)
SELECT c.ride_id, c.j, c.n, c.lap_len, round(c.lat, 9) AS lat, round(c.lon, 9) AS lon, round(c.v, 6) AS v, round(c.watts, 6) AS watts, round(c.heading, 6) AS heading, round((c.curve + b.curve + a.curve) / 3, 6) AS curvature
FROM c JOIN c b ON b.ride_id = c.ride_id AND b.j = (c.j + 1) % c.n JOIN c a ON a.ride_id = c.ride_id AND a.j = (c.j + c.n - 1) % c.n
""")
def mean_lap_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps of twenty rows laid over each other by the share of their lengths: the median line with heading and curvature around it."""
    k = F.col("event_id")
    g = events(spark, sf_dir, "value").select(
        F.col("user_id").cast("string").alias("ride_id"), USER.place.alias("i"), F.col("value").alias("watts"), (5 + k % 10).cast("double").alias("v"), (45 + (k % 100) / 9973).alias("lat"), (7 + (k % 77) / 9967).alias("lon")
    )
    g = g.withColumns({"dist": F.sum("v").over(RIDE.so_far), "rows": F.count(F.lit(1)).over(RIDE.whole)})
    bounds = g.where((F.col("i") % 20 == 0) & (F.col("i") + 20 < F.col("rows"))).select("ride_id", (F.floor(F.col("i") / 20) + 1).alias("lap"), F.col("i").alias("i0"), (F.col("i") + 20).alias("i1"), F.lit("device").alias("source"))
    line = mean_lap.mean_lap(g, bounds)
    return line.select("ride_id", "j", "n", "lap_len", *rounded("lat", "lon", digits=9), *rounded("v", "watts", "heading", "curvature"))
