"""Series kernels, folds, resampling and islands on ``events`` by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.wind import wind_bearing, wind_vector
from cadenza.operators import aggregates, folds, islands, series
from cadenza.operators.resample import resample
from cadenza.operators.series import Series
from cadenza.queries.registry import epoch, query, rounded, table

USER = Series(("user_id",), ("ts", "event_id"))
PLACE = Series(("user_id",), ("i",))


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", *columns)


def numbered(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events with their place ``i`` in their user's series."""
    return events(spark, sf_dir, *columns).withColumn("i", USER.place)


@query("""
WITH r AS (
  SELECT user_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 29 PRECEDING) AS m,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
), a AS (
  SELECT user_id, coalesce(pow(avg(pow(m, 4)) FILTER (WHERE rn >= 30), 0.25), avg(value)) AS np, avg(value) AS mean, count(*) AS seconds FROM r GROUP BY user_id
)
SELECT user_id, round(np, 6) AS np, round(mean, 6) AS mean, seconds, round(np / 40, 6) AS intensity, round(np / mean, 6) AS variability,
       round(seconds * np * (np / 40) / (40.0 * 3600) * 100, 6) AS tss, round(mean * seconds / 1000, 6) AS kj
FROM a
""")
def np_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised mean and load of each user."""
    df = series.power_mean(events(spark, sf_dir, "value"), USER, "value", extra=[F.avg("value").alias("mean"), F.count(F.lit(1)).alias("seconds")])
    df = df.select("*", *aggregates.load_metrics(F.col("np"), F.col("mean"), F.col("seconds"), F.lit(40.0)))
    return df.select("user_id", "seconds", *rounded("np", "mean", "intensity", "variability", "tss", "kj"))


_FOLD = """
WITH RECURSIVE e AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events
), t AS (
  SELECT user_id, 546 * exp(-0.01 * coalesce(avg(40 - value) FILTER (WHERE value < 40), 0)) + 316 AS tau FROM e GROUP BY user_id
), f AS (
  SELECT user_id, CAST(-1 AS BIGINT) AS i, CAST(500 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS d, CAST(0 AS DOUBLE) AS o FROM t
  UNION ALL
  SELECT f.user_id, e.i,
         CASE WHEN value > 40 THEN greatest(f.b - (value - 40), 0) ELSE least(500, 500 - (500 - f.b) * exp(-1 / tau)) END,
         CASE WHEN value > 40 THEN value - 40 ELSE 0 END,
         CASE WHEN value > 40 THEN greatest(value - 40 - f.b, 0) ELSE 0 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1 JOIN t ON t.user_id = f.user_id
)
"""


def _reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = numbered(spark, sf_dir, "value").withColumns({"cp": F.lit(40.0), "full": F.lit(500.0)})
    return folds.reserve_balance(df, PLACE, "value", "cp", "full")


@query(_FOLD + """
SELECT f.user_id, round(any_value(tau), 6) AS tau, round(min(b), 6) AS min_bal, arg_min(i, (b, i)) AS min_at, round(sum(d), 6) AS spent, round(sum(o), 6) AS overdraft,
       min(b) <= 0 AS depleted, CAST(count(*) FILTER (WHERE b <= 0) AS DOUBLE) AS depleted_seconds
FROM f JOIN t ON t.user_id = f.user_id WHERE i >= 0 GROUP BY f.user_id
""")
def wprime_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user's reserve falls: a threshold of 40, a capacity of 500."""
    stats = folds.reserve_stats(_reserve(spark, sf_dir), PLACE)
    return stats.select("user_id", "min_at", "depleted", "depleted_seconds", *rounded("tau", "min_bal", "spent", "overdraft"))


@query(_FOLD + "SELECT user_id, i, round(b, 6) AS balance FROM f WHERE i >= 0")
def reserve_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reserve(spark, sf_dir).select("user_id", "i", *rounded("balance"))


@query("""
SELECT event_id,
       round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) OVER c / count(*) OVER c, 6) AS centred,
       round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) OVER t / count(*) OVER t, 6) AS trailing
FROM events
WINDOW c AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), t AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)
""")
def centred_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving means in which undefined values (here: of errors) count as 0 in the denominator too."""
    x = F.when(F.col("event_type") != "error", F.col("value"))
    df = events(spark, sf_dir, "value", "event_type").select("event_id", series.centred_mean(x, USER, 15).alias("centred"), series.trailing_mean(x, USER, 3).alias("trailing"))
    return df.select("event_id", *rounded("centred", "trailing"))


@query("""
WITH e AS (
  SELECT *, epoch(ts) AS t FROM events
), n AS (
  SELECT event_id, coalesce(lead(value) OVER w, value) AS y1, coalesce(lag(value) OVER w, value) AS y0, coalesce(lead(t) OVER w, t) AS x1, coalesce(lag(t) OVER w, t) AS x0
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)
SELECT event_id, round(CASE WHEN x1 = x0 THEN 0 ELSE (y1 - y0) / (x1 - x0) END, 9) AS slope FROM n
""")
def central_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir, "value").withColumn("t", epoch("ts"))
    return df.select("event_id", F.round(series.central_derivative(F.col("value"), F.col("t"), USER), 9).alias("slope"))


@query("""
WITH RECURSIVE l AS (
  SELECT l_suppkey, CAST(date_diff('day', TIMESTAMP '1990-01-01', l_shipdate) AS DOUBLE) AS x, l_extendedprice / 10000 AS y,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem
), r AS (
  SELECT l_suppkey, pos, min(pos) OVER w AS lo, max(pos) OVER w AS hi, count(*) OVER (PARTITION BY l_suppkey) AS n FROM l WINDOW w AS (PARTITION BY l_suppkey ORDER BY x RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING)
), f AS (
  SELECT l_suppkey, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b FROM (SELECT DISTINCT l_suppkey FROM l)
  UNION ALL
  SELECT l_suppkey, pos, greatest(lo - k, 1), least(h + k, n) FROM (
    SELECT r.*, greatest(hi, f.b) AS h, list_filter(range(0, 13), lambda k: least(greatest(hi, f.b) + k, n) - greatest(lo - k, 1) + 1 >= least(13, n))[1] AS k FROM f JOIN r ON r.l_suppkey = f.l_suppkey AND r.pos = f.pos + 1)
), s AS (
  SELECT f.l_suppkey, f.pos, CASE WHEN count(*) >= 3 THEN regr_slope(l.y, l.x) END AS slope FROM f JOIN l ON l.l_suppkey = f.l_suppkey AND l.pos BETWEEN f.a AND f.b WHERE f.pos > 0 GROUP BY f.l_suppkey, f.pos
)
SELECT l_suppkey, pos AS "at", round(least(greatest(coalesce(slope, 0), -0.25), 0.25), 6) AS slope FROM s
""")
def range_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of prices over 20 days to each side, widened to 13 rows where fewer lie so near."""
    s = Series(("l_suppkey",), ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", *s.order, (F.col("l_extendedprice") / 10000).alias("y"))
    df = df.withColumn("x", F.timestamp_diff("DAY", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz"), F.col("l_shipdate")).cast("double"))
    df = series.range_slope(df, s, "y", "x", 20, 13, 0.25, "slope")
    return df.select("l_suppkey", (s.place + 1).alias("at"), *rounded("slope"))


_TRACK = """
WITH p AS (
  SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon, row_number() OVER (PARTITION BY label ORDER BY vec_id) * CAST(3 AS DOUBLE) AS dist FROM embeddings
), n AS (
  SELECT *, coalesce(lead(lat, 2) OVER w, lead(lat) OVER w, lat) AS la1, coalesce(lag(lat, 2) OVER w, lag(lat) OVER w, lat) AS la0,
         coalesce(lead(lon, 2) OVER w, lead(lon) OVER w, lon) AS lo1, coalesce(lag(lon, 2) OVER w, lag(lon) OVER w, lon) AS lo0,
         coalesce(lead(dist, 2) OVER w, lead(dist) OVER w, dist) - coalesce(lag(dist, 2) OVER w, lag(dist) OVER w, dist) AS ds
  FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)
), h AS (
  SELECT *, CASE WHEN abs(cos(radians(lat)) * radians(lo1 - lo0)) >= 1e-12 OR abs(radians(la1 - la0)) >= 1e-12 THEN atan2(cos(radians(lat)) * radians(lo1 - lo0), radians(la1 - la0)) END AS b FROM n
), k AS (
  SELECT *, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING), 0) AS heading FROM h
), c AS (
  SELECT *, coalesce(lead(heading, 2) OVER w, lead(heading) OVER w, heading) - coalesce(lag(heading, 2) OVER w, lag(heading) OVER w, heading) AS d FROM k WINDOW w AS (PARTITION BY label ORDER BY vec_id)
)
SELECT vec_id, round(heading, 6) AS heading, round(CASE WHEN ds < 2 THEN 0 ELSE (d - 2 * pi() * ceil((d - pi()) / (2 * pi()))) / ds END, 6) AS curvature FROM c
"""


@query(_TRACK)
def track_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearing and curvature along tracks."""
    s = Series(("label",), ("vec_id",))
    df = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("lat"), F.get("embedding", F.lit(1)).cast("double").alias("lon"))
    df = df.withColumn("dist", (s.place + 1) * 3.0).withColumn("heading", series.heading(F.col("lat"), F.col("lon"), s))
    return df.withColumn("curvature", series.curvature(F.col("heading"), F.col("dist"), s)).select("vec_id", *rounded("heading", "curvature"))


@query("""
WITH s AS (
  SELECT user_id, epoch(ts) / 3600 AS t, CASE WHEN event_type <> 'error' THEN value END AS h, value AS z, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n,
         min(epoch(ts) / 3600) OVER (PARTITION BY user_id) AS t0
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), g AS (
  SELECT *, lead(t) OVER w AS t1, lead(h) OVER w AS h1, lead(z) OVER w AS z1 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY k)
), p AS (
  SELECT *, unnest(range(CAST(ceil(t - t0) AS BIGINT), CASE WHEN k = n - 1 THEN CAST(floor(t1 - t0) AS BIGINT) + 1 ELSE CAST(ceil(t1 - t0) AS BIGINT) END)) AS i FROM g WHERE k < n
), v AS (
  SELECT user_id, i, t1 - t > 12 AS gap, (t0 + i - t) / (t1 - t) AS f, h, h1, z, z1 FROM p
), c AS (
  SELECT user_id, i, gap, CASE WHEN gap THEN h ELSE coalesce(h + (h1 - h) * f, h, h1) END AS held, CASE WHEN gap THEN 0 ELSE z + (z1 - z) * f END AS zeroed FROM v
)
SELECT user_id, i, gap, round(coalesce(last_value(held IGNORE NULLS) OVER w, 0), 6) AS held, round(zeroed, 6) AS zeroed
FROM c WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)
""")
def resample_grid_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on a grid of hours; stretches of more than 12 hours are holes."""
    df = events(spark, sf_dir, "value", "event_type").select("user_id", "event_id", (epoch("ts") / 3600).alias("t"), F.when(F.col("event_type") != "error", F.col("value")).alias("held"), F.col("value").alias("zeroed"))
    df = resample(df, ("user_id",), "t", hold=["held"], zero=["zeroed"], hole=12.0, tie="event_id")
    return df.select("user_id", "i", "gap", *rounded("held", "zeroed"))


@query("""
WITH d AS (SELECT event_id, user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, round(max(value) OVER w, 6) AS highest, round(sum(value) OVER w, 6) AS covered, round(sum(greatest(coalesce(value - p, 0), 0)) OVER w, 6) AS climbed
FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def monotone_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running maximum, running sum and total gain."""
    df = events(spark, sf_dir, "value").withColumn("up", series.gain(F.col("value"), USER))
    df = df.select("event_id", series.running_max(F.col("value"), USER).alias("highest"), series.running_sum(F.col("value"), USER).alias("covered"), series.running_sum(F.col("up"), USER).alias("climbed"))
    return df.select("event_id", *rounded("highest", "covered", "climbed"))


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT event_id, round(CASE WHEN i = 0 THEN 0 ELSE (value - coalesce(lag(value, 5) OVER w, first_value(value) OVER w)) / least(i, 5) END, 6) AS rate
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def trailing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change per row over the last five."""
    return events(spark, sf_dir, "value").select("event_id", F.round(series.trailing_rate(F.col("value"), USER, 5), 6).alias("rate"))


@query("""
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT a.user_id, a.i, round(avg(b.value), 6) AS smooth
FROM n a JOIN n b ON a.user_id = b.user_id AND ((b.i - a.i + a.n + 1) % a.n) <= 2 GROUP BY a.user_id, a.i
""")
def circular_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving mean of three rows on closed series."""
    return series.circular_mean(numbered(spark, sf_dir, "value").drop("ts", "event_id"), PLACE, "value", 3, "smooth").select("user_id", "i", *rounded("smooth"))


@query("""
WITH g AS (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR, FALSE) AS cut FROM events
), s AS (
  SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1 AS session FROM g
)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 6) AS total, round(epoch(max(ts)) - epoch(min(ts)), 6) AS seconds FROM s GROUP BY user_id, session
""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions parted by more than 12 hours."""
    df = events(spark, sf_dir, "value").withColumn("t", epoch("ts"))
    df = islands.sessions(df, USER, F.col("ts") - F.lag("ts").over(USER.window) > F.expr("INTERVAL 12 HOUR"))
    return df.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.max("t") - F.min("t"), 6).alias("seconds"))


@query("""
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
r AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM n WHERE value < 30)
SELECT user_id, min(i) AS i0, max(i) AS i1, count(*) AS size FROM r GROUP BY user_id, g HAVING count(*) >= 3
""")
def stop_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least three values below 30."""
    return islands.runs(numbered(spark, sf_dir, "value"), PLACE, F.col("value") < 30, least=3).drop("run")


@query("""
WITH n AS (
  SELECT user_id, value, row_number() OVER w - 1 AS i, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), r AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM n WHERE s > 50),
k AS (SELECT user_id, min(i) AS i0, max(i) AS i1 FROM r GROUP BY user_id, g HAVING count(*) >= 3),
m AS (SELECT *, CASE WHEN i0 - lag(i1) OVER (PARTITION BY user_id ORDER BY i0) <= 3 THEN 0 ELSE 1 END AS cut FROM k),
j AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY i0 ROWS UNBOUNDED PRECEDING) AS g FROM m),
x AS (SELECT user_id, min(i0) AS i0, max(i1) AS i1 FROM j GROUP BY user_id, g),
e AS (SELECT x.user_id, i0, i1, sum(greatest(value - 50, 0)) AS above, max(value) AS peak FROM x JOIN n ON n.user_id = x.user_id AND i BETWEEN i0 AND i1 GROUP BY x.user_id, i0, i1)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i0) AS idx, i0, i1, round(above, 6) AS above, peak FROM e WHERE above >= 60
""")
def surge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed values above 50 for three rows or more, merged across up to three rows, with enough above the threshold."""
    df = numbered(spark, sf_dir, "value")
    df = df.withColumn("s", series.centred_mean(F.col("value"), PLACE, 3))
    regions = islands.merge_regions(islands.runs(df, PLACE, F.col("s") > 50, least=3).select("user_id", "i0", "i1"), ("user_id",), 3)
    from cadenza.operators.joins import interval_join

    inside = interval_join(df.select("user_id", "i", "value"), regions, ("user_id",), F.col("i"), "i0", "i1", 64)
    found = inside.groupBy("user_id", "i0", "i1").agg(F.sum(F.greatest(F.col("value") - 50, F.lit(0.0))).alias("above"), F.max("value").alias("peak")).where("above >= 60")
    idx = F.row_number().over(Series(("user_id",), ("i0",)).window).cast("long")
    return found.select("user_id", idx.alias("idx"), "i0", "i1", *rounded("above"), "peak")


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), f AS (
  SELECT user_id, i, event_id, ts AS last, TRUE AS kept FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, e.event_id, CASE WHEN e.ts - f.last > INTERVAL 24 HOUR THEN e.ts ELSE f.last END, e.ts - f.last > INTERVAL 24 HOUR FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1
)
SELECT user_id, event_id FROM f WHERE kept
""")
def spacing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events more than a day after the last one kept."""
    df = events(spark, sf_dir).withColumn("hours", epoch("ts") / 3600)
    return folds.spacing_filter(df, USER, "hours", 24.0).select("user_id", "event_id")


@query("""
WITH n AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE WHEN event_type IN ('click', 'error') THEN 1 WHEN event_type IN ('view', 'signup') THEN -1 ELSE 0 END AS sign, value > 60 AS seed,
         count(*) OVER (PARTITION BY user_id) AS n FROM events
), c AS (
  SELECT *, coalesce(sign <> lag(sign) OVER (PARTITION BY user_id ORDER BY i), FALSE) AS cut FROM n
), r AS (
  SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c
), z AS (
  SELECT *, max(run) OVER (PARTITION BY user_id) AS final, arg_min(sign, i) OVER (PARTITION BY user_id) AS one, arg_max(sign, i) OVER (PARTITION BY user_id) AS last FROM r
), u AS (
  SELECT user_id, sign, seed, CASE WHEN run = final AND final > 0 AND one = last THEN 0 ELSE run END AS run, CASE WHEN run = final AND final > 0 AND one = last THEN i - n ELSE i END AS pos FROM z
)
SELECT user_id, sign, min(pos) AS a, max(pos) AS b, count(*) AS size FROM u WHERE sign <> 0 GROUP BY user_id, run, sign HAVING bool_or(seed)
""")
def closed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one sign on closed series that hold a high value."""
    df = numbered(spark, sf_dir, "value", "event_type")
    sign = F.when(F.col("event_type").isin("click", "error"), 1).when(F.col("event_type").isin("view", "signup"), -1).otherwise(0)
    found = islands.closed_runs(df, PLACE, sign, F.col("value") > 60)
    return found.groupBy("user_id", "run", "sign").agg(F.min("unrolled").alias("a"), F.max("unrolled").alias("b"), F.count(F.lit(1)).alias("size")).drop("run")


@query("""
WITH v AS (SELECT user_id, -value * sin(radians(CAST(event_id * 37 % 360 AS DOUBLE))) AS e, -value * cos(radians(CAST(event_id * 37 % 360 AS DOUBLE))) AS n FROM events),
m AS (SELECT user_id, avg(e) AS e, avg(n) AS n FROM v GROUP BY user_id)
SELECT user_id, round(sqrt(e * e + n * n), 6) AS speed, round((degrees(atan2(-e, -n)) + 360) % 360, 6) AS bearing FROM m
""")
def vector_mean_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winds averaged as vectors."""
    east, north = wind_vector(F.col("value"), (F.col("event_id") * 37 % 360).cast("double"))
    m = events(spark, sf_dir, "value").groupBy("user_id").agg(F.avg(east).alias("e"), F.avg(north).alias("n"))
    return m.select("user_id", F.round(F.hypot("e", "n"), 6).alias("speed"), F.round(wind_bearing(F.col("e"), F.col("n")), 6).alias("bearing"))
