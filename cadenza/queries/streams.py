"""Streams over the events table, run until all files are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.queries.registry import query, table
from cadenza.streaming.history import live_history, live_within
from cadenza.streaming.sessions import live_load, live_reserve, live_sessions


def shared_folder(spark: SparkSession) -> str:
    """A new folder where the driver and all executors can write: in ``spark.checkpoint.dir``, else in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has written to Parquet when all its input is read."""
    folder = shared_folder(spark)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("""
WITH m AS (SELECT max(ts) AS last FROM events), g AS (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, FALSE) AS cut FROM events
), s AS (
  SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g
), t AS (
  SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, session
)
SELECT user_id, epoch_us(a) AS start_us, n, total FROM t, m WHERE b + INTERVAL 6 HOUR <= last - INTERVAL 1 MINUTE
""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream that its watermark has closed."""
    found = run_to_end(spark, live_sessions(_events(spark, sf_dir), "user_id", "at", "value", "6 hours"))
    return found.select("user_id", F.unix_micros("start").alias("start_us"), "n", F.round("total", 6).alias("total"))


@query("""
WITH m AS (SELECT max(ts) AS last FROM events)
SELECT user_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, round(avg(value), 6) AS avg, max(value) AS peak, count(*) AS n
FROM events, m GROUP BY user_id, time_bucket(INTERVAL 1 HOUR, ts) HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= max(last) - INTERVAL 1 MINUTE
""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of a stream, up to its watermark."""
    found = run_to_end(spark, live_load(_events(spark, sf_dir), "user_id", "at", "value", "1 hour"))
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.round("avg", 6).alias("avg"), "peak", "n")


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, coalesce(avg(40 - value) FILTER (WHERE value <= 40) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS d FROM events
), f AS (
  SELECT user_id, i, ts, CASE WHEN value > 40 THEN greatest(500 - (value - 40), 0) ELSE CAST(500 AS DOUBLE) END AS b FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, e.ts, CASE WHEN value > 40 THEN greatest(f.b - (value - 40), 0) ELSE 500 - (500 - f.b) * exp(-1 / (546 * exp(-0.01 * d) + 316)) END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1
)
SELECT user_id, epoch_us(ts) AS at_us, round(b, 6) AS balance FROM f
""")
def stream_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reserve that follows each user's stream."""
    found = run_to_end(spark, live_reserve(_events(spark, sf_dir).select("user_id", "at", "value"), "user_id", "at", "value", 40.0, 500.0))
    return found.select("user_id", F.unix_micros("at").alias("at_us"), F.round("balance", 6).alias("balance"))


@query("""
WITH m AS (SELECT max(ts) - INTERVAL 1 MINUTE AS mark FROM events), e AS (
  SELECT user_id, ts, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next,
         avg(value) OVER h AS mean, count(*) OVER h AS n, first_value(value) OVER r AS v0, first_value(ts) OVER r AS t0
  FROM events WINDOW h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW), r AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW)
)
SELECT user_id, epoch_us(ts) AS at_us, 'sample' AS kind, round(mean, 6) AS mean, round(CASE WHEN t0 < ts THEN (value - v0) / (epoch(ts) - epoch(t0)) ELSE 0 END, 6) AS rate, n FROM e
UNION ALL
SELECT user_id, epoch_us(ts + INTERVAL 24 HOUR), 'stop', NULL, NULL, 0 FROM e, m WHERE coalesce(next > ts + INTERVAL 24 HOUR, ts + INTERVAL 24 HOUR < mark)
""")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the last twelve hours, rates of the last three and days without an event, of each user's stream."""
    hour = 3600.0
    found = run_to_end(spark, live_history(_events(spark, sf_dir).select("user_id", "at", "value"), "user_id", "at", "value", 12 * hour, 3 * hour, 24 * hour))
    return found.select("user_id", F.col("at").alias("at_us"), "kind", F.round("mean", 6).alias("mean"), F.round("rate", 6).alias("rate"), "n")


@query("""
SELECT e.event_id FROM events e WHERE e.event_type = 'purchase' AND EXISTS (
  SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND e.ts >= s.ts - INTERVAL 2 HOUR AND e.ts <= s.ts + INTERVAL 7 HOUR)
""")
def stream_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from two hours before to seven hours after a signup of the same user, both read as streams."""
    side = lambda kind: _events(spark, sf_dir).where(F.col("event_type") == kind).select("event_id", "user_id", "at")
    return run_to_end(spark, live_within(side("purchase"), side("signup"), "user_id", "at", "2 HOURS", "7 HOURS")).select("event_id")
