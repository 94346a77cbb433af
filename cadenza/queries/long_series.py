"""Single series of any length: hot keys that are cut into blocks, beside the SQL that takes each in one piece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import long_series, series
from cadenza.operators.series import Series
from cadenza.plans.staging import Staging
from cadenza.queries.registry import epoch, query, rounded, table

#: Every line is of one series.
LINES = Series(("flag",), ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
_LINES = "PARTITION BY l_linestatus <> '' ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
#: Five series, whatever the table's size.
TYPES = Series(("event_type",), ("ts", "event_id"))


def lines(spark: SparkSession, sf_dir: str) -> long_series.Blocks:
    df = table(spark, sf_dir, "lineitem").select(F.lit(True).alias("flag"), *LINES.order, "l_quantity", F.unix_date(F.col("l_shipdate").cast("date")).cast("double").alias("day"))
    return long_series.in_blocks(df, LINES, Staging(spark).put)


@query(f"""
WITH d AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS day FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
       round(sum(CASE WHEN l_quantity > 5 THEN l_quantity ELSE 0 END) OVER c / count(*) OVER c, 6) AS centred, round(avg(l_quantity) OVER t, 6) AS trailing,
       round(CASE WHEN coalesce(lead(day) OVER w, day) = coalesce(lag(day) OVER w, day) THEN 0
         ELSE (coalesce(lead(l_quantity) OVER w, l_quantity) - coalesce(lag(l_quantity) OVER w, l_quantity)) / (coalesce(lead(day) OVER w, day) - coalesce(lag(day) OVER w, day)) END, 6) AS slope
FROM d WINDOW w AS ({_LINES}), c AS ({_LINES} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), t AS ({_LINES} ROWS 29 PRECEDING)
""")
def hot_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving means and the derivative of one series of all lines, in blocks with borders."""
    some = F.when(F.col("l_quantity") > 5, F.col("l_quantity"))
    out = long_series.with_frames(
        lines(spark, sf_dir), 29, 7, lambda s: {"centred": series.centred_mean(some, s, 15), "trailing": series.trailing_mean(F.col("l_quantity"), s, 30), "slope": series.central_derivative(F.col("l_quantity"), F.col("day"), s)}
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *rounded("centred", "trailing", "slope"))


@query(f"""
WITH d AS (SELECT *, greatest(l_quantity - lag(l_quantity) OVER ({_LINES}), 0) AS up FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w - 1 AS place, round(max(l_extendedprice) OVER w, 6) AS highest, round(sum(l_quantity) OVER w, 6) AS covered, round(sum(coalesce(up, 0)) OVER w, 6) AS climbed,
       last_value(CASE WHEN l_quantity > 49 THEN l_orderkey END IGNORE NULLS) OVER w AS large
FROM d WINDOW w AS ({_LINES} ROWS UNBOUNDED PRECEDING)
""")
def hot_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running maximum, sum, gain, place and last known value of one series of all lines, carried from block to block."""
    with_gain = long_series.with_frames(lines(spark, sf_dir), 1, 0, lambda s: {"up": series.gain(F.col("l_quantity"), s)})
    blocks = long_series.in_blocks(with_gain, LINES, Staging(spark).put)
    out = long_series.carried(blocks, sums={"covered": F.col("l_quantity"), "climbed": F.col("up")}, maxima={"highest": F.col("l_extendedprice")}, last={"large": F.when(F.col("l_quantity") > 49, F.col("l_orderkey"))})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("_place").alias("place"), "large", *rounded("highest", "covered", "climbed"))


@query("""
WITH RECURSIVE l AS (
  SELECT event_type, event_id, epoch(ts) / 3600 AS x, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events
), r AS (
  SELECT event_type, pos, min(pos) OVER w AS lo, max(pos) OVER w AS hi, count(*) OVER (PARTITION BY event_type) AS n FROM l WINDOW w AS (PARTITION BY event_type ORDER BY x RANGE BETWEEN 0.25 PRECEDING AND 0.25 FOLLOWING)
), f AS (
  SELECT event_type, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b FROM (SELECT DISTINCT event_type FROM l)
  UNION ALL
  SELECT event_type, pos, greatest(lo - k, 1), least(h + k, n) FROM (
    SELECT r.*, greatest(hi, f.b) AS h, list_filter(range(0, 9), lambda k: least(greatest(hi, f.b) + k, n) - greatest(lo - k, 1) + 1 >= least(9, n))[1] AS k FROM f JOIN r ON r.event_type = f.event_type AND r.pos = f.pos + 1)
), s AS (
  SELECT f.event_type, f.pos, CASE WHEN count(*) >= 3 THEN regr_slope(l.y, l.x) END AS slope FROM f JOIN l ON l.event_type = f.event_type AND l.pos BETWEEN f.a AND f.b WHERE f.pos > 0 GROUP BY f.event_type, f.pos
)
SELECT event_id, round(least(greatest(coalesce(slope, 0), -40), 40), 4) AS slope FROM s JOIN l USING (event_type, pos)
""")
def hot_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope over a quarter of an hour to each side, or nine events, of a series an event type, in blocks that carry how far fits reach."""
    df = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value", (epoch("ts") / 3600).alias("x"))
    out = long_series.long_slope(long_series.in_blocks(df, TYPES, Staging(spark).put, 500), "value", "x", 0.25, 9, 40.0, "slope")
    return out.select("event_id", F.round("slope", 4).alias("slope"))


@query("""
WITH RECURSIVE e AS (
  SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events
), t AS (
  SELECT event_type, 546 * exp(-0.01 * coalesce(avg(60 - value) FILTER (WHERE value < 60), 0)) + 316 AS tau FROM e GROUP BY event_type
), f AS (
  SELECT event_type, CAST(-1 AS BIGINT) AS i, CAST(2000 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS d, CAST(0 AS DOUBLE) AS o FROM t
  UNION ALL
  SELECT f.event_type, e.i,
         CASE WHEN value > 60 THEN greatest(f.b - (value - 60), 0) ELSE least(2000, 2000 - (2000 - f.b) * exp(-1 / tau)) END,
         CASE WHEN value > 60 THEN value - 60 ELSE 0 END,
         CASE WHEN value > 60 THEN greatest(value - 60 - f.b, 0) ELSE 0 END
  FROM f JOIN e ON e.event_type = f.event_type AND e.i = f.i + 1 JOIN t ON t.event_type = f.event_type
)
SELECT event_id, round(b, 6) AS balance, round(d, 6) AS drained, round(o, 6) AS overdrawn FROM f JOIN e USING (event_type, i)
""")
def hot_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reserve of a series an event type: a threshold of 60, a capacity of 2000, in blocks that are composed."""
    df = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value").withColumns({"cp": F.lit(60.0), "full": F.lit(2000.0)})
    out = long_series.long_reserve(long_series.in_blocks(df, TYPES, Staging(spark).put, 500), "value", "cp", "full")
    return out.select("event_id", *rounded("balance", "drained", "overdrawn"))
