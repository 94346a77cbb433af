"""The store of rides on the driver's tables: what is left after rides were put, put again and removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.plans.tables import CHANNELS, RIDES
from cadenza.queries.registry import epoch, query, table
from cadenza.queries.streams import shared_folder
from cadenza.sources import store


def _rides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each user's events as a ride: (rides, samples)."""
    e = events.withColumns({"ride_id": F.concat(F.lit("user-"), "user_id"), "at": epoch("ts")})
    start = e.groupBy("ride_id").agg(F.min("at").alias("start_time"))
    given = {"ride_id": F.col("ride_id"), "name": F.col("ride_id"), "source": F.lit("events"), "start_time": F.col("start_time"), "sport": F.lit("cycling")}
    rides = start.select(*(given.get(n, F.lit(None).cast(kind)).alias(n) for n, kind in (f.split() for f in RIDES.split(", "))))
    values = {"watts": F.col("value")}
    samples = e.join(start, "ride_id").select("ride_id", F.col("event_id").alias("seq"), (F.col("at") - F.col("start_time")).alias("t"), *(values.get(c, F.lit(None).cast("double")).alias(c) for c in CHANNELS))
    return rides, samples


@query("""
WITH k AS (SELECT * FROM events WHERE user_id % 2 = 1 OR value < 50)
SELECT 'user-' || user_id AS ride_id, count(*) AS n, round(sum(value), 6) AS total, round(min(epoch(ts)), 6) AS start_time FROM k WHERE user_id <> 3 GROUP BY user_id
""")
def stored_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides put once, those of even users put again with their smaller values alone, and one removed: the latest of each with its samples."""
    path, e = shared_folder(spark), table(spark, sf_dir, "events")
    store.put(*_rides(e), path)
    store.put(*_rides(e.where("user_id % 2 = 0 AND value < 50")), path)
    store.remove(spark, path, "user-3")
    sums = store.samples(spark, path).groupBy("ride_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("watts"), 6).alias("total"))
    return store.rides(spark, path).select("ride_id", F.round("start_time", 6).alias("start_time")).join(sums, "ride_id")
