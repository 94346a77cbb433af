"""Efforts well above critical power, where they began and what they cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.geo import planar_metres
from cadenza.operators.aggregates import steady_mean
from cadenza.operators.islands import merge_regions, with_runs
from cadenza.operators.joins import interval_join
from cadenza.operators.series import RIDE, centred_mean

#: Rows between merged kicks, look-back for shelter, the ratio below which it is shelter,
#: seconds around an apex that count as its exit, metres to the nearest corner.
MERGE, LOOK_BACK, SHELTER, BEFORE_APEX, AFTER_APEX, NEAR = 3, 10, 0.88, 2, 7, 150.0


def detect_surges(series: DataFrame, laps: DataFrame, turns: DataFrame, events: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """surges: efforts of at least four seconds that took a kJ or more out of the reserve."""
    key = ["ride_id", "i0", "i1"]
    smoothed = series.withColumn("_w", centred_mean(F.col("watts"), RIDE, 3))
    high = with_runs(smoothed, RIDE, F.col("_w") > F.col("cp") * config.surge_factor)
    # an effort begins where the rider moves, but does not end where they stop
    regions = high.groupBy("ride_id", "run").agg(F.min(F.when(F.col("moving"), F.col("i"))).alias("i0"), F.max("i").alias("i1")).where(F.col("i1") - F.col("i0") + 1 >= config.min_surge_seconds)
    regions = merge_regions(regions.select(*key), ("ride_id",), MERGE)
    wide = regions.withColumn("_a", F.greatest(F.col("i0") - LOOK_BACK, F.lit(0)))
    s = interval_join(series.select("ride_id", "i", "t", "watts", "cp", "dist", "ratio", "balance", "lat", "lon"), wide, ("ride_id",), F.col("i"), "_a", "i1", 64)
    i = F.col("i")
    own = lambda c: F.when(i >= F.col("i0"), F.col(c))
    at = lambda c, end: F.max(F.when(i == F.col(end), F.col(c)))
    e = s.groupBy(*key).agg(
        at("t", "i0").alias("t0"), F.count(own("i")).cast("double").alias("seconds"), steady_mean(own("watts")).alias("avg"), F.max(own("watts")).alias("peak"),
        (F.sum(F.when(i >= F.col("i0"), F.greatest(F.col("watts") - F.col("cp"), F.lit(0.0)))) / 1000).alias("match_kj"), (at("dist", "i0") / 1000).alias("km"),
        F.avg(own("ratio")).alias("ratio"), steady_mean(F.when(i <= F.col("i0"), F.col("ratio"))).alias("ratio_before"),
        ((at("balance", "i0") - at("balance", "i1")) / 1000).alias("wbal_drop"), (at("balance", "i1") / 1000).alias("wbal_after"), at("lat", "i0").alias("lat"), at("lon", "i0").alias("lon"),
    ).where(F.col("match_kj") >= config.min_match_kj)
    spans = laps.select("ride_id", "lap", F.col("i0").alias("_l0"), F.col("i1").alias("_l1"))
    in_lap = interval_join(e.select(*key), spans, ("ride_id",), F.col("i0"), "_l0", "_l1", 256).groupBy(*key).agg(F.min("lap").alias("lap"))
    exits = events.select("ride_id", (F.col("apex") - BEFORE_APEX).alias("_e0"), (F.col("apex") + AFTER_APEX).alias("_e1"))
    leaving = interval_join(e.select(*key), exits, ("ride_id",), F.col("i0"), "_e0", "_e1", 32, how="left_semi").withColumn("corner_exit", F.lit(True))
    # a ride has few corners: all of its own are compared with each effort
    places = turns.select("ride_id", F.col("name").alias("_name"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    apart = e.select(*key, "lat", "lon").join(places, "ride_id").withColumn("_d", planar_metres(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).where(F.col("_d") < NEAR)
    near = apart.groupBy(*key).agg(F.min(F.struct("_d", "_name")).alias("m")).select(*key, F.col("m._name").alias("near_turn"), F.col("m._d").alias("turn_distance"))
    out = e.join(in_lap, key, "left").join(leaving, key, "left").join(near, key, "left")
    out = out.withColumns({"corner_exit": F.coalesce("corner_exit", F.lit(False)), "from_shelter": F.coalesce(F.col("ratio_before") < SHELTER, F.lit(False))})
    return out.withColumn("idx", F.row_number().over(Window.partitionBy("ride_id").orderBy("i0")).cast("long")).drop("lat", "lon")
