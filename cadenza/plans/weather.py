"""Hourly weather at each second of a ride, air density, and the mean conditions of a race."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.physics import air_density, pressure_at_altitude
from cadenza.functions.scalars import lerp
from cadenza.functions.wind import shelter_factor, wind_bearing, wind_vector
from cadenza.operators.joins import interval_join, segments

PLAIN = ("temp", "humidity", "pressure", "wind_gust", "precip", "cloud")


def hours(weather: DataFrame) -> DataFrame:
    """Segments between neighbouring hours of a site with the winds at 10 m as vectors.

    The first starts and the last ends at a bound that any ride lies within.
    """
    east, north = wind_vector(F.col("wind_speed"), F.col("wind_dir"))
    known = weather.where(F.col("wind_speed").isNotNull()).withColumns({"e": east, "n": north})
    values = ["e", "n", "wind_dir", *PLAIN]
    s = segments(known, ("site",), "time", values)
    first = known.groupBy("site").agg(F.min("time").alias("_first"))
    return s.join(first, "site").withColumnRenamed("time", "hour")


def at_times(times: DataFrame, weather: DataFrame, time: str) -> DataFrame:
    """times (``site``, a time column in epoch seconds) with the weather then: ``e``, ``n`` (m/s at 10 m) and the plain values.

    Winds are interpolated as vectors. Before the first and after the last hour that hour's values hold.
    """
    s = hours(weather)
    # rides lie within days: extend the ends by a week instead of without bound, and clamp times to that
    week = 7 * 86_400.0
    s = s.withColumns({
        "_a": F.when(F.col("hour") == F.col("_first"), F.col("hour") - week).otherwise(F.col("hour")),
        "_b": F.coalesce(F.col("next_time"), F.col("hour") + week),
    })
    span = s.groupBy("site").agg(F.min("_a").alias("_low"), F.max("_b").alias("_high"))
    clamped = times.join(span, "site").withColumn("_when", F.least(F.greatest(F.col(time).cast("double"), F.col("_low")), F.col("_high") - 1)).drop("_low", "_high")
    names = {c: f"wx_{c}" for c in ("e", "n", *PLAIN)} | {"wind_dir": "wx_dir"}
    s = s.withColumnsRenamed(names)
    j = interval_join(clamped, s, ("site",), F.col("_when"), "_a", "_b", 3600.0, right_open=True)
    share = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("_when") - F.col("hour"), F.col("next_time") - F.col("hour")))), F.lit(0.0))
    out = {f"wx_{c}": lerp(F.col(f"wx_{c}"), F.col(f"next_{c}"), share) for c in ("e", "n", *PLAIN)}
    return j.withColumns(out).drop("hour", "next_time", "_first", "_a", "_b", "_when", "wx_dir", *(f"next_{c}" for c in ("e", "n", "wind_dir", *PLAIN)))


def with_wind(grid: DataFrame, rides: DataFrame, weather: DataFrame, config: ModelConfig) -> DataFrame:
    """grid with ``we`` and ``wn``: the hourly wind at rider height; null for rides without a site or start."""
    times = grid.select("ride_id", "i", "t").join(rides.where("site is not null and start_time is not null").select("ride_id", "site", "start_time"), "ride_id")
    blown = at_times(times.select("ride_id", "i", "site", (F.col("start_time") + F.col("t")).alias("time_s")), weather, "time_s")
    factor = shelter_factor(config.roughness)
    return grid.join(blown.select("ride_id", "i", (F.col("wx_e") * factor).alias("we"), (F.col("wx_n") * factor).alias("wn")), ["ride_id", "i"], "left")


def ride_density(grid: DataFrame, rides: DataFrame, weather: DataFrame | None, config: ModelConfig) -> DataFrame:
    """``ride_id, rho, temp_c, humidity, pressure_pa``: weather at mid-ride, the device's own temperature
    where most samples have one, pressure by altitude where none is known."""
    own = grid.groupBy("ride_id").agg(F.avg("temp").alias("_temp"), F.count("temp").alias("_k"), F.count(F.lit(1)).alias("_n"), F.avg("alt").alias("_alt"))
    nothing = F.lit(None).cast("double")
    if weather is None:
        mid = rides.select("ride_id", nothing.alias("wx_temp"), nothing.alias("wx_humidity"), nothing.alias("wx_pressure"))
    else:
        times = own.join(rides.where("site is not null and start_time is not null").select("ride_id", "site", "start_time"), "ride_id")
        mid = at_times(times.select("ride_id", "site", (F.col("start_time") + F.floor(F.col("_n") / 2)).alias("time_s")), weather, "time_s").select("ride_id", "wx_temp", "wx_humidity", "wx_pressure")
    j = own.join(mid, "ride_id", "left")
    temp = F.coalesce(F.when(F.col("_k") > 0.5 * F.col("_n"), F.col("_temp")), F.col("wx_temp"), F.lit(config.temp))
    pressure = F.coalesce(F.col("wx_pressure") * 100, pressure_at_altitude(F.coalesce(F.col("_alt"), F.lit(config.altitude))))
    return j.select("ride_id", temp.alias("temp_c"), F.col("wx_humidity").alias("humidity"), pressure.alias("pressure_pa")).withColumn("rho", air_density(F.col("temp_c"), F.col("pressure_pa"), F.col("humidity")))


def conditions(spans: DataFrame, weather: DataFrame) -> DataFrame:
    """Mean weather over ``site, start_s, end_s`` of each ride, from thirteen moments: vector-mean wind, highest gust."""
    step = F.greatest(F.lit(60.0), (F.col("end_s") - F.col("start_s")) / 12)
    moments = spans.withColumn("_step", step).withColumn("time_s", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("end_s") - F.col("start_s")) / F.col("_step") + 1e-9).cast("int")), lambda k: F.col("start_s") + k * F.col("_step"))))
    w = at_times(moments.select("ride_id", "site", "time_s"), weather, "time_s")
    zero: Column = F.lit(0.0)
    means = [F.avg(F.coalesce(F.col(f"wx_{c}"), zero)).alias(c) for c in ("temp", "humidity", "pressure", "precip", "cloud")]
    g = w.groupBy("ride_id").agg(F.avg("wx_e").alias("_e"), F.avg("wx_n").alias("_n"), F.max(F.coalesce("wx_wind_gust", zero)).alias("wind_gust"), *means)
    speed = F.hypot("_e", "_n")
    return g.select("ride_id", speed.alias("wind_speed"), F.when(speed < 1e-6, 0.0).otherwise(wind_bearing(F.col("_e"), F.col("_n"))).alias("wind_dir"), "wind_gust", "temp", "humidity", "pressure", "precip", "cloud")
