"""Hourly weather in saved JSON answers of the forecast or archive service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.text import zoned_iso

#: Columns and the service's hourly variables.
VARIABLES = {
    "temp": "temperature_2m", "humidity": "relative_humidity_2m", "pressure": "surface_pressure", "wind_speed": "wind_speed_10m", "wind_dir": "wind_direction_10m",
    "wind_gust": "wind_gusts_10m", "precip": "precipitation", "cloud": "cloud_cover",
}
#: Days within which the forecast service is asked first; days that cached weather and cached maps are good for.
RECENT_DAYS, CACHE_DAYS, MAP_CACHE_DAYS = 10, 30, 60


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """``site, time`` (epoch seconds) and the variables, a row an hour; hours without wind are dropped. The site is the file's name."""
    hourly = ", ".join(["time: array<string>", *(f"{v}: array<double>" for v in VARIABLES.values())])
    raw = spark.read.schema(f"latitude double, longitude double, elevation double, hourly struct<{hourly}>").option("multiLine", "true").json(path)
    site = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), *(F.coalesce(f"hourly.{v}", F.array().cast("array<double>")).alias(c) for c, v in VARIABLES.items()))
    return raw.select(site.alias("site"), "elevation", F.explode(zipped).alias("h")).select("site", "elevation", "h.*").withColumn("time", (F.unix_micros(F.try_to_timestamp(zoned_iso(F.regexp_replace("time", r"(T\d{2}:\d{2})$", "$1:00")))) / 1e6)).where("wind_speed is not null and time is not null")


def service_for(start: Column, now: Column) -> Column:
    """Which service to ask first for a ride: recent days are not in the archive yet."""
    return F.when(F.datediff(now, start) < RECENT_DAYS, "forecast").otherwise("archive")


def fresh(cached: DataFrame, fetched_at: str, now: Column, days: int = CACHE_DAYS) -> DataFrame:
    """Rows of a table of cached answers that are not too old."""
    return cached.where(F.col(fetched_at) > now - F.make_interval(days=F.lit(days)))


def cache_key(lat: Column, lon: Column, start: Column, end: Column) -> Column:
    """Key of an answer: the place to a hundredth of a degree, and the days from an hour before ``start`` to an hour after ``end`` (epoch seconds)."""
    day = lambda s: F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(s).cast("timestamp_ntz")), "yyyy-MM-dd")
    return F.concat_ws("_", F.format_string("%.2f", lat), F.format_string("%.2f", lon), day(start - 3600), day(end + 3600))
