"""Lists of activities: projection, filters and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.text import is_ride

ACTIVITY = (
    "id string, name string, type string, icu_activity_type string, sub_type string, race boolean, commute boolean, trainer boolean, start_date_local string, start_date string, "
    "moving_time double, elapsed_time double, distance double, icu_average_watts double, average_watts double, icu_weighted_avg_watts double, icu_ftp double, icu_weight double, "
    "icu_pm_cp double, icu_pm_w_prime double, stream_types array<string>, tags array<string>, device_name string, source string"
)
#: What a status of the service means.
STATUS = {401: "the key was refused", 403: "this key may not read the activity", 404: "no such activity", 422: "the activity can't be served", 429: "too many requests; wait a minute"}


def read_activities(spark: SparkSession, path: str, oldest: str | None = None, newest: str | None = None) -> DataFrame:
    """Activities of JSON lists, starting within [oldest, newest] (ISO dates, local)."""
    df = spark.read.schema(ACTIVITY).option("multiLine", "true").json(path)
    day = F.substring(F.coalesce("start_date_local", "start_date"), 1, 10)
    for bound, holds in ((oldest, lambda b: day >= b), (newest, lambda b: day <= b)):
        df = df.where(holds(bound)) if bound else df
    return df


def summaries(activities: DataFrame) -> DataFrame:
    """The columns that tell which activities can be analysed."""
    streams = F.coalesce("stream_types", F.array().cast("array<string>"))
    has = lambda *names: F.arrays_overlap(streams, F.array(*map(F.lit, names)))
    watts = F.coalesce("icu_average_watts", "average_watts")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    powered = (F.coalesce("icu_average_watts", F.lit(0.0)) != 0) | (F.coalesce("average_watts", F.lit(0.0)) != 0)
    kind = F.coalesce(F.nullif("type", F.lit("")), "icu_activity_type", F.lit(""))
    return activities.select(
        "id", F.coalesce(F.nullif("name", F.lit("")), F.lit("Untitled")).alias("name"), kind.alias("type"), is_ride(kind).alias("is_ride"),
        (yes("race") | (F.upper(F.coalesce("sub_type", F.lit(""))) == "RACE")).alias("is_race"), "sub_type", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        yes("commute").alias("commute"), yes("trainer").alias("trainer"), streams.alias("stream_types"), has("latlng").alias("has_gps_stream"), has("watts", "fixed_watts").alias("has_power_stream"),
        F.col("device_name").alias("device"), "source", (F.upper(F.coalesce("source", F.lit(""))) == "STRAVA").alias("api_blocked"), F.coalesce("start_date_local", "start_date").alias("start"), F.col("start_date").alias("start_utc"),
        "moving_time", "elapsed_time", "distance", watts.alias("avg_watts"), F.col("icu_weighted_avg_watts").alias("np"), F.col("icu_ftp").alias("ftp"), F.col("icu_weight").alias("weight_kg"), F.col("icu_pm_cp").alias("cp"), F.col("icu_pm_w_prime").alias("w_prime"),
        (powered | has("watts", "fixed_watts")).alias("has_power"),
    )


def activity_filter(race: bool = False, power: bool = False, gps: bool = False, tags: list[str] = (), name: str = "") -> Column:
    """Whether a summary passes all that is asked for; any of the tags will do."""
    keep = F.lit(True)
    for wanted, column in ((race, "is_race"), (power, "has_power"), (gps, "has_gps_stream")):
        keep = keep & F.col(column) if wanted else keep
    keep = keep & F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else keep
    return keep & F.contains(F.lower("name"), F.lit(name.lower())) if name else keep


def tag_counts(df: DataFrame, tags: str = "tags") -> DataFrame:
    """``tag, count``, the most frequent first."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "tag")
