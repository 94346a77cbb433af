"""From raw samples to a grid of seconds with everything that can be told from single rides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.operators import series
from cadenza.operators.resample import crop, marker_indices, resample, too_short_or_long
from cadenza.operators.series import RIDE
from cadenza.plans.tables import CHANNELS

KEY = ("ride_id",)
HELD, ZEROED, PLACES = ["alt", "hr", "temp", "dist"], ["cad", "watts", "v"], ["lat", "lon"]


def present(samples: DataFrame) -> DataFrame:
    """``has_<channel>`` of each ride: whether any sample carries it."""
    return samples.groupBy("ride_id").agg(*(F.max(F.col(c).isNotNull()).alias(f"has_{c}") for c in CHANNELS))


def cropped_samples(samples: DataFrame, rides: DataFrame, config: ModelConfig) -> DataFrame:
    """Samples within each ride's crop. It comes before all else, so that nothing outside it counts."""
    bounds = rides.select("ride_id", "crop_start", "crop_end")
    inside = crop(samples.join(bounds, "ride_id", "left"), KEY, "t", F.col("crop_start"), F.col("crop_end"), config.min_samples)
    return inside.drop("crop_start", "crop_end")


def rejected(samples: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Rides that can't be analysed, with the reason."""
    bad = too_short_or_long(samples, KEY, "t", config.min_samples, config.max_samples)
    has = present(samples).where("not (has_v or has_dist)").select("ride_id", F.lit("neither speed nor distance").alias("reason"))
    return bad.unionByName(has.join(bad, "ride_id", "left_anti"))


def prepare(samples: DataFrame, rides: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """The grid: a row a ride and second ``i`` with ``t``, channels, ``gap``, ``moving``, ``theta``, ``accel``, ``heading`` and ``curvature``.

    Optional channels that a ride lacks are null throughout; power and altitude
    are 0 then. Everything after the resampling is windows over one partitioning.
    """
    samples = cropped_samples(samples, rides, config)
    samples = samples.join(rejected(samples, config), "ride_id", "left_anti")
    has = present(samples)
    grid = resample(samples, KEY, "t", hold=HELD, zero=ZEROED, places=PLACES, tie="seq").join(has, "ride_id")
    from_speed = series.running_sum(F.when(F.col("i") > 0, F.greatest(F.col("v"), F.lit(0.0))).otherwise(0.0), RIDE)
    dist = F.when(F.col("has_dist"), series.running_max(F.col("dist"), RIDE)).otherwise(from_speed)
    grid = grid.withColumn("dist", dist)
    from_dist = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(RIDE.shifted(F.col("dist"), 1) - RIDE.shifted(F.col("dist"), -1), RIDE.shifted(F.col("t"), 1) - RIDE.shifted(F.col("t"), -1)), F.lit(0.0)))
    still = lambda x: F.when(F.col("gap"), 0.0).otherwise(F.greatest(x, F.lit(0.0)))
    grid = grid.withColumn("v", still(F.when(F.col("has_v"), F.col("v")).otherwise(from_dist))).withColumn("watts", still(F.col("watts")))
    grid = grid.withColumns({
        "moving": (F.col("v") > config.moving_speed) & ~F.col("gap"),
        "alt": series.centred_mean(F.col("alt"), RIDE, 9),
        "_v": series.centred_mean(F.col("v"), RIDE, 5),
        **{c: F.when(F.col(f"has_{c}"), F.col(c)) for c in ("lat", "lon", "hr", "cad", "temp")},
    })
    grid = series.range_slope(grid, RIDE, "alt", "dist", 30, 9, 0.25, "slope")
    accel = series.central_derivative(F.col("_v"), F.col("t"), RIDE)
    grid = grid.withColumns({
        "theta": F.atan("slope"),
        "accel": F.when(F.abs(accel) > 6, 0.0).otherwise(accel),
        "heading": F.when(F.col("has_lat"), series.heading(F.col("lat"), F.col("lon"), RIDE)).otherwise(0.0),
    })
    grid = grid.withColumn("_curve", series.curvature(F.col("heading"), F.col("dist"), RIDE))
    grid = grid.withColumn("curvature", F.when(F.col("has_lat"), series.centred_mean(F.col("_curve"), RIDE, 3)).otherwise(0.0))
    return grid.select("ride_id", "i", "t", *CHANNELS, "gap", "moving", "slope", "theta", "accel", "heading", "curvature")


def located() -> Column:
    """Whether a grid row has a place."""
    return F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~((F.col("lat") == 0) & (F.col("lon") == 0))


def markers(rides: DataFrame, samples: DataFrame, grid: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """``ride_id, marks``: grid indices of device laps, both ends included; null where fewer than four."""
    kept = cropped_samples(samples, rides, config)
    shift = samples.groupBy("ride_id").agg(F.min("t").alias("_t0")).join(kept.groupBy("ride_id").agg(F.min("t").alias("_t1")), "ride_id")
    size = grid.groupBy("ride_id").agg((F.max("i") + 1).alias("_n"))
    joined = rides.select("ride_id", "lap_times").join(shift, "ride_id").join(size, "ride_id")
    return joined.select("ride_id", marker_indices(F.col("lap_times"), F.col("_t1") - F.col("_t0"), F.col("_n")).alias("marks"))
