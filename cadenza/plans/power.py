"""What a lone rider would have needed each second, the draft ratio, and the reserve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.physics import apparent_wind, required_power
from cadenza.operators.folds import reserve_balance
from cadenza.operators.series import RIDE, centred_mean


def ride_series(grid: DataFrame, wind: DataFrame, config: ModelConfig) -> DataFrame:
    """grid with ``solo_raw, solo, watts_s, solo_s, ratio, yaw`` and ``balance, drained, overdrawn, tau``.

    ``ratio`` is smoothed actual over smoothed needed power, null where little is
    needed. Needed power stays negative until it is smoothed: braking counts.
    """
    fixed = wind.select("ride_id", F.col("we").alias("_we"), F.col("wn").alias("_wn"), "cda")
    df = grid.join(fixed, "ride_id").withColumns({"_e": F.coalesce("_we", "we", F.lit(0.0)), "_n": F.coalesce("_wn", "wn", F.lit(0.0))})
    state = [F.col(c) for c in ("v", "theta", "accel", "heading", "_e", "_n", "mass")]
    solo = required_power(*state, F.lit(config.crr), F.col("cda"), F.col("rho"), F.lit(config.efficiency), F.lit(config.rotating_mass), F.lit(config.yaw_factor))
    df = df.withColumns({"solo_raw": solo, "yaw": apparent_wind(F.col("v"), F.col("heading"), F.col("_e"), F.col("_n"))["yaw"]})
    df = df.withColumns({"solo": F.greatest("solo_raw", F.lit(0.0)), "watts_s": centred_mean(F.col("watts"), RIDE, config.ratio_window), "solo_s": centred_mean(F.col("solo_raw"), RIDE, config.ratio_window)})
    df = df.withColumn("ratio", F.when(F.col("solo_s") > config.ratio_floor, F.col("watts_s") / F.col("solo_s")))
    return reserve_balance(df.drop("_we", "_wn", "_e", "_n"), RIDE, "watts", "cp", "w_prime")
