"""Reports of laps, bearings, whole rides, finales, heart rate, shape and fitness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.wind import COMPASS, compass_bin
from cadenza.operators.aggregates import histogram, load_metrics, percentile, spread
from cadenza.operators.folds import reserve_stats
from cadenza.operators.series import RIDE, Series, gain, power_mean
from cadenza.plans.laps import lap_samples

#: Lap slopes beyond ±0.6 % count as a trend; seconds of heart rate that a report needs; beats that are real.
TREND, LEAST_BEATS, REAL_BEAT, PEDALLING = 0.6, 240, 30, 5


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def _pct(part: Column, whole: Column) -> Column:
    return F.try_divide(100.0 * part, whole)


def _moving_load(df: DataFrame, s: Series, *extra: Column) -> DataFrame:
    """Averages, normalised power and load of the moving seconds, closed up over stops."""
    return power_mean(df.where("moving"), s, "watts", extra=[F.avg("watts").alias("avg"), F.count(F.lit(1)).alias("seconds"), F.first("ftp").alias("ftp"), *extra])


def exposure(config: ModelConfig) -> list[Column]:
    """Shares of exposed and sheltered seconds, and the median of the ratio."""
    r = F.col("ratio")
    return [_pct(_count(r >= config.exposed_at), F.count(r)).alias("exposed"), _pct(_count(r <= config.sheltered_at), F.count(r)).alias("sheltered"), percentile(r, 0.5).alias("median")]


def summarise_laps(series: DataFrame, laps: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    samples = lap_samples(series.select("ride_id", "i", "dist", "watts", "v", "ratio", "solo", "moving", "balance", "ftp"), laps.where("source <> 'none'"))
    ends = samples.groupBy("ride_id", "lap", "i0", "i1", "source").agg((F.max("dist") - F.min("dist")).alias("distance"), (F.max_by("balance", "i") / 1000).alias("wbal_end"))
    saved = (F.sum(F.greatest(F.col("solo") - F.col("watts"), F.lit(0.0))) / 1000).alias("saved_kj")
    m = _moving_load(samples, Series(("ride_id", "lap"), ("i",)), F.max("v").alias("max_speed"), saved, *exposure(config))
    m = m.select("*", *load_metrics(F.col("np"), F.col("avg"), F.col("seconds"), F.col("ftp")))
    out = ends.join(m, ["ride_id", "lap"]).withColumn("avg_speed", F.try_divide(F.col("distance"), F.col("seconds")))
    return out.select("ride_id", "lap", "i0", "i1", "source", "seconds", "distance", "avg", "np", F.col("variability").alias("vi"), "kj", "max_speed", "avg_speed", "exposed", "sheltered", "median", "saved_kj", "wbal_end")


def exposure_by_heading(series: DataFrame) -> DataFrame:
    """Sixteen bearings of each ride, ridden or not."""
    s = series.where("moving and ratio is not null").withColumn("bin", compass_bin(F.degrees("heading")))
    h = histogram(s, ("ride_id",), "bin", 16, F.count(F.lit(1)).alias("seconds"), percentile(F.col("ratio"), 0.5).alias("ratio"), percentile(F.col("ratio"), 0.85).alias("p85"))
    return h.select("ride_id", "bin", (F.col("bin") * 22.5).alias("dir"), F.element_at(F.array(*map(F.lit, COMPASS)), F.col("bin") + 1).alias("label"), F.coalesce("seconds", F.lit(0)).alias("seconds"), "ratio", "p85")


def elevation(series: DataFrame, laps: DataFrame) -> DataFrame:
    """Mean gradient, and per lap what the altitude trace nets, drifts and climbs."""
    s = series.withColumn("_up", gain(F.col("alt"), RIDE))
    grade = s.groupBy("ride_id").agg(F.coalesce(_pct(F.sum(F.when(F.col("moving"), F.abs(F.sin("theta")) * F.col("v"))), F.sum(F.when(F.col("moving"), F.col("v")))), F.lit(0.0)).alias("mean_abs_grade"))
    real = laps.where("source <> 'none'")
    at = lambda side: s.select("ride_id", F.col("i").alias(side), F.col("alt").alias(f"_{side}"))
    nets = real.join(at("i0"), ["ride_id", "i0"]).join(at("i1"), ["ride_id", "i1"]).groupBy("ride_id").agg(
        percentile(F.col("_i1") - F.col("_i0"), 0.5).alias("net_per_lap"),
        ((F.max_by("_i1", "lap") - F.min_by("_i0", "lap")) / F.count(F.lit(1))).alias("drift"),
        F.min("i0").alias("_a"), F.max("i1").alias("_b"), F.count(F.lit(1)).alias("_laps"),
    )
    climbed = s.select("ride_id", "i", "_up").join(nets, "ride_id").where("i > _a and i <= _b").groupBy("ride_id").agg((F.sum("_up") / F.first("_laps")).alias("gain_per_lap"))
    e = grade.join(nets.select("ride_id", "net_per_lap", "drift"), "ride_id", "left").join(climbed, "ride_id", "left")
    drifts, hilly = F.coalesce(F.abs("drift") > 1.5, F.lit(False)), F.col("mean_abs_grade") > 1.5
    note = F.when(drifts, F.format_string("altitude changes by %.1f m from one lap to the next, which slopes cannot explain", "drift")).when(hilly, F.format_string("mean gradient is %.1f%%, so errors of altitude weigh on the drag area", "mean_abs_grade"))
    return e.select("ride_id", F.struct("net_per_lap", "drift", "gain_per_lap", "mean_abs_grade", (~drifts).alias("trustworthy"), hilly.alias("hilly"), note.alias("note")).alias("elevation"))


def summarise(series: DataFrame, laps: DataFrame, turns: DataFrame, surges: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """One row a ride. ``turns`` are priced; matches are surges that are no corner exits."""
    solo = F.col("solo")
    pedals = F.col("cad") > PEDALLING
    m = _moving_load(
        series, RIDE, F.sum(F.greatest(solo - F.col("watts"), F.lit(0.0))).alias("_saved"), F.sum(solo).alias("_solo"), *exposure(config), percentile(F.col("ratio"), 0.85).alias("p85"),
        F.when(F.count("cad") > 0, F.struct(F.avg(F.when(pedals, F.col("cad"))).alias("rpm"), (100 - F.try_divide(100.0 * _count(pedals), F.count(F.lit(1)))).alias("coast_pct"))).alias("cadence"),
    )
    m = m.select("*", *load_metrics(F.col("np"), F.col("avg"), F.col("seconds"), F.col("ftp")))
    whole = series.groupBy("ride_id").agg((F.max("dist") - F.min("dist")).alias("distance"), F.max("v").alias("max_speed"), F.first("w_prime").alias("w_prime"))
    n_laps = laps.groupBy("ride_id").agg(_count(F.col("source") != "none").alias("laps"), F.first("source").alias("lap_source"))
    t = turns.groupBy("ride_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("exit_kj_total").alias("corner_kj"))
    match, exits = ~F.col("corner_exit"), F.col("corner_exit")
    kj = lambda c: F.coalesce(F.sum(F.when(c, F.col("match_kj"))), F.lit(0.0))
    u = surges.groupBy("ride_id").agg(_count(match).alias("surges"), kj(match).alias("match_kj"), _count(match & F.col("from_shelter")).alias("surges_from_shelter"), _count(exits).alias("corner_exit_surges"), kj(exits).alias("corner_exit_kj"), F.count(F.lit(1)).alias("all_surges"))
    w = reserve_stats(series, RIDE)
    out = whole.join(m, "ride_id", "left").join(n_laps, "ride_id", "left").join(t, "ride_id", "left").join(u, "ride_id", "left").join(w, "ride_id").join(elevation(series, laps), "ride_id")
    none = lambda *names: {c: F.coalesce(c, F.lit(0)) for c in names}
    out = out.withColumns(none("laps", "turns", "corner_kj", "surges", "match_kj", "surges_from_shelter", "corner_exit_surges", "corner_exit_kj", "all_surges", "seconds"))
    return out.select(
        "ride_id", F.col("seconds").alias("moving_seconds"), "distance", F.coalesce(F.try_divide(F.col("distance"), F.col("seconds")), F.lit(0.0)).alias("avg_speed"), "max_speed", "avg", "np", F.col("variability").alias("vi"), "tss", "intensity", "kj",
        "exposed", "sheltered", "median", "p85", (F.col("_saved") / 1000).alias("saved_kj"), (F.col("_solo") / 1000).alias("solo_kj"), _pct(F.col("_saved"), F.nullif("_solo", F.lit(0.0))).alias("saved_pct"),
        "laps", "lap_source", "turns", "corner_kj", "surges", "match_kj", "surges_from_shelter", "corner_exit_surges", "corner_exit_kj", "all_surges",
        (F.col("min_bal") / 1000).alias("wbal_min"), _pct(F.col("min_bal"), F.nullif("w_prime", F.lit(0.0))).alias("wbal_min_pct"), (F.col("spent") / 1000).alias("wbal_spent"), (F.col("overdraft") / 1000).alias("wbal_overdraft"),
        F.col("depleted_seconds").alias("wbal_empty_seconds"), F.col("tau").alias("wbal_tau"), "elevation", "cadence",
    )


def summarise_finale(series: DataFrame, laps: DataFrame, surges: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """From the last three laps on, or the last five minutes, to the end of the recording."""
    n = config.finale_laps
    real = laps.where("source <> 'none'").withColumn("_back", F.row_number().over(Window.partitionBy("ride_id").orderBy(F.col("lap").desc())))
    by_lap = real.groupBy("ride_id").agg(F.max(F.when(F.col("_back") == n, F.col("i0"))).alias("_lap0"), F.count(F.lit(1)).alias("_laps"))
    last = series.groupBy("ride_id").agg(F.max("i").alias("_last")).join(by_lap, "ride_id", "left")
    laps_count = F.coalesce(F.col("_laps") >= n + 1, F.lit(False))
    last = last.select("ride_id", F.when(laps_count, F.col("_lap0")).otherwise(F.greatest(F.col("_last") - config.finale_seconds, F.lit(0))).alias("i0"), F.when(laps_count, F.lit(f"last {n} laps")).otherwise("last 5 min").alias("basis"))
    s = series.join(last, "ride_id").where("i >= i0")
    rides = s.groupBy("ride_id", "i0", "basis").agg(
        _count(F.col("moving")).cast("double").alias("seconds"), F.avg(F.when(F.col("moving"), F.col("watts"))).alias("avg"),
        _pct(_count(F.col("moving") & (F.col("ratio") >= config.exposed_at)), _count(F.col("moving") & F.col("ratio").isNotNull())).alias("exposed"),
        (F.min_by("balance", "i") / 1000).alias("wbal_at_start"), _pct(F.min_by("balance", "i"), F.nullif(F.first("w_prime"), F.lit(0.0))).alias("wbal_at_start_pct"),
    )
    m = surges.where("not corner_exit").join(last.select("ride_id", F.col("i0").alias("_f")), "ride_id").withColumn("_in", F.col("i0") >= F.col("_f"))
    kj = lambda c: F.coalesce(F.sum(F.when(c, F.col("match_kj"))), F.lit(0.0))
    m = m.groupBy("ride_id").agg(_count(F.col("_in")).alias("surges"), kj(F.col("_in")).alias("surge_kj"), _count(~F.col("_in")).alias("matches_burned_before"), kj(~F.col("_in")).alias("match_kj_before"))
    out = rides.join(m, "ride_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("surges", "surge_kj", "matches_burned_before", "match_kj_before")})


def summarise_hr(series: DataFrame) -> DataFrame:
    """Heart rate, and how far power per beat fell from the first to the second half; rides with four minutes of it or more."""
    s = series.where((F.col("moving")) & (F.col("hr") > REAL_BEAT)).withColumn("_n", F.count(F.lit(1)).over(RIDE.whole)).where(F.col("_n") >= LEAST_BEATS).drop("_n")
    halves = half_split(s, RIDE, "watts", "hr").withColumnsRenamed({"first_half": "first_half_pwhr", "second_half": "second_half_pwhr"})
    h = s.groupBy("ride_id").agg(F.avg("hr").alias("avg"), F.max("hr").alias("max"), percentile(F.col("hr"), 0.95).alias("p95"), F.count(F.lit(1)).cast("double").alias("seconds"))
    return h.join(halves, "ride_id")


def half_split(df: DataFrame, s: Series, value: str, per: str) -> DataFrame:
    """``keys, first_half, second_half, decoupling``: normalised value over the mean of ``per`` in each half of a series' rows, and how far it falls in percent."""
    df = df.withColumn("_early", F.row_number().over(s.window) <= F.floor(F.count(F.lit(1)).over(s.whole) / 2))
    q = F.try_divide(F.col("np"), F.col("_per"))
    halves = power_mean(df, Series((*s.keys, "_early"), s.order), value, extra=[F.avg(per).alias("_per")])
    halves = halves.groupBy(*s.keys).agg(F.max(F.when(F.col("_early"), q)).alias("first_half"), F.max(F.when(~F.col("_early"), q)).alias("second_half"))
    return halves.withColumn("decoupling", _pct(F.col("first_half") - F.col("second_half"), F.nullif("first_half", F.lit(0.0))))


def shape_of(laps: DataFrame, keys: tuple[str, ...], lap: str, value: str, least: int = 5) -> DataFrame:
    """Whether lap values build or fade, and which lap stands out; keys with ``least`` laps or more."""
    s = Series(keys, (lap,))
    n = F.count(F.lit(1)).over(s.whole)
    df = laps.withColumns({"_k": s.place, "_n": n}).where(F.col("_n") >= least)
    third = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    v = F.col(value)
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("laps"), F.avg(v).alias("avg_np"), spread(v).alias("sd"), F.regr_slope(v, F.col("_k")).alias("_slope"),
        F.max_by(lap, F.struct(v, -F.col("_k"))).alias("hardest_lap"), F.max(v).alias("hardest_np"), F.max_by(lap, "_k").alias("finish_lap"), F.max_by(value, "_k").alias("finish_np"),
        F.avg(F.when(F.col("_k") < third, v)).alias("opening_np"), F.avg(F.when(F.col("_k") >= F.col("_n") - third, v)).alias("closing_np"),
    ).where("avg_np > 0")
    slope = F.coalesce(F.col("_slope"), F.lit(0.0)) / F.col("avg_np") * 100
    over = lambda c: (F.col(c) - F.col("avg_np")) / F.col("avg_np") * 100
    return g.withColumns({
        "slope_pct": slope,
        "trend": F.when(slope < -TREND, "fading").when(slope > TREND, "building").otherwise("steady"),
        "opening_vs_closing_pct": _pct(F.col("opening_np") - F.col("closing_np"), F.nullif("closing_np", F.lit(0.0))),
        "hardest_over_pct": over("hardest_np"), "hardest_z": F.coalesce(F.try_divide(F.col("hardest_np") - F.col("avg_np"), F.nullif("sd", F.lit(0.0))), F.lit(0.0)),
        "finish_over_pct": over("finish_np"), "finish_is_hardest": F.col("hardest_lap") == F.col("finish_lap"),
    }).drop("_slope")


def race_shape(lap_rows: DataFrame) -> DataFrame:
    return shape_of(lap_rows, ("ride_id",), "lap", "np")


def check_fitness(summary: DataFrame, settings: DataFrame) -> DataFrame:
    """Whether critical power and reserve can be right: normalised power above it, or a reserve that is empty most of the time, can't."""
    j = summary.join(settings.select("ride_id", "cp", "w_prime"), "ride_id").where("np > 0 and cp > 0")
    empty = F.coalesce(F.try_divide(F.col("wbal_empty_seconds"), F.col("moving_seconds")), F.lit(0.0))
    impossible, pinned = F.col("np") > F.col("cp"), F.col("empty_frac") > 0.5
    message = F.when(impossible, F.format_string("Critical power of %.0f W is below the normalised power of the ride, %.0f W", "cp", "np")).when(
        pinned, F.format_string("The reserve is at zero in %.0f%% of the seconds; %.0f W of critical power or %.1f kJ of reserve must be too little", F.col("empty_frac") * 100, F.col("cp"), F.col("w_prime") / 1000)
    )
    return j.withColumn("empty_frac", empty).select(
        "ride_id", (~impossible & ~pinned).alias("ok"), impossible.alias("impossible"), pinned.alias("pinned"), "empty_frac", "np", "cp",
        F.when(impossible | pinned, F.floor(F.col("np") * 1.02 + 0.5)).alias("suggested_cp"), F.col("wbal_overdraft").alias("overdraft_kj"), message.alias("message"),
    )
