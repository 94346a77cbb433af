"""Laps cut into sectors, each judged against the rest of its own lap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import ModelConfig
from cadenza.functions.scalars import clamp
from cadenza.operators.aggregates import pick_ranked, spread
from cadenza.plans.laps import lap_lengths, lap_samples

#: Fixed value: how far above its lap's median a sector counts as worse.
WORSE = 0.02


def judge_cells(cells: DataFrame, lap: tuple[str, ...], sector: str, ratio: str) -> DataFrame:
    """cells with ``lap_median`` (the upper one), ``worse`` and ``worst``: the highest of its lap, the first sector on ties."""
    middle = pick_ranked(cells, lap, ratio, 0.5, "lap_median")
    place = F.row_number().over(Window.partitionBy(*lap).orderBy(F.col(ratio).desc_nulls_last(), sector))
    judged = cells.withColumn("worst", (place == 1) & F.col(ratio).isNotNull()).join(middle, list(lap), "left")
    return judged.withColumn("worse", F.coalesce(F.col(ratio) > F.col("lap_median") + WORSE, F.lit(False)))


def total_cells(cells: DataFrame, keys: tuple[str, ...], sector: str, ratio: str, seconds: str, *more: str) -> DataFrame:
    """One row a sector over all laps; the median, so that one attack does not mark the whole stretch."""
    r = F.col(ratio)
    times = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    t = cells.groupBy(*keys, sector, *more).agg(
        F.percentile(r, F.lit(0.5)).alias("ratio"), F.avg(r).alias("mean"), spread(r).alias("sd"), F.sum(seconds).alias("seconds"), F.count(r).alias("laps"),
        times("worse").alias("laps_worse"), times("worst").alias("laps_worst"),
    )
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("laps")), F.lit(0.0))
    return t.withColumns({"worse_share": share("laps_worse"), "worst_share": share("laps_worst")})


def standouts(totals: DataFrame, keys: tuple[str, ...], sector: str) -> DataFrame:
    """``keys, leak, dearest, cheapest``: the sector most often worst, with the highest and with the lowest median."""
    t = totals.where("laps >= 2 and ratio is not null")
    return t.groupBy(*keys).agg(F.max_by(sector, F.struct("laps_worst", "ratio")).alias("leak"), F.max_by(sector, "ratio").alias("dearest"), F.min_by(sector, "ratio").alias("cheapest"))


def bounds_of(turns: DataFrame, lengths: DataFrame, config: ModelConfig) -> DataFrame:
    """``ride_id, bounds, labels`` as arrays: from corner to corner, or equal slices of rides with fewer than three corners."""
    c = turns.groupBy("ride_id").agg(F.sort_array(F.collect_list(F.struct(clamp(F.col("lap_offset"), 0.0, 1.0).alias("at"), "number"))).alias("t")).where(F.size("t") >= 3)
    after = F.concat(F.slice("t", 2, F.size("t")), F.slice("t", 1, 1))
    label = F.zip_with("t", after, lambda a, b: F.concat(F.lit("T"), a["number"].cast("string"), F.lit("→T"), b["number"].cast("string")))
    corners = c.select("ride_id", F.col("t.at").alias("bounds"), label.alias("labels"))
    k = config.sector_count
    equal = F.array(*(F.lit(j / k) for j in range(k))), F.array(*(F.lit(f"{int(100 * j / k + 0.5)}–{int(100 * (j + 1) / k + 0.5)}%") for j in range(k)))
    every = lengths.select("ride_id").distinct().join(corners, "ride_id", "left")
    return every.select("ride_id", F.coalesce("bounds", equal[0]).alias("bounds"), F.coalesce("labels", equal[1]).alias("labels"))


def build_sectors(series: DataFrame, laps: DataFrame, turns: DataFrame, config: ModelConfig = ModelConfig()) -> tuple[DataFrame, DataFrame]:
    """sector_cells and sector_totals of rides with two laps or more. What comes before the first corner belongs to the last sector."""
    real = laps.where("source <> 'none'")
    samples = lap_samples(series.select("ride_id", "i", "dist", "watts", "ratio", "moving"), real)
    lengths = lap_lengths(samples)
    typical = lengths.groupBy("ride_id").agg(F.percentile("len", F.lit(0.5)).alias("lap_len"), F.count(F.lit(1)).alias("_laps")).where("_laps >= 2 and lap_len > 0")
    cut = bounds_of(turns, lengths, config)
    s = samples.where("moving").join(lengths.select("ride_id", "lap", "d0"), ["ride_id", "lap"]).join(typical, "ride_id").join(cut.select("ride_id", "bounds"), "ride_id")
    f = clamp((F.col("dist") - F.col("d0")) / F.col("lap_len"), 0.0, 1.0)
    passed = F.size(F.filter("bounds", lambda b: b <= F.col("_f")))
    s = s.withColumn("_f", f).withColumn("sector", F.when(passed == 0, F.size("bounds") - 1).otherwise(passed - 1).cast("long"))
    found = s.groupBy("ride_id", "lap", "sector").agg(F.avg("ratio").alias("ratio"), F.avg("watts").alias("watts"), F.count(F.lit(1)).alias("seconds"))
    every = lengths.join(typical.select("ride_id"), "ride_id").join(cut, "ride_id").select("ride_id", "lap", F.posexplode("labels").alias("sector", "label")).withColumn("sector", F.col("sector").cast("long"))
    cells = every.join(found, ["ride_id", "lap", "sector"], "left").withColumn("seconds", F.coalesce("seconds", F.lit(0)))
    cells = judge_cells(cells, ("ride_id", "lap"), "sector", "ratio")
    return cells, total_cells(cells, ("ride_id",), "sector", "ratio", "seconds", "label")
