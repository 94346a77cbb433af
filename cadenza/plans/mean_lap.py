"""The median lap of a circuit: a closed line of points about two metres apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.geo import DEGREE_M
from cadenza.functions.scalars import angle_delta
from cadenza.operators.aggregates import gathered_median
from cadenza.operators.series import Series, circular_mean, with_wrapped_edges
from cadenza.plans.laps import lap_lengths, lap_samples

STEP, LEAST, MOST, SHORTEST = 2.0, 48, 4000, 150.0
LINE = Series(("ride_id",), ("j",))
_MEASURED = ("lat", "lon", "v", "watts")


def mean_lap(grid: DataFrame, laps: DataFrame) -> DataFrame:
    """``ride_id, j, s, lat, lon, v, watts, x, y, heading, curvature, n, lap_len, laps`` of rides with three laps or more.

    Laps are laid over each other by the share of their own length. Each step
    between two seconds is exploded into the points it passes.
    """
    located = grid.where("lat is not null").select("ride_id", "i", "dist", *_MEASURED)
    samples = lap_samples(located, laps.where("source <> 'none'"))
    lengths = lap_lengths(samples)
    sizes = lengths.groupBy("ride_id").agg(F.percentile("len", F.lit(0.5)).alias("lap_len"), F.count(F.lit(1)).alias("laps")).where((F.col("laps") >= 3) & (F.col("lap_len") > SHORTEST))
    sizes = sizes.withColumn("n", F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(F.col("lap_len") / STEP + 0.5))).cast("long"))
    w = Window.partitionBy("ride_id", "lap").orderBy("i")
    steps = samples.drop("i1", "source").join(lengths.where("len > 0").select("ride_id", "lap", "d0", "len"), ["ride_id", "lap"]).join(sizes.select("ride_id", "n"), "ride_id")
    steps = steps.withColumn("pos", (F.col("dist") - F.col("d0")) / F.col("len") * F.col("n"))
    steps = steps.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("pos", *_MEASURED)}).where("next_pos is not null")
    first = F.when(F.col("i") == F.col("i0"), 0).otherwise(F.floor("pos") + 1).cast("long")
    steps = steps.withColumns({"_a": first, "_b": F.least(F.floor("next_pos"), F.col("n") - 1).cast("long")}).where("_a <= _b")
    steps = steps.where("lat <> 0 or next_lat <> 0").withColumn("j", F.explode(F.sequence("_a", "_b")))
    share = F.coalesce(F.try_divide(F.col("j") - F.col("pos"), F.col("next_pos") - F.col("pos")), F.lit(0.0))
    at = steps.select("ride_id", "j", *((F.col(c) + (F.col(f"next_{c}") - F.col(c)) * share).alias(c) for c in _MEASURED))
    line = stacked(at, ("ride_id",), "j", list(_MEASURED), 3).join(sizes, "ride_id")
    line = line.where(F.col("sound") & (F.col("places") == F.col("n"))).drop("sound", "places", "passes")
    return shaped(line)


def stacked(passes: DataFrame, keys: tuple[str, ...], place: str, values: list[str], least: int) -> DataFrame:
    """Medians of the values at each place of a key over all passes, how many ``passes`` and ``places`` there are, and whether
    every place has ``least`` passes (``sound``)."""
    line = passes.groupBy(*keys, place).agg(*(gathered_median(F.col(c)).alias(c) for c in values), F.count(F.lit(1)).alias("passes"))
    whole = Window.partitionBy(*keys)
    return line.withColumns({"sound": F.min("passes").over(whole) >= least, "places": F.count(F.lit(1)).over(whole)})


def shaped(line: DataFrame) -> DataFrame:
    """line with distance, planar coordinates, heading and curvature around the lap."""
    lat0, lon0 = (F.min_by(c, "j").over(LINE.whole) for c in ("lat", "lon"))
    line = line.withColumns({
        "s": F.col("j") / F.col("n") * F.col("lap_len"),
        "x": (F.col("lon") - lon0) * DEGREE_M * F.cos(F.radians(lat0)),
        "y": (F.col("lat") - lat0) * DEGREE_M,
    })
    reach = int(5 / STEP + 0.5)  # five metres
    around = Series(("ride_id",), ("_at",)).window
    both = lambda c: F.lead(c, reach).over(around) - F.lag(c, reach).over(around)
    line = with_wrapped_edges(line, LINE, reach).withColumn("heading", F.atan2(both("x"), both("y"))).where("_own").drop("_own", "_at")
    turn = angle_delta(F.lag("heading", reach).over(around), F.lead("heading", reach).over(around)) / (2 * reach * STEP)
    line = with_wrapped_edges(line, LINE, reach).withColumn("_curve", turn).where("_own").drop("_own", "_at")
    return circular_mean(line, LINE, "_curve", 3, "curvature").drop("_curve")


def fingerprint(line: DataFrame) -> DataFrame:
    """``ride_id, lat, lon, lap_len``: the middle of a circuit and its length."""
    return line.groupBy("ride_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.first("lap_len").alias("lap_len"))
