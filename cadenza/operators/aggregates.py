"""Aggregates with the exact definitions that reports rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import let


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def gathered_median(x: Column) -> Column:
    """``percentile(x, 0.5)`` for very many keys of few rows each: lists of values, where percentile keeps (and, beyond a few keys, writes
    out and reads again) a table of counts a key."""

    def middle(s: Column) -> Column:
        return 0.5 * F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + 0.5 * F.get(s, F.floor(F.size(s) / 2).cast("int"))

    return let(F.sort_array(F.collect_list(x.cast("double"))), middle)


def steady_mean(x: Column) -> Column:
    """Mean that does not depend on the order of rows: sums of doubles do in their last digits, which shows where means are compared or rounded.

    Ten decimals of each value are summed exactly, what is beyond them apart; values of 1e14 and more, and those that are not finite, wholly so.
    """
    head = x.try_cast("decimal(24,10)")
    rest = x - F.coalesce(head.cast("double"), F.lit(0.0))
    return F.try_divide(F.coalesce(F.sum(head).cast("double"), F.lit(0.0)) + F.sum(rest), F.count(x))


def spread(x: Column) -> Column:
    """Population standard deviation, 0 of fewer than two values."""
    return F.when(F.count(x) >= 2, F.stddev_pop(x)).otherwise(0.0)


def percentile(x: Column, p: float) -> Column:
    """Exact, interpolated at p * (n - 1)."""
    return F.percentile(x, F.lit(p))


def pick_ranked(df: DataFrame, keys: tuple[str, ...], value: str, share: float, out: str) -> DataFrame:
    """One row a key: the value at place ``floor(share * n)`` of the sorted values, from 0 on.

    With a share of 0.5 this is the upper median. Rows are ranked, not gathered.
    """
    known = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys)
    ranked = known.select(*keys, F.col(value).alias(out), F.row_number().over(w.orderBy(value)).alias("_at"), F.count(F.lit(1)).over(w).alias("_n"))
    return ranked.where(F.col("_at") == F.floor(F.lit(share) * F.col("_n")) + 1).drop("_at", "_n")


def fit_circle(df: DataFrame, keys: tuple[str, ...], x: str, y: str) -> DataFrame:
    """Least-squares circle of the points of each key: ``cx, cy, radius, n``; null if they lie on a line.

    Sums of moments about the centroid, in two aggregations.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    middle = known.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    joined = known.join(middle, list(keys)) if keys else known.crossJoin(middle)
    moved = joined.select(*keys, "_mx", "_my", (F.col(x) - F.col("_mx")).alias("u"), (F.col(y) - F.col("_my")).alias("v"))
    total = lambda e, name: F.sum(F.expr(e)).alias(name)
    m = moved.groupBy(*keys).agg(
        F.first("_mx").alias("_mx"),
        F.first("_my").alias("_my"),
        F.count(F.lit(1)).alias("n"),
        total("u * u", "uu"), total("v * v", "vv"), total("u * v", "uv"),
        total("u * (u * u + v * v)", "uz"), total("v * (u * u + v * v)", "vz"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    m = m.withColumn("_det", F.when(F.abs(det) > 1e-9, det))
    a = (F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv")) / (2 * F.col("_det"))
    b = (F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv")) / (2 * F.col("_det"))
    return m.select(*keys, (F.col("_mx") + a).alias("cx"), (F.col("_my") + b).alias("cy"), F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n")).alias("radius"), "n")


def exact_argmax(value: str, *order: Column) -> Column:
    """``value`` of the row that comes last in ``order``; make the order total."""
    return F.max_by(value, F.struct(*order))


def load_metrics(np: Column, avg: Column, seconds: Column, ftp: Column) -> list[Column]:
    """``intensity, variability, tss, kj`` from a normalised and a plain mean."""
    intensity = F.when(ftp > 0, np / ftp).otherwise(0.0)
    return [
        intensity.alias("intensity"),
        F.when(avg > 0, np / avg).otherwise(0.0).alias("variability"),
        F.when(ftp > 0, seconds * np * intensity / (ftp * 3600) * 100).otherwise(0.0).alias("tss"),
        (avg * seconds / 1000).alias("kj"),
    ]


def histogram(df: DataFrame, keys: tuple[str, ...], bin_column: str, bins: int, *aggregates: Column) -> DataFrame:
    """Aggregates of each bin 0 … bins - 1 of each key, empty ones too."""
    found = df.groupBy(*keys, bin_column).agg(*aggregates)
    every = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    every = every.withColumn(bin_column, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*keys, bin_column], "left")


def centred_scale(df: DataFrame, keys: tuple[str, ...], value: str, low: float = 0.05, high: float = 0.95, least: float = 0.05) -> DataFrame:
    """``keys, centre, half_span``: the median, and how far the outer quantiles lie from it, ``least`` at least."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, (low, 0.5, high)))).alias("q"))
    a, m, b = (F.get("q", F.lit(i)) for i in range(3))
    return q.select(*keys, m.alias("centre"), F.greatest(F.lit(least), m - a, b - m).alias("half_span"))


def pixel_means(df: DataFrame, keys: tuple[str, ...], at: str, value: str, pixels: int, out: str) -> DataFrame:
    """``keys, pixel, out, n``: means of a value in ``pixels`` columns of equal width; keys that have no width are left out."""
    spans = df.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b")).where("_b > _a")
    pixel = F.least(F.floor((F.col(at) - F.col("_a")) / (F.col("_b") - F.col("_a")) * pixels), F.lit(pixels - 1))
    return df.join(spans, list(keys)).groupBy(*keys, pixel.cast("long").alias("pixel")).agg(F.avg(value).alias(out), F.count(F.lit(1)).alias("n"))
