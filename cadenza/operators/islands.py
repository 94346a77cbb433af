"""Gaps and islands: runs of rows that meet a condition, sessions, merged regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.series import Series


def with_runs(df: DataFrame, s: Series, flag: Column, out: str = "run") -> DataFrame:
    """Rows for which flag holds, each with the number of its run of neighbouring rows, from 1 on."""
    df = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    begins = F.col("_flag") & ~F.coalesce(F.lag("_flag").over(s.window), F.lit(False))
    return df.withColumn(out, F.sum(begins.cast("long")).over(s.so_far)).where("_flag").drop("_flag")


def runs(df: DataFrame, s: Series, flag: Column, *aggregates: Column, least: int = 1) -> DataFrame:
    """``keys, run, i0, i1, size`` and aggregates of runs of at least ``least`` rows; i0 and i1 in the order column."""
    at = s.order[0]
    grouped = with_runs(df, s, flag).groupBy(*s.keys, "run").agg(F.min(at).alias("i0"), F.max(at).alias("i1"), F.count(F.lit(1)).alias("size"), *aggregates)
    return grouped.where(F.col("size") >= least)


def sessions(df: DataFrame, s: Series, gap: Column, out: str = "session") -> DataFrame:
    """df with the number of each row's session: a new one begins where ``gap`` (of a row to the one before) holds."""
    return df.withColumn(out, F.sum(F.coalesce(gap, F.lit(False)).cast("long")).over(s.so_far) + 1)


def merge_regions(regions: DataFrame, keys: tuple[str, ...], within: int) -> DataFrame:
    """Regions ``i0, i1`` with those joined that begin at most ``within`` after the end of the one before.

    ``i1`` is exclusive of the next region's rows; regions of a key must not overlap.
    """
    w = Window.partitionBy(*keys).orderBy("i0")
    apart = F.coalesce(F.col("i0") - F.lag("i1").over(w) > within, F.lit(False))
    grouped = regions.withColumn("_group", F.sum(apart.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_group").agg(F.min("i0").alias("i0"), F.max("i1").alias("i1")).drop("_group")


def closed_runs(df: DataFrame, s: Series, sign: Column, seed: Column) -> DataFrame:
    """Rows of runs on a closed series in which ``sign`` (1 or -1, else 0) stays the same and some row is a seed.

    Runs that touch both ends are one. Adds ``run`` and ``unrolled``: the order
    column, less the series' length for the part of such a run that stands at
    the end, so that each run is a stretch of neighbouring numbers.
    """
    at = s.order[0]
    df = df.withColumns({"_sign": sign, "_seed": F.coalesce(seed, F.lit(False)), "_n": F.max(at).over(s.whole) + 1})
    begins = F.coalesce(F.col("_sign") != F.lag("_sign").over(s.window), F.lit(False))
    df = df.withColumn("run", F.sum(begins.cast("long")).over(s.so_far))
    df = df.withColumns({"_final": F.max("run").over(s.whole), "_one": F.min_by("_sign", at).over(s.whole), "_end": F.max_by("_sign", at).over(s.whole)})
    wraps = (F.col("run") == F.col("_final")) & (F.col("_final") > 0) & (F.col("_one") == F.col("_end"))
    df = df.withColumn("unrolled", F.when(wraps, F.col(at) - F.col("_n")).otherwise(F.col(at))).withColumn("run", F.when(wraps, 0).otherwise(F.col("run")))
    seeded = F.max("_seed").over(Window.partitionBy(*s.keys, "run"))
    return df.where("_sign <> 0").withColumn("_seeded", seeded).where("_seeded").drop("_seed", "_seeded", "_n", "_final", "_one", "_end").withColumnRenamed("_sign", "sign")
