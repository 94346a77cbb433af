"""Exact ranks and quantiles of keys of any size.

Rows are sorted over all tasks by key and value and staged with their places.
How many rows of a key each task has, a row a key and task, tells where the
wanted ranks stand; only those rows are read again. Neither a key nor a value
that many rows share is ever in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]


def _at_ranks(df: DataFrame, keys: tuple[str, ...], value: str, wanted: dict[str, Callable[[Column], Column]], keep: Keep) -> DataFrame:
    """``keys, _n`` and, by name, the value at each wanted rank (from 0 on, a function of the key's size)."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value")).withColumn("_row", F.monotonically_increasing_id())
    order = [*keys, "_value", "_row"]
    placed = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    here = placed.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    by_key = Window.partitionBy(*keys)
    here = here.withColumns({"_before": F.sum("_c").over(by_key.orderBy("_task")) - F.col("_c"), "_n": F.sum("_c").over(by_key)})
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank")) for name, rank in wanted.items()))
    spots = here.withColumn("_r", F.explode(ranks)).where("_r.rank >= _before and _r.rank < _before + _c").select(*keys, "_n", "_r.name", (F.col("_first") + F.col("_r.rank") - F.col("_before")).alias("_at"))
    found = spots.join(placed.select("_at", "_value"), "_at")
    return found.groupBy(*keys, "_n").agg(*(F.max(F.when(F.col("name") == name, F.col("_value"))).alias(name) for name in wanted))


def ranked(df: DataFrame, keys: tuple[str, ...], value: str, shares: dict[str, float], keep: Keep) -> DataFrame:
    """One row a key: by name, the value at place ``floor(share * n)`` of the sorted values, from 0 on; with 0.5 the upper median."""
    wanted = {name: lambda n, share=share: F.least(F.floor(F.lit(share) * n), n - 1) for name, share in shares.items()}
    return _at_ranks(df, keys, value, wanted, keep).drop("_n")


def quantiles(df: DataFrame, keys: tuple[str, ...], value: str, shares: dict[str, float], keep: Keep) -> DataFrame:
    """One row a key: by name, the value at ``share * (n - 1)`` of the sorted values, interpolated."""
    at = lambda n, share: F.lit(share) * (n - 1)
    low = {f"_low_{name}": lambda n, share=share: F.floor(at(n, share)) for name, share in shares.items()}
    high = {f"_high_{name}": lambda n, share=share: F.ceil(at(n, share)) for name, share in shares.items()}
    found = _at_ranks(df, keys, value, low | high, keep)

    def between(name: str, share: float) -> Column:
        a, b = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return a + (b - a) * (at(F.col("_n"), share) - F.floor(at(F.col("_n"), share)))

    return found.select(*keys, *(between(name, share).alias(name) for name, share in shares.items()))
