"""Steps that depend on all steps before them, in bounded memory.

``fold_sorted`` deals the series to partitions once, sorts them there and walks
through Arrow batches with a small state, so no series is ever held whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.operators.series import Series

#: Takes the columns of neighbouring rows of one series as lists, returns the new columns as lists.
Step = Callable[[dict[str, list]], dict[str, list]]


def fold_sorted(df: DataFrame, s: Series, read: list[str], outputs: str, start: Callable[[], Step]) -> DataFrame:
    """df with the columns ``outputs`` that ``start()`` of each series computes from ``read``, row after row."""
    spark = df.sparkSession
    added = spark.createDataFrame([], outputs).schema
    names = added.fieldNames()
    df = df.drop(*names)
    schema = StructType([*df.schema.fields, *added.fields])
    kinds = [pa.field(f.name, {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}[f.dataType.simpleString()]) for f in added]
    keys = list(s.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            columns = {c: batch.column(c).to_pylist() for c in read}
            at = 0
            for key, rows in groupby(zip(*(batch.column(k).to_pylist() for k in keys)) if keys else [()] * batch.num_rows):
                if step is None or key != now:
                    now, step = key, start()
                end = at + sum(1 for _ in rows)
                for name, values in step({c: v[at:end] for c, v in columns.items()}).items():
                    out[name] += values
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[f.name], f.type) for f in kinds)], names=[*batch.schema.names, *names])

    placed = df.repartition(*keys) if keys else df.coalesce(1)
    return placed.sortWithinPartitions(*keys, *s.order).mapInArrow(run, schema)


def spaced(positions: Iterable[float | None], least: float, last: float | None = None) -> list[bool]:
    """Which positions lie more than ``least`` after the last one kept; the first known one is kept."""
    out = []
    for x in positions:
        keep = x is not None and (last is None or x - last > least)
        last = x if keep else last
        out.append(keep)
    return out


def spacing_filter(df: DataFrame, s: Series, position: str, least: float) -> DataFrame:
    """Rows that lie more than ``least`` after the last row that was kept; the first is kept."""

    def start() -> Step:
        last: list[float] = []

        def step(columns: dict[str, list]) -> dict[str, list]:
            kept = spaced(columns[position], least, last[0] if last else None)
            last[:] = ([x for x, k in zip(columns[position], kept) if k] or last)[-1:]
            return {"_kept": kept}

        return step

    return fold_sorted(df, s, [position], "_kept boolean", start).where("_kept").drop("_kept")


def reserve_balance(df: DataFrame, s: Series, value: str, threshold: str, capacity: str, seconds: float = 1.0) -> DataFrame:
    """df with ``balance``, ``drained`` and ``overdrawn`` of a reserve that values above the threshold drain.

    Below the threshold it refills towards its capacity with the time constant
    546 exp(-0.01 d) + 316, where d is the series' mean shortfall. What is
    taken from an empty reserve is overdrawn.
    """
    short = F.when(F.coalesce(F.col(value), F.lit(0.0)) < F.col(threshold), F.col(threshold) - F.coalesce(F.col(value), F.lit(0.0)))
    tau = F.lit(546.0) * F.exp(-0.01 * F.coalesce(F.avg(short).over(s.whole), F.lit(0.0))) + 316.0
    df = df.withColumn("tau", tau)

    return fold_sorted(df, s, [value, threshold, capacity, "tau"], "balance double, drained double, overdrawn double", lambda: reserve_step(value, threshold, capacity, seconds))


def reserve_step(value: str, threshold: str, capacity: str, seconds: float, first: str | None = None) -> Step:
    """Walks a reserve that begins full, or with what the column ``first`` says."""
    held: list[float] = []

    def step(columns: dict[str, list]) -> dict[str, list]:
        balance, drained, overdrawn = [], [], []
        tau = columns["tau"][0]
        keep = math.exp(-seconds / tau)
        b = held[0] if held else columns[first or capacity][0]
        for p, limit, full in zip(columns[value], columns[threshold], columns[capacity]):
            p = p if p is not None and math.isfinite(p) else 0.0
            drain = over = 0.0
            if p > limit:
                drain = (p - limit) * seconds
                b -= drain
                over = max(0.0, -b)
            else:
                b = full - (full - b) * keep
            b = min(full, max(0.0, b))
            balance.append(b)
            drained.append(drain)
            overdrawn.append(over)
        held[:] = [b]
        return {"balance": balance, "drained": drained, "overdrawn": overdrawn}

    return step


def reserve_stats(balances: DataFrame, s: Series, seconds: float = 1.0) -> DataFrame:
    """One row a series of ``reserve_balance``: tau, min_bal, min_at, spent, overdraft, depleted, depleted_seconds."""
    at = s.order[0]
    return balances.groupBy(*s.keys).agg(
        F.first("tau").alias("tau"),
        F.min("balance").alias("min_bal"),
        F.min_by(at, F.struct("balance", at)).alias("min_at"),
        F.sum("drained").alias("spent"),
        F.sum("overdrawn").alias("overdraft"),
        (F.min("balance") <= 0).alias("depleted"),
        (F.sum(F.when(F.col("balance") <= 0, 1).otherwise(0)) * F.lit(seconds)).alias("depleted_seconds"),
    )
