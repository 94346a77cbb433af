"""Series longer than one task: blocks of rows with borders of their neighbours, and carries from block to block.

All rows are sorted once over all tasks and numbered; a block is a stretch of
``size`` numbers, whatever keys it holds, so a series of any length lies in as
many blocks as it needs and no task ever has a whole one. Three things cross a
block's edge:

* ``bordered`` copies rows near an edge into the neighbouring block (a halo), so
  every window function of ``operators.series`` with a bounded frame gives the
  same value within blocks as over the whole series.
* ``carried`` adds up what the blocks before hold (sums, maxima, counts, last
  values): one row a block and key.
* ``long_reserve`` and ``long_slope`` carry a state through a recursion by
  composing, block by block, what each block does to every state it could start
  from: clamped affine maps, and a table of states.

Rows must differ in keys or order, as everywhere in this library: what is equal
in both lies in any order. Nulls in keys are keys like others.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from cadenza.operators.folds import Step, fold_sorted, reserve_step
from cadenza.operators.series import Series, fitted, reaches

BLOCK_ROWS = 20_000
#: Writes a table under a name and reads it back.
Keep = Callable[[DataFrame, str], DataFrame]
#: The number of a row and its block.
NUMBER, BLOCK = "_number", "_block"


@dataclass(frozen=True)
class Blocks:
    """Rows with their number and block, staged; ``series`` orders the rows of one key in one block."""

    rows: DataFrame
    whole: Series
    size: int
    keep: Keep

    @property
    def series(self) -> Series:
        return Series((*self.whole.keys, BLOCK), self.whole.order)

    def per_block(self, *aggregates: Column) -> DataFrame:
        return self.rows.groupBy(*self.whole.keys, BLOCK).agg(*aggregates)


def in_blocks(df: DataFrame, s: Series, keep: Keep, size: int = BLOCK_ROWS) -> Blocks:
    """Sort and number the rows of all series and cut them into blocks.

    Offsets of the sorted partitions are joined by broadcast: one row a partition.
    """
    sort = [*s.keys, *s.order]
    spread = df.repartitionByRange(*(F.col(c) for c in sort)).sortWithinPartitions(*sort).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    spread = keep(spread, f"sorted-{uuid.uuid4().hex}")
    parts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_rows")
    offsets = parts.select("_part", (before - F.col("_first")).alias("_offset"))
    number = F.col("_at") + F.col("_offset")
    numbered = spread.join(F.broadcast(offsets), "_part").withColumns({NUMBER: number, BLOCK: F.floor(number / size)}).drop("_part", "_at", "_offset")
    return Blocks(numbered, s, size, lambda table, name: keep(table, f"{name}-{uuid.uuid4().hex}"))


def bordered(b: Blocks, back: int, forward: int) -> DataFrame:
    """The rows of each block and, with ``_own`` false, the ``back`` rows before and the ``forward`` rows after it.

    Columns with frames inside these bounds over ``b.series`` are right where ``_own`` is true.
    """
    own, number = F.col(BLOCK), F.col(NUMBER)
    to = F.sequence(F.floor((number - forward) / b.size), F.floor((number + back) / b.size))
    return b.rows.withColumn("_home", own).withColumn(BLOCK, F.explode(to)).withColumn("_own", F.col(BLOCK) == F.col("_home")).drop("_home")


def with_frames(b: Blocks, back: int, forward: int, columns: Callable[[Series], dict[str, Column]]) -> DataFrame:
    """The rows of all series with columns of bounded frames."""
    return bordered(b, back, forward).withColumns(columns(b.series)).where("_own").drop("_own", BLOCK, NUMBER)


def carried(b: Blocks, sums: dict[str, Column] = {}, maxima: dict[str, Column] = {}, last: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """The rows of all series with running sums, running maxima and last known values, from the first row on; and ``_place``, which counts from 0."""
    sums = {"_place": F.lit(1).cast("long"), **sums}
    within, so_far = b.series, b.series.so_far
    blocks = Series(b.whole.keys, (BLOCK,))
    earlier = blocks.rows(Window.unboundedPreceding, -1)
    inner = b.rows.withColumns({f"_in_{n}": f(x).over(so_far) for f, group in ((F.sum, sums), (F.max, maxima), (lambda x: F.last(x, ignorenulls=True), last)) for n, x in group.items()})
    ends = b.rows.groupBy(*within.keys).agg(
        *(F.sum(x).alias(f"_s_{n}") for n, x in sums.items()), *(F.max(x).alias(f"_m_{n}") for n, x in maxima.items()), *(F.max_by(x, F.when(x.isNotNull(), F.col(NUMBER))).alias(f"_l_{n}") for n, x in last.items())
    )
    before = ends.select(
        *within.keys,
        *(F.sum(f"_s_{n}").over(earlier).alias(f"_s_{n}") for n in sums),
        *(F.max(f"_m_{n}").over(earlier).alias(f"_m_{n}") for n in maxima),
        *(F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in last),
    )
    joined = _beside(inner, before, within.keys)
    out = {n: F.coalesce(F.col(f"_s_{n}") + F.col(f"_in_{n}"), F.col(f"_in_{n}"), F.col(f"_s_{n}")) for n in sums}
    out |= {n: F.greatest(f"_m_{n}", f"_in_{n}") for n in maxima}
    out |= {n: F.coalesce(f"_in_{n}", f"_l_{n}") for n in last}
    out["_place"] = out["_place"] - 1
    return joined.withColumns(out).drop(BLOCK, NUMBER, *(f"_{k}_{n}" for k, group in (("s", sums), ("m", maxima), ("l", last)) for n in group), *(f"_in_{n}" for n in (*sums, *maxima, *last)))


def _beside(rows: DataFrame, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows with the one row that table has for their keys, null ones too."""
    names = {k: f"_k{n}" for n, k in enumerate(keys)}
    table = table.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(table.hint("merge"), on, "left").drop(*names.values())


def _entries(blocks: DataFrame, s: Series, kind: StructType, walk: Callable[[dict[str, list]], list]) -> DataFrame:
    """``keys, block, start``: what ``walk`` makes of each key's blocks in their order; one row a block."""
    fields = [blocks.schema[k] for k in (*s.keys, BLOCK)]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(BLOCK)
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        return pa.table([*(table.column(f.name) for f in fields), pa.array(walk(columns), pa.float64() if isinstance(kind, DoubleType) else pa.int64())], names=[*(f.name for f in fields), "_start"])

    return blocks.groupBy(*s.keys).applyInArrow(run, StructType([*fields, StructField("_start", kind)]))


# the reserve


def then(first: tuple, second: tuple) -> tuple:
    """The clamped affine map that does first, then second; a map is (m, c, low, high): b to clamp(m b + c, low, high)."""
    (m1, c1, low1, high1), (m2, c2, low2, high2) = first, second
    clamp = lambda x: np.minimum(high2, np.maximum(low2, x))
    return m1 * m2, m2 * c1 + c2, clamp(m2 * low1 + c2), clamp(m2 * high1 + c2)


def composed(m: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, float, float, float]:
    """All maps one after the other, joined in pairs of neighbours."""
    maps = (m, c, low, high)
    while len(maps[0]) > 1:
        odd = tuple(x[-1:] for x in maps) if len(maps[0]) % 2 else None
        maps = then(tuple(x[: len(x) // 2 * 2 : 2] for x in maps), tuple(x[1::2] for x in maps))
        if odd:
            maps = tuple(np.concatenate([x, y]) for x, y in zip(maps, odd))
    return tuple(float(x[0]) for x in maps)


def long_reserve(b: Blocks, value: str, threshold: str, capacity: str, seconds: float = 1.0) -> DataFrame:
    """``folds.reserve_balance`` of series of any length.

    A second of draining or refilling is a clamped affine map of the reserve. A block is the composition of its seconds;
    these are applied one after the other, one row a block, to find the reserve with which each block begins; then
    every block is walked from there, so what is overdrawn is known too.
    """
    keys = b.series.keys
    p = F.coalesce(F.when(~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < math.inf), F.col(value)), F.lit(0.0))
    short = F.when(F.coalesce(F.col(value), F.lit(0.0)) < F.col(threshold), F.col(threshold) - F.coalesce(F.col(value), F.lit(0.0)))
    # sums of blocks, then of keys: one row a block and key
    sums = b.per_block(F.sum(short).alias("_short"), F.count(short).alias("_n"), F.min_by(capacity, NUMBER).alias("_full"))
    whole = Window.partitionBy(*b.whole.keys)
    tau = F.lit(546.0) * F.exp(-0.01 * F.coalesce(F.try_divide(F.sum("_short").over(whole), F.sum("_n").over(whole)), F.lit(0.0))) + 316.0
    taus = b.keep(sums.select(*keys, tau.alias("tau"), F.first("_full").over(whole.orderBy(BLOCK)).alias("_full")), "taus")
    rows = _beside(b.rows.drop("tau"), taus, keys)
    names = ["_m", "_c", "_low", "_high"]
    key_fields = [rows.schema[k] for k in keys]
    schema = StructType([*key_fields, *(StructField(n, DoubleType()) for n in names)])

    def block_map(table: pa.Table) -> pa.Table:
        table = table.sort_by(NUMBER)
        v, limit, full, tau = (table.column(c).to_numpy() for c in ("_p", "_limit", "_cap", "tau"))
        keep, above = np.exp(-seconds / tau), v > limit
        found = composed(np.where(above, 1.0, keep), np.where(above, -(v - limit) * seconds, full * (1 - keep)), np.minimum(full, 0.0), np.maximum(full, 0.0))
        return pa.table([*(table.column(f.name).slice(0, 1) for f in key_fields), *(pa.array([x]) for x in found)], names=[*(f.name for f in key_fields), *names])

    slim = rows.select(*keys, NUMBER, p.cast("double").alias("_p"), F.col(threshold).cast("double").alias("_limit"), F.col(capacity).cast("double").alias("_cap"), "tau")
    maps = slim.groupBy(*keys).applyInArrow(block_map, schema)

    def walk(blocks: dict[str, list]) -> list[float]:
        out, now = [], blocks["_full"][0]
        for m, c, low, high in zip(*(blocks[n] for n in names)):
            out.append(now)
            now = min(high, max(low, m * now + c))
        return out

    starts = b.keep(_entries(_beside(maps, taus.select(*keys, "_full"), keys), b.whole, DoubleType(), walk), "starts")
    rows = _beside(rows.drop("_full"), starts, keys)
    order = Series(keys, (NUMBER,))
    out = fold_sorted(rows, order, [value, threshold, capacity, "tau", "_start"], "balance double, drained double, overdrawn double", lambda: reserve_step(value, threshold, capacity, seconds, "_start"))
    return out.drop("_start", BLOCK, NUMBER)


# the slope over a range


def long_slope(b: Blocks, y: str, x: str, half: float, least: int, limit: float, out: str) -> DataFrame:
    """``series.range_slope`` of series of any length.

    A block gets the rows of others within ``half`` of its own, and ``least`` more. How far the fit of a row reaches depends
    on the row before by at most ``least`` rows ahead, so each block tells for every such state at its start the one at
    its end; these tables are applied one after the other, one row a block.
    """
    keys = b.series.keys
    ends = b.per_block(F.min(x).cast("double").alias("_x0"), F.max(x).cast("double").alias("_x1"), F.min(NUMBER).alias("_n0"), F.max(NUMBER).alias("_n1"))
    fields = [ends.schema[k] for k in b.whole.keys]
    names = ["_target", "_x0", "_x1", "_n0", "_n1"]
    schema = StructType([*fields, StructField(BLOCK, LongType()), *(StructField(n, DoubleType() if n[1] == "x" else LongType()) for n in names)])

    def sources(table: pa.Table) -> pa.Table:
        table = table.sort_by(BLOCK)
        block, x0, x1, n0, n1 = (table.column(c).to_numpy() for c in (BLOCK, "_x0", "_x1", "_n0", "_n1"))
        first = np.minimum(np.searchsorted(x1, x0 - half, side="left"), np.searchsorted(n1, n0 - least, side="left"))
        last = np.maximum(np.searchsorted(x0, x1 + half, side="right"), np.searchsorted(n0, n1 + least, side="right"))
        target = np.repeat(np.arange(len(block)), last - first)
        source = np.arange(len(target)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)
        bounds = (block[target], x0[target] - half, x1[target] + half, n0[target] - least, n1[target] + least)
        return pa.table([*(table.column(f.name).take(pa.array(target)) for f in fields), pa.array(block[source]), *(pa.array(v) for v in bounds)], names=[*(f.name for f in fields), BLOCK, *names])

    edges = ends.groupBy(*b.whole.keys).applyInArrow(sources, schema)
    edges = edges.withColumnsRenamed({k: f"_k{n}" for n, k in enumerate(keys)})
    near = (F.col(x).between(F.col("_x0"), F.col("_x1")) | F.col(NUMBER).between(F.col("_n0"), F.col("_n1"))).alias("near")
    on = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    rows = b.rows.drop(out).join(edges.hint("merge"), [*on, near]).withColumn("_own", F.col(BLOCK) == F.col("_target"))
    rows = b.keep(rows.drop(BLOCK, *(f"_k{n}" for n in range(len(keys))), "_x0", "_x1", "_n0", "_n1").withColumnRenamed("_target", BLOCK), "halo")

    def block_reach(table: pa.Table) -> pa.Table:
        table = table.sort_by(NUMBER)
        at, own = table.column("_at").cast(pa.float64()).to_numpy(), np.flatnonzero(table.column("_own").to_numpy(zero_copy_only=False))
        return pa.table([*(table.column(f.name).slice(0, 1) for f in key_fields), pa.array([reaches(at, half, least, int(own[0]), int(own[-1]) + 1)], pa.list_(pa.int64()))], names=[*(f.name for f in key_fields), "_ends"])

    key_fields = [rows.schema[k] for k in keys]
    maps = rows.select(*keys, NUMBER, F.col(x).alias("_at"), "_own").groupBy(*keys).applyInArrow(block_reach, StructType([*key_fields, StructField("_ends", ArrayType(LongType()))]))

    def walk(blocks: dict[str, list]) -> list[int]:
        found, now = [], 0
        for ends in blocks["_ends"]:
            found.append(now)
            now = ends[now]
        return found

    starts = b.keep(_entries(maps, b.whole, LongType(), walk), "starts")
    placed = _beside(rows, starts, keys)
    kept = [f for f in placed.schema.fields if f.name not in (BLOCK, NUMBER, "_own", "_start")]

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by(NUMBER)
        at, value = (table.column(c).cast(pa.float64()).to_numpy() for c in (x, y))
        own = np.flatnonzero(table.column("_own").to_numpy(zero_copy_only=False))
        slope = fitted(at, value, half, least, limit, int(own[0]), int(own[-1]) + 1, table.column("_start")[0].as_py())
        inner = table.slice(int(own[0]), len(own)).select([f.name for f in kept])
        return inner.append_column(out, pa.array(slope, pa.float64()))

    return placed.groupBy(*keys).applyInArrow(fit, StructType([*kept, StructField(out, DoubleType())]))
