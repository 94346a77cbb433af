"""Live variants: recording sessions, tumbling loads, and a reserve that follows each sample.

A live reserve can't know the whole ride's mean shortfall, so its time constant
follows the mean so far: it is another operator than the batch one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_sessions(events: DataFrame, key: str, time: str, value: str, gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """``key, start, end, n, total`` of stretches without a gap; rows exactly a gap apart share one."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def live_load(events: DataFrame, key: str, time: str, value: str, every: str = "1 minute", slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """Mean and peak of each window of time, tumbling or sliding."""
    w = F.window(time, every, slide) if slide else F.window(time, every)
    return events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.avg(value).alias("avg"), F.max(value).alias("peak"), F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "avg", "peak", "n")


def live_reserve(events: DataFrame, key: str, time: str, value: str, threshold: float, capacity: float, late: str = "1 minute", forget: int = 7 * 86_400) -> DataFrame:
    """``key, time, balance`` after each sample of a stream; state a key: balance, sum and count of shortfalls.

    Samples are followed in the order of triggers, within a trigger in that of time: one that comes late is followed when
    it comes, and changes nothing that was sent before. A key that has been silent for ``forget`` seconds beyond the
    watermark loses its state and begins anew with a full reserve.
    """
    kind = dict(events.dtypes)
    out = f"{key} {kind[key]}, {time} {kind[time]}, balance double"

    def follow(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        balance, short, n = state.get if state.exists else (capacity, 0.0, 0)
        # a trigger's rows of one key come in no order
        rows = pd.concat([f for f in frames if len(f)]).sort_values(time, kind="stable")
        balances = []
        for p in rows[value].fillna(0.0).tolist():
            if p > threshold:
                balance = max(0.0, balance - (p - threshold))
            else:
                short, n = short + threshold - p, n + 1
                tau = 546 * math.exp(-0.01 * short / n) + 316
                balance = capacity - (capacity - balance) * math.exp(-1 / tau)
            balances.append(balance)
        state.update((balance, short, n))
        state.setTimeoutTimestamp(max(int(rows[time].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + forget * 1000)
        yield pd.DataFrame({key: k[0], time: rows[time].to_numpy(), "balance": balances})

    return events.withWatermark(time, late).groupBy(key).applyInPandasWithState(follow, out, "balance double, short double, n long", "append", GroupStateTimeout.EventTimeTimeout)
