"""The drag area of whole keys, against NumPy on all rows."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from cadenza.plans import calibrate
from cadenza.queries import QUERIES


def by_numpy(rows, floor, default, pct):
    """``cda, ok, side, cohort_size`` of each key of ``(key, watts, fixed, per_cda)``."""
    out = {}
    for key in {r[0] for r in rows}:
        watts, fixed, per_cda = np.array([r[1:] for r in rows if r[0] == key], float).T
        cda, ok, side = calibrate.drag_at_one(watts, fixed[None], per_cda[None], floor, default, pct)
        out[key] = (float(cda[0]), bool(ok[0]), int(side[0]), len(watts))
    return out


def test_drag_against_numpy(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice((0.0, 1.0, rng.uniform(50, 400))), rng.uniform(-50, 150), rng.uniform(-100, 700)) for k, n in (("a", 400), ("b", 31), ("c", 29), (None, 90)) for _ in range(n)]
    rows += [("low", 10.0, 100.0, 300.0)] * 40 + [("high", 900.0, 100.0, 300.0)] * 40 + [("one", 200.0, 80.0, 300.0)] * 33 + [("idle", 5.0, 0.0, 10.0)] * 50
    df = spark.createDataFrame(rows, "k string, watts double, fixed double, per_cda double")
    for pct in (0.5, 0.85, 1.0):
        got = calibrate.solve_drag(df, ("k",), F.lit(40.0), F.lit(0.32), pct)
        assert {r["k"]: tuple(r)[1:] for r in got.collect()} == by_numpy(rows, 40.0, 0.32, pct)
    assert calibrate.solve_drag(df.limit(0), ("k",), F.lit(40.0), F.lit(0.32), 0.85).count() == 0


def test_no_task_holds_a_key(spark):
    plans = []

    def keep(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return df.localCheckpoint()

    df = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") + 50.0).alias("watts"), F.lit(90.0).alias("fixed"), F.lit(500.0).alias("per_cda"))
    calibrate.solve_drag(df, ("k",), F.lit(40.0), F.lit(0.32), 0.85, keep)
    assert len(plans) == 8 and not re.search("Pandas|Python|Window|percentile|collect_list|ObjectHashAggregate", "".join(plans))


def test_query_takes_all_suppliers(spark, tmp_path):
    rng = random.Random(5)
    lines = [(s, rng.choice("ANR"), float(rng.randint(1, 50)) + (s > 20) * 15, rng.randint(0, 10) / 100, rng.randint(0, 8) / 100) for s in range(1, 61) for _ in range(20)]
    spark.createDataFrame(lines, "l_suppkey long, l_returnflag string, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = by_numpy([(k, q * 8, 100 + d * 500, 200 + t * 1000) for _, k, q, d, t in lines], 40.0, 0.32, 0.85)
    assert {r["l_returnflag"]: (r["cda"], r["ok"]) for r in QUERIES["bisection_p85"](spark, str(tmp_path)).collect()} == {k: (round(v[0], 6), v[1]) for k, v in want.items()}
