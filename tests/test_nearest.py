"""The nearest of all other points, against all pairs."""

import math
import random
import re

from cadenza.operators import joins
from cadenza.queries import QUERIES


def brute(points):
    out = {}
    for i, x, y in points:
        others = [(math.hypot(x - a, y - b), j) for j, a, b in points if j != i]
        out[i] = min(others)[::-1]
    return out


def test_nearest_of_all(spark, tmp_path):
    rng = random.Random(6)
    points = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(150)] + [(5 + rng.gauss(0, 1e-4), 5 + rng.gauss(0, 1e-4)) for _ in range(40)]
    points += [(0.25, 0.5)] * 30 + [(400.0, -300.0)] + [(-7.0 + i, 9.0) for i in range(4)]
    rng.shuffle(points)
    rows = [(i, "a", [x, y, 1.0]) for i, (x, y) in enumerate(points)]
    spark.createDataFrame([*rows, (999, "a", None)], "vec_id long, label string, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: (r["nearest"], r["distance"]) for r in QUERIES["nearest_neighbour_all"](spark, str(tmp_path)).collect()}
    assert got == {i: (j, round(d, 9)) for i, (j, d) in brute([(i, *p) for i, p in enumerate(points)]).items()}


def test_few_points(spark):
    plans = []

    def keep(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    near = lambda points: {r[0]: r[1] for r in joins.nearest_place(spark.createDataFrame(points, "i long, x double, y double"), "i", "x", "y", keep).collect()}
    assert near([(1, 0.0, 0.0)]) == {} and near([(1, 0.0, 0.0), (2, 0.0, 0.0)]) == {1: 2, 2: 1}
    assert near([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 3.0, 4.0)]) == {1: 2, 2: 3, 3: 2}
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", "".join(plans))
