"""Jobs that were once made smaller, against the whole job."""

import random
from collections import defaultdict

import duckdb
import numpy as np

from cadenza.llm import quality
from cadenza.queries import ORACLES, QUERIES

#: All pairs of customers as circuits within one box of two kilometres, copies of each other included.
ALL_PAIRS = """
WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS ride_id, 45.49 + (c_custkey * 7919 % 1000) / 50000 AS lat, 7 + (c_custkey * 104729 % 1000) / 50000 AS lon, CAST(1000 + c_nationkey * 40 AS DOUBLE) AS lap_len FROM customer), p AS (
  SELECT a.ride_id AS a, b.ride_id AS b, sqrt(pow((b.lon - a.lon) * 111320 * cos(radians(a.lat)), 2) + pow((b.lat - a.lat) * 111320, 2)) AS apart, abs(a.lap_len - b.lap_len) / greatest(a.lap_len, b.lap_len) AS ratio
  FROM c a JOIN c b ON a.ride_id < b.ride_id AND abs(a.lat - b.lat) < 0.01
)
SELECT a, b, round(apart, 4) AS apart, round(ratio, 9) AS length_ratio FROM p WHERE apart < 250 AND ratio < 0.12
"""


def expanded(rows):
    """All pairs that rows of classes and copies stand for."""
    members = defaultdict(set)
    for r in rows:
        members[r["a"]] |= {r["a"], r["b"]} if r["copy"] else {r["a"]}
        if not r["copy"]:
            members[r["b"]].add(r["b"])
    pairs = [(x, y, 0.0, 0.0) for m in members.values() for x in m for y in m if x < y]
    return sorted(pairs + [(x, y, r["apart"], r["length_ratio"]) for r in rows if not r["copy"] for x in members[r["a"]] for y in members[r["b"]] if x < y])


def test_same_circuits_stand_for_all_pairs(spark, tmp_path):
    duck = duckdb.connect()
    # ten customers at each of 130 places, of few lengths, and a few without a length
    duck.execute("CREATE TABLE customer AS SELECT (i // 130) * 1000 + i % 130 * 7 + 1 AS c_custkey, CASE WHEN i % 97 > 0 THEN CAST(i * i % 11 % 6 AS INT) END AS c_nationkey FROM range(1300) t(i)")
    duck.execute(f"COPY customer TO '{tmp_path}/customer.parquet'")
    want = duck.execute(ALL_PAIRS).fetchall()
    rows = QUERIES["same_circuits"](spark, str(tmp_path)).collect()
    assert expanded(rows) == sorted(want) and 10_000 < len(want) and len(rows) < 0.5 * len(want)
    theirs = duck.execute(ORACLES["same_circuits"])
    names = [d[0] for d in theirs.description]
    assert sorted((r["a"], r["b"], r["apart"], r["length_ratio"], r["copy"]) for r in rows) == sorted(tuple(dict(zip(names, r))[c] for c in ("a", "b", "apart", "length_ratio", "copy")) for r in theirs.fetchall())


def test_quality_is_learned_from_all_ratings(spark):
    """Each rated text has a word of its own, which has a weight if the text was learned from, however many a part takes."""
    n = 300
    docs = spark.createDataFrame([(i, f"own{i} words here") for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, most=40, l1=0.0)
    own = [set(quality.features([f"own{i} words here"])[1].tolist()) - set(quality.features(["words here"])[1].tolist()) for i in range(n)]
    assert all(buckets & set(model.buckets.tolist()) for buckets in own)
    again = quality.fit(docs, labels, most=40, l1=0.0)
    assert again.least == model.least and (again.weights == model.weights).all() and (again.cuts == model.cuts).all()


def test_threshold_over_all_tasks(spark):
    rng = random.Random(3)
    for n, share in ((0, 0.5), (1, 1.0), (400, 0.9), (2000, 0.98), (500, 0.0), (500, 1.0)):
        rows = [(rng.random() ** (1 if best else 3), best) for best in (rng.random() < share for _ in range(n))]
        held = spark.createDataFrame(rows, "tail double, best boolean").repartition(5)
        tails, best = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], bool)
        assert quality.least_of(held) == quality.least_tail(tails, best)
