"""Plans are what they are meant to be: pruned scans, equality joins, one shuffle for chains of windows."""

import re

import pytest
from pyspark.sql import functions as F

from cadenza.operators import joins, series
from cadenza.operators.resample import resample
from cadenza.queries import QUERIES
from cadenza.queries.series import USER

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["interval_membership", "semi_interval", "nearest_neighbour", "pair_threshold_join", "asof_lookup", "asof_interpolate", "surge_regions"])
def test_no_join_of_all_pairs(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, SF)))


def test_scans_are_pruned(spark):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["octant_spread"](spark, SF)))
    assert {c.split(":")[0] for r in read for c in r.split(",")} == {"user_id", "value"}


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(value), LessThan(value,20.0)]" in plan(QUERIES["compass_hist_16"](spark, SF))


def test_chains_of_windows_shuffle_once(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id", "value")
    df = df.withColumn("s", series.centred_mean(F.col("value"), USER, 5)).withColumn("m", series.running_max(F.col("s"), USER)).withColumn("d", series.gain(F.col("m"), USER))
    assert plan(df).count("Exchange hashpartitioning") == 1


def test_resampling_shuffles_once(spark):
    df = spark.createDataFrame([("a", float(i), 1.0) for i in range(20)], "k string, t double, x double")
    assert plan(resample(df, ("k",), "t", zero=["x"])).count("Exchange hashpartitioning") == 1


def test_interval_join_hashes_buckets(spark):
    a = spark.range(10).withColumn("k", F.lit(1))
    b = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("s"), (F.col("id") + 3).alias("e"))
    assert re.search("(SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin)", plan(joins.interval_join(a, b, ("k",), F.col("id"), "s", "e", 4)))
