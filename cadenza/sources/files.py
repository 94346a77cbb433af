"""Any mix of ride files under one path: device files by their extension, everything else as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.sources.fit import read_fit
from cadenza.sources.streams import read_streams


def read_rides(spark: SparkSession, path: str, activities: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rides, samples, rejected) of all files under a path: ``.fit`` in any case by the FIT reader, ``.json`` by the stream reader."""
    device_rides, device_samples = read_fit(spark, path, glob="*.[fF][iI][tT]")
    rides, samples, rejected = read_streams(spark, path, activities)
    return device_rides.unionByName(rides, allowMissingColumns=True), device_samples.unionByName(samples.select(*device_samples.columns)), rejected
