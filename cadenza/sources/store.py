"""The store of raw rides, from which everything else is derived again: append-only, so it costs what is added, however much it holds.

Every put writes folders of its own, ``rides/batch=…`` and ``samples/batch=…``; nothing is rewritten, and two writers never
share a path. The samples come first: a ride is there once its row is. Reading takes the latest row of each ride, by time
of saving and then by batch, and the samples of the batch that row is from. A removal is a row that says so. ``compact``
writes what is current into one batch and deletes the others.

Defined cases: a ride that is put again replaces all of its former samples, also with none; a removed ride can be put
again; rides with a null id are kept like others but cannot be got by id; an empty put adds nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.plans.tables import CHANNELS, RIDES

KEPT = [c.split()[0] for c in RIDES.split(", ")]
_SAVED = "saved_at timestamp, removed boolean"


def put(rides: DataFrame, samples: DataFrame, path: str, batch: str | None = None) -> str:
    """Add rides and their samples, in place of what was stored of these rides; returns the batch's name.

    A batch that is given and already there is left as it is, so a put that is tried again adds nothing.
    """
    batch = batch or f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    if not _exists(rides.sparkSession, f"{path}/rides/batch={batch}/_SUCCESS"):
        samples.select("ride_id", "seq", "t", *CHANNELS).write.mode("overwrite").parquet(f"{path}/samples/batch={batch}")
        _write_rides(rides, path, batch, removed=False)
    return batch


def _write_rides(rides: DataFrame, path: str, batch: str, removed: bool) -> None:
    rides.select(*KEPT, F.current_timestamp().alias("saved_at"), F.lit(removed).alias("removed")).write.mode("overwrite").parquet(f"{path}/rides/batch={batch}")


def ingest(path: str, name: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls to put a stream's rides: each trigger is a batch named after its number, so a trigger that runs twice counts once."""

    def save(df: DataFrame, number: int) -> None:
        df.persist()
        put(*split(df), path, batch=f"{name}-{number:012d}")
        df.unpersist()

    return save


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    files, p = _path(spark, path)
    return files.exists(p)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    fields = f"{RIDES}, {_SAVED}" if name == "rides" else "ride_id string, seq long, t double, " + ", ".join(f"{c} double" for c in CHANNELS)
    return spark.read.schema(f"{fields}, batch string").parquet(f"{path}/{name}")


def _latest(spark: SparkSession, path: str) -> DataFrame:
    newest = Window.partitionBy("ride_id").orderBy(F.col("saved_at").desc(), F.col("batch").desc())
    return _read(spark, path, "rides").withColumn("_nth", F.row_number().over(newest)).where("_nth = 1 AND NOT removed").drop("_nth", "removed")


def rides(spark: SparkSession, path: str) -> DataFrame:
    """Stored rides, the latest start first."""
    return _latest(spark, path).drop("batch").orderBy(F.coalesce("start_time", F.lit(0.0)).desc(), "ride_id")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples of all stored rides, of each from the batch that it was last put with."""
    own = _latest(spark, path).select(F.col("ride_id").alias("_id"), F.col("batch").alias("_batch"))
    rows = _read(spark, path, "samples")
    return rows.join(own, rows["ride_id"].eqNullSafe(own["_id"]) & (rows["batch"] == own["_batch"]), "left_semi").drop("batch")


def get(spark: SparkSession, path: str, ride_id: str) -> tuple[DataFrame, DataFrame]:
    """(rides, samples) of one ride; of the samples only its batch is read."""
    own = _latest(spark, path).where(F.col("ride_id") == ride_id)
    row = own.select("batch").first()
    of = _read(spark, path, "samples").where((F.col("batch") == (row["batch"] if row else "")) & (F.col("ride_id") == ride_id))
    return own.drop("batch"), of.drop("batch")


def remove(spark: SparkSession, path: str, ride_id: str) -> None:
    """Delete one ride: a row that says so is added."""
    gone = _latest(spark, path).where(F.col("ride_id") == ride_id)
    _write_rides(gone, path, f"{time.time_ns():020d}-{uuid.uuid4().hex}", removed=True)


def compact(spark: SparkSession, path: str) -> None:
    """Write what is current into one batch, and delete the batches that it was read from.

    Rides keep the time at which they were saved, so what others put meanwhile stays newer. Nobody may read from the store
    while batches are deleted.
    """
    old = [r["batch"] for r in _read(spark, path, "rides").select("batch").distinct().collect()]  # one name a batch
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    among = F.col("batch").isin(old)
    current = _latest(spark, path).where(among)
    rows = _read(spark, path, "samples")
    own = current.select(F.col("ride_id").alias("_id"), F.col("batch").alias("_batch"))
    rows.join(own, rows["ride_id"].eqNullSafe(own["_id"]) & (rows["batch"] == own["_batch"]), "left_semi").drop("batch").write.parquet(f"{path}/samples/batch={batch}")
    current.drop("batch").withColumn("removed", F.lit(False)).write.parquet(f"{path}/rides/batch={batch}")
    for name in ("rides", "samples"):
        for b in old:
            files, p = _path(spark, f"{path}/{name}/batch={b}")
            files.delete(p, True)
