"""Helpers that several corpus operators share: staged tables, words, Arrow batches, links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A-Z become a-z and every ASCII byte outside 0-9 and a-z becomes a blank; bytes from 0x80 on stay.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only a local session may
    leave that unset: a new temporary folder is made and set. On a cluster
    such a folder would be seen by one machine alone, so this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a cut of the
    lineage that survives lost executors."""
    path = new_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame) -> DataFrame:
    """df's columns as the one column ``_row``, so that no added column can clash with them; ``_row.*`` unpacks it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


#: The separators of the tokens ``[^\x20\x09-\x0D]+`` are what bytes.split() takes.
def tokens(text: str | None) -> list[bytes]:
    """Tokens ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if text else []


#: Bytes of texts in one batch; a longer text is a batch of its own.
BATCH_BYTES = 16 << 20


def batch_cuts(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``rows`` rows and, but for single rows, BATCH_BYTES of strings and binaries."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(total, total[at] + BATCH_BYTES, side="right")) - 1))
        yield at, end
        at = end


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow with batches of at most ``rows`` rows and about BATCH_BYTES; ``make`` runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for a, b in batch_cuts(batch, rows):
                yield each(batch.slice(a, b - a))

    return df.mapInArrow(run, schema)


#: A key with over one in so many rows, and over HOT_ROWS, is hot: there are at most HOT_SHARE of these.
HOT_SHARE, HOT_ROWS = 10_000, 100


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with the one row that ``table`` has for their key.

    ``n`` is the table's column that tells how many rows have the key, ``total``
    their number. The entries of hot keys, at most HOT_SHARE, are broadcast, so
    that no task gets all rows of such a key; the others are joined by a shuffle.
    """
    most = max(HOT_ROWS, total // HOT_SHARE)
    columns = [c for c in table.columns if c != key]
    hot = table.where(F.col(n) > most).select(F.col(key), F.struct(*columns).alias("_hot"))
    tried = rows.join(F.broadcast(hot), key, "left")
    done = tried.where(F.col("_hot").isNotNull()).select(*rows.columns, *(F.col("_hot")[c].alias(c) for c in columns))
    cold = tried.where(F.col("_hot").isNull()).drop("_hot").join(table.where(F.col(n) <= most).hint("merge"), key)
    return done.unionByName(cold.select(*rows.columns, *columns))


#: Edges that one task handles in a round; a graph of fewer is dealt to fewer tasks, so that small graphs are not all overhead.
EDGES_A_TASK = 100_000
LEAST_TASKS = 8


def label_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long ids.

    Alternates the large-star and small-star steps: each node's neighbours are
    linked to the smallest of them until all that is left is stars around their
    smallest node; edges that are such stars already take no step. Every step is a
    grouped minimum and a ``lookup`` of it, staged in the shared folder, so no
    adjacency list, star or component is ever held in one task.

    Returns ``(node, component)``, staged, for every node with an edge; the
    component is its smallest node.
    """
    edges = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    while True:
        count = edges.count()
        total = 2 * count
        tasks = max(LEAST_TASKS, count // EDGES_A_TASK)
        # the same edge may come in both directions at first
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"), (F.max("b") > F.min("b")).alias("many"))
        known = stage(least.coalesce(tasks), "least")
        # in stars, who has a smaller neighbour has no other one
        if not known.where("many and m < a").limit(1).count():
            break
        large = lookup(both, known.select("a", "m", "n"), "a", "n", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large.coalesce(tasks), "edges")
        # every edge of large points from the larger to the smaller node
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = lookup(large, least, "a", "n", total).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = stage(small.coalesce(tasks), "edges")
        discard(edges, large, known)
        edges = small
    discard(edges)
    out = known.select(F.col("a").alias("node"), F.col("m").alias("component"))
    out.staged_path = known.staged_path
    return out


def prefix_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], bucket: str) -> DataFrame:
    """Exclusive running sums in ``order`` within the groups ``by``: a column of each name in ``sums``, of the column it names.

    The column ``bucket`` must not decrease in that order. Sums of buckets are
    summed first, then rows within each bucket, so no task holds a whole group.
    """
    keys = [*by, bucket]
    whole = Window.partitionBy(*by).orderBy(bucket)
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys).agg(*(F.sum(value).alias(f"_all_{out}") for out, value in sums.items()))
    before = totals.select(*keys, *((F.sum(f"_all_{out}").over(whole) - F.col(f"_all_{out}")).alias(f"_before_{out}") for out in sums))
    inner = df.withColumns({f"_in_{out}": F.sum(value).over(within) - F.col(value) for out, value in sums.items()})
    joined = inner.join(before, keys).withColumns({out: F.col(f"_before_{out}") + F.col(f"_in_{out}") for out in sums})
    return joined.drop(*(f"_{x}_{out}" for out in sums for x in ("before", "in")))


def range_sorted(df: DataFrame, *order: Column) -> DataFrame:
    """df sorted over all its tasks and staged, with ``_task``, which does not decrease in that order, and ``_at``, its place in the order (with gaps)."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(spread.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sorted")


def hash64(items: np.ndarray, seed: int) -> np.ndarray:
    """Mix 64-bit integers with a seed (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = items + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9DDFEA08EB382D69


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of texts, and where each text's words start (one more).

    A word's hash is a difference of the running sums of a polynomial over all
    bytes, so no word is touched by itself.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = ~_SEPARATOR[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])
        inverse = _powers(pow(_BASE, -1, 1 << 64), len(data))
        hashes = hash64((sums[ends] - sums[starts]) * inverse[starts], 0) ^ hash64((ends - starts).astype(np.uint64), 1)
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
