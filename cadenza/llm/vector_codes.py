"""Product codes of vectors by k-means in whole numbers, with exponion search.

Components become integers, vectors are cut into equal parts, and each part has
a codebook that rounds of k-means improve. A part starts at its entry of the
round before, at exact squared distance d. An entry that is as near or nearer is
at most twice as far from that entry as the part is (triangle inequality), so
of the entry's neighbours, sorted by distance, only those with squared distance
up to 4 d are scanned: all in integers, so the radius is sufficient with no
tolerance, and ties go to the lower index.

A round writes vectors with their new codes once, then sums parts by entry.
Sums of tasks are added by Spark; the codebook, whose size does not depend on
the table, is all that the driver sees.

Arithmetic is exact for every float: in floats where all values stay below
2**53, else in 64-bit integers, else in Python's.

Defined cases: vectors that are null or hold null, infinite or NaN components
are dropped, as the contract says, and so are those that cannot be cut like the
others: whose length is zero, no multiple of the number of parts, or not that of
the first vector, by id, which is neither. Fewer vectors than entries make a smaller
codebook. A null id comes after all others; equal ids are ordered by vector;
repeated rows count as often as they occur. Errors beyond 64 bits are null. An
empty table gives no rows; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, lookup, map_arrow, stage

#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: Rows that are searched together, fewer for vectors of over a thousand components.
BATCH_ROWS, BATCH_VALUES = 16_384, 1 << 24
_LIMB = 64


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as floats, or as Python's integers where floats would not be exact."""
    out = np.floor(values.astype(np.float64) * SCALE)
    if out.size and np.abs(out).max() >= 2.0**53:
        return np.array([int(v) for v in out.ravel()], object).reshape(out.shape)
    return out


def exact(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the fastest type in which squared distances between them are exact."""
    largest = max((int(abs(a).max()) for a in (x, book) if a.size), default=0)
    bound = 4 * max(x.shape[1], 1) * largest * largest
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    if kind is object:
        return tuple(np.array([int(v) for v in a.ravel()], object).reshape(a.shape) for a in (x, book))
    return x.astype(kind), book.astype(kind)


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry's entries by distance, itself first, and their squared distances."""
    own = (book * book).sum(axis=1)
    far = own[:, None] - 2 * (book @ book.T) + own[None, :]
    order = np.argsort(far, axis=1, kind="stable")
    return order, np.take_along_axis(far, order, axis=1)


def exponion(x: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry (ties to the lower index) and squared distance of each row of x, and how many distances were taken."""
    x, book = exact(x, book)
    order, far = neighbours(book)
    own, entry_own = (x * x).sum(axis=1), (book * book).sum(axis=1)
    first = own - 2 * (x * book[start]).sum(axis=1) + entry_own[start]
    best, error, tried = start.copy(), first.copy(), len(x)
    by_entry = np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[by_entry], np.arange(len(book) + 1))
    for a in range(len(book)):
        rows = by_entry[cuts[a] : cuts[a + 1]]
        if not len(rows):
            continue
        reach = np.searchsorted(far[a], 4 * first[rows], side="right")
        low, width = 1, 4
        while low < len(book):  # rows of like reach together
            some = rows[(reach > low) & (reach <= width)]
            if len(some):
                scanned = np.sort(order[a, :width])  # by index, so that the first of equals is the lower
                d = own[some, None] - 2 * (x[some] @ book[scanned].T) + entry_own[scanned][None, :]
                at = np.argmin(d, axis=1)
                best[some], error[some] = scanned[at], d[np.arange(len(some)), at]
                tried += d.size
            low, width = width, 2 * width
    return best, error, tried


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to about ``rows`` rows: searches are faster for many rows at once."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _assigner(books: list[np.ndarray], width: int, final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    part = width // len(books)
    rows = max(1, min(BATCH_ROWS, BATCH_VALUES // width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, rows):
            x = _vectors(table.column("embedding").combine_chunks(), width)
            codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, len(books)).astype(np.int64)
            total = 0
            for k, book in enumerate(books):
                codes[:, k], error, _ = exponion(x[:, k * part : (k + 1) * part], codes[:, k], book)
                total = total + (error if error.dtype == object else error.astype(np.int64).astype(object))
            out = [table.column("vec_id").combine_chunks(), table.column("label").combine_chunks()]
            packed = [row.tobytes() for row in codes.astype(np.uint8)]
            if final:
                yield pa.RecordBatch.from_arrays([*out, pa.array([p.hex() for p in packed]), pa.array([e if e < 1 << 63 else None for e in total], pa.int64())], ["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*out, table.column("embedding").combine_chunks(), pa.array(packed, pa.binary())], ["vec_id", "label", "embedding", "code"])

    return run


def _sums(rows: DataFrame, parts: int, entries: int, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and sums of the parts of each codebook entry that is used. A task emits at most a codebook of them."""
    part = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, part), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0), width)
            x = x if x.dtype == object or np.abs(x).max() * len(x) >= 2.0**62 else x.astype(np.int64)
            x = x if x.dtype != np.float64 else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for k in range(parts):
                order = np.argsort(codes[:, k], kind="stable")
                used, starts = np.unique(codes[order, k], return_index=True)
                sums[k, used] += np.add.reduceat(x[order, k * part : (k + 1) * part], starts, axis=0).astype(object)
                counts[k] += np.bincount(codes[:, k], minlength=entries)
        k, e = np.nonzero(counts)
        if len(k):
            flat = [int(v) for v in sums[k, e].ravel()]
            high, low = ([Decimal(f(v)) for v in flat] for f in (lambda v: v >> _LIMB, lambda v: v & (1 << _LIMB) - 1))
            columns = [pa.array(np.repeat(v, part)) for v in (k, e, counts[k, e])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(part), len(k))), pa.array(high, pa.decimal128(38, 0)), pa.array(low, pa.decimal128(38, 0))], ["k", "e", "n", "at", "high", "low"])

    partial = rows.select("embedding", "code").mapInArrow(run, "k long, e long, n long, at long, high decimal(38,0), low decimal(38,0)")
    whole = partial.groupBy("k", "e", "at").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(whole.collect()):  # entries x components, whatever the table's size
        out.setdefault((r["k"], r["e"]), (r["n"], []))[1].append((int(r["high"]) << _LIMB) + int(r["low"]))
    return out


def _book(rows: list[list[int]], part: int) -> np.ndarray:
    return np.array([[int(v) for v in r] for r in rows], object).reshape(len(rows), part)


def compress(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every vector that is kept; ``entries`` at most 256."""
    value = F.col(f"`{embedding}`")
    whole = value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), value.alias("embedding")).where(whole & (F.size(value) > 0) & (F.size(value) % parts == 0))
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    head = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(1).collect()
    width = len(head[0][0]) if head else 0
    if not width:
        schema = f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    kept = kept.where(F.size("embedding") == width)
    first = scaled(np.array([r[0] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()], np.float64))
    part = width // parts
    books = [_book(first[:, k * part : (k + 1) * part].tolist(), part) for k in range(parts)]
    rows = kept.withColumn("code", F.lit(bytes(parts)))
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, "
    staged = None
    for _ in range(rounds):
        now = stage(rows.mapInArrow(_assigner(books, width, final=False), schema + f"embedding {kinds['embedding']}, code binary"), "codes")
        for (k, e), (n, sums) in _sums(now, parts, len(first), width).items():
            books[k][e] = [s // n for s in sums]
        if staged is not None:
            discard(staged)
        rows = staged = now
    coded = stage(rows.mapInArrow(_assigner(books, width, final=True), schema + "code string, error long"), "coded")
    if staged is not None:
        discard(staged)
    digest = sha256(",".join(str(v) for book in books for v in book.ravel()).encode()).hexdigest()
    keyed = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = keyed.groupBy("_label").agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return lookup(keyed, totals, "_label", "n", coded.count()).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """DuckDB SQL of ``compress`` on ``embeddings``: all distances of all parts, round by round."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS x, row_number() OVER (ORDER BY vec_id) AS place
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, place, k, x[k * len(x) // {parts} + 1 : (k + 1) * len(x) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS k)
), b0 AS MATERIALIZED (
  SELECT k, place - 1 AS e, x AS c FROM p WHERE place <= {entries}
)"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT place, k, min(struct_pack(d := d, e := e)) AS m FROM (
    SELECT place, p.k, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM p JOIN b{r} ON p.k = b{r}.k
  ) GROUP BY place, k
)"""
        )
        if r < rounds:
            steps.append(
                f"""b{r + 1} AS MATERIALIZED (
  SELECT b.k, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT k, e, list(floor(s / n) ORDER BY i) AS c FROM (
      SELECT k, e, i, sum(y) AS s, count(*) AS n FROM (SELECT p.k, a.m.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM p JOIN a{r} a ON p.place = a.place AND p.k = a.k) GROUP BY k, e, i
    ) GROUP BY k, e
  ) n ON b.k = n.k AND b.e = n.e
)"""
            )
    return (
        "WITH " + ", ".join(steps) + f""", c AS (
  SELECT place, string_agg(format('{{:02x}}', m.e), '' ORDER BY k) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY place
), h AS (
  SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY k, e, i)) AS codebooks_sha256 FROM (SELECT k, e, unnest(c) AS y, unnest(range(len(c))) AS i FROM b{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (place), h
"""
    )
