"""Interaction of five filters by packed bitmaps.

Every document gets a bit for each filter that it fails. Within a task, rows
are laid out part by part and their bits packed into 64-bit words: a bitset for
each filter, label and part. A subset of filters leaves what is in the part
AND-NOT in the bitset of any of its filters; its popcount, and that of it AND a
label, are all that a task hands on: 32 subsets, three counts, a part. Counts
of partitions are summed; all orders of the filters are differences of them.

A copy is found by a 128-bit hash of the whole text and the smallest id that
has it, so no text is shuffled and no group of copies meets in one task.

Defined cases: a null text is an empty one, so null and empty texts are copies
of each other; texts of any length are read whole; rows of equal id and text
are not copies of each other, as neither id is smaller; a null id is smaller
than none, no id is smaller than it, and it has no labels; of several labels of
an id any one counts; the null part is the empty string; an empty table gives no
rows; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import lookup, map_arrow, stage

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
_BLANK = re.compile(rb"[\x20\t-\r]")
_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))
#: Bytes of a text that are split into words at once.
STRETCH = 1 << 20
#: Parts whose counts a task holds before it hands them on.
PARTS_HELD = 2000


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        edge = _BLANK.search(text, at + STRETCH)
        end = edge.start() if edge else len(text)
        found = text[at:end].split()
        n += len(found)
        seen.update(found)
        at = end
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    marked = len(text) > len(text.translate(None, _MARKS))
    return (n < 100) | (100 * len(seen) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | marked << 3


def failed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(doc_id, part, mask, first)``: the filters that each document fails, E among them."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t.as_py() or b"" for t in batch.column(2)]
            keys = [blake2b(t, digest_size=16).digest() for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(failures, texts), pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "part", "mask", "copy"])

        return each

    columns = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").cast("binary").alias("text"))
    rows = stage(map_arrow(columns, make, f"doc_id {kind}, part string, mask int, copy binary"), "failed")
    firsts = rows.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = lookup(rows, firsts, "copy", "n", rows.count())
    is_copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return found.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(is_copy, 16).otherwise(0)).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with ``good`` and ``toxic``: whether the id has such a label."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    named = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left").select(*rows.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    # null ids have no label; joined, they would all meet in one task
    return named.unionByName(rows.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def packed_counts(part: np.ndarray, n_parts: int, mask: np.ndarray, labels: list[np.ndarray]) -> np.ndarray:
    """Rows that each subset of filters leaves, and those of them with each label: ``[part, subset, 1 + label]``.

    ``part`` numbers the rows' parts. The rows of a part fill words of their own.
    """
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part, minlength=n_parts)
    words = np.maximum((sizes + 63) // 64, 1)
    starts = np.concatenate([[0], np.cumsum(words)])
    place = np.repeat(starts[:-1] * 64 - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(part))

    def bitset(rows: np.ndarray) -> np.ndarray:
        bits = np.zeros(starts[-1] * 64, bool)
        bits[place] = rows[order]
        return np.packbits(bits, bitorder="little").view(np.uint64)

    fails = [bitset(mask >> f & 1 > 0) for f in range(len(FILTERS))]
    marks = [bitset(x) for x in labels]
    left = [bitset(np.ones(len(part), bool))]
    for subset in range(1, SUBSETS):
        low = (subset & -subset).bit_length() - 1
        left.append(left[subset & (subset - 1)] & ~fails[low])
    counts = [[np.add.reduceat(np.bitwise_count(x if m is None else x & m).astype(np.int64), starts[:-1]) for m in (None, *marks)] for x in left]
    return np.array(counts).transpose(2, 0, 1)


def subset_counts(rows: DataFrame) -> DataFrame:
    """``(part, subset, n, good, toxic)``: what each subset of filters leaves of each part, over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            every = np.stack(list(held.values()))
            columns = [pa.array(np.repeat(np.array(list(held), object), SUBSETS), pa.string()), pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(held))), *(pa.array(every[:, :, k].ravel()) for k in range(3))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "subset", "n", "good", "toxic"])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            flags = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]
            found = packed_counts(coded.indices.to_numpy(), len(coded.dictionary), batch.column(1).to_numpy(), flags)
            for name, counts in zip(coded.dictionary.to_pylist(), found):
                held[name] = held[name] + counts if name in held else counts
            if len(held) > PARTS_HELD:
                yield flush()
        if held:
            yield flush()

    found = rows.select("part", "mask", "good", "toxic").mapInArrow(run, "part string, subset int, n long, good long, toxic long")
    return found.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


#: All orders, each step's filter, and the subsets before and after it.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_STEPS = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
_AFTER = np.cumsum(1 << _STEPS, axis=1)
_BEFORE = _AFTER - (1 << _STEPS)


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order of the filters and step: what is kept, removed, redundant, lost; see the module."""
    counts = subset_counts(with_labels(failed(docs, **columns), labels))
    # 32 rows a part
    whole = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("s"))
    whole = whole.select("part", *(F.col(f"s.{c}").alias(c) for c in ("n", "good", "toxic")))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def make():
        filters, before, after = _STEPS.ravel(), _BEFORE.ravel(), _AFTER.ravel()
        orders, steps = np.repeat(np.array(ORDERS, object), len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, good, toxic = (batch.column(k).flatten().to_numpy().reshape(-1, SUBSETS) for k in (1, 2, 3))
            removed = n[:, before] - n[:, after]
            fails = n[:, [0]] - n[:, 1 << filters]
            unique = n[:, SUBSETS - 1 - (1 << filters)] - n[:, [SUBSETS - 1]]
            shares = np.stack([removed[:, filters == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)[:, filters]
            values = (n[:, after], removed, fails - removed, unique, good[:, before] - good[:, after], toxic[:, before] - toxic[:, after], shares)
            rows = len(n)
            parts = np.repeat(np.array(batch.column(0).to_pylist(), object), len(orders))
            return pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.string()), pa.array(np.tile(orders, rows), pa.string()), pa.array(np.tile(steps, rows)), *(pa.array(v.ravel()) for v in values)], ["part", "filter_order", "step", *names]
            )

        return each

    return map_arrow(whole, make, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names), rows=100)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(min(w.doc_id) OVER (PARTITION BY t) < w.doc_id, false) AS INT) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f AS (
  SELECT unnest(range(5)) AS i, unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS fs
  FROM f a JOIN f b ON b.i <> a.i JOIN f c ON c.i NOT IN (a.i, b.i) JOIN f d ON d.i NOT IN (a.i, b.i, c.i) JOIN f e ON e.i NOT IN (a.i, b.i, c.i, d.i)
), s AS (
  SELECT filter_order, step, 1 << fs[step] AS bit, CAST(coalesce(list_sum(list_transform(fs[1 : step - 1], lambda k: 1 << k)), 0) AS BIGINT) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
