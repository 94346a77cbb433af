"""Near duplicates by a chosen-path set similarity join.

1. Each document becomes the set of its word shingles. Equal sets form one
   class; its smallest id stands for it from here on.
2. A class has 64 minwise tokens of its set. In each of several independent
   trees a node's classes branch by one more minwise token; nodes of up to
   ``leaf`` classes end the recursion, single ones drop out. Nodes still large
   at the last level are dealt into blocks, each with the node's pivots.
3. Within a leaf every pair is compared by sizes and minwise tokens. Pairs
   that could be similar join candidate groups; a leaf emits a spanning forest.
4. Candidate groups are compared on their full sets, exactly. A group of one
   block is compared exhaustively. A larger one is compared block by block and
   with its pivots; then what is not yet in its largest component is looked up
   by its rarest tokens (``_rare_links``). Only pairs that are connected already,
   or that cannot be linked by how many rare tokens they lack, are left out, so
   documents that merely share a long passage never meet.
5. Links make components; the smallest id of each is kept.

A pair at the threshold s shares a node at depth d with probability s^d, so t
trees miss it with (1 - s^d)^t: at 0.85 and 14 trees 3e-12 for leaves at depth
1, 2e-8 at depth 2 and 2e-6 at depth 3.

Defined cases: null, empty and blank texts have the empty set and are linked
with nothing; texts of fewer words than a shingle are one shingle; texts of any
length count whole; in ``near_duplicates`` rows of one id count as one document
and rows with a null id get no component and are not kept, in
``drop_near_duplicates`` every row is a document of its own; repeated rows are
links of similarity 1; of equal copies the smallest id is kept; an empty table
gives no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import EDGES_A_TASK, HOT_SHARE, LEAST_TASKS, LOWER_TABLE, discard, hash64, label_components, lookup, map_arrow, packed, stage, word_hashes

MINS = 64
#: A pair is a candidate unless its minwise tokens put its similarity this far below the threshold (5 standard deviations).
SLACK = 0.23


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text."""
    hashes, first = word_hashes([(t or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE) for t in texts])
    with np.errstate(over="ignore"):
        mixed = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for j in range(k):
            mixed = hash64(mixed + hashes[j : j + len(mixed)], j + 2)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(mixed[a : b - k + 1]))
        elif b > a:
            value = np.zeros(1, np.uint64)
            for j, h in enumerate(hashes[a:b]):
                value = hash64(value + h, j + 2)
            out.append(hash64(value, 100 + b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, MINS) minwise tokens, 32 bits each; zeros for empty sets."""
    out = np.zeros((len(sets), MINS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        every = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        high = (every >> np.uint64(32)).astype(np.uint32)
        low = every.astype(np.uint32)
        seeds = hash64(np.arange(2 * MINS, dtype=np.uint64), 7).astype(np.uint32) | np.uint32(1)
        with np.errstate(over="ignore"):
            for j in range(MINS):
                x = high * seeds[2 * j] + low * seeds[2 * j + 1]
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x2C1B3C6D)
                x ^= x >> np.uint32(13)
                out[full, j] = np.minimum.reduceat(x, at)
    return out


def _sketch(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """``doc_id, n, set_hash, mins`` of each row."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            mins = minwise(sets)
            hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * MINS, pa.int32()), pa.array(mins.reshape(-1).view(np.int32)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(hashes, pa.binary()), lists], names=["doc_id", "n", "set_hash", "mins"])

        return each

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, make, "doc_id long, n long, set_hash binary, mins array<int>", rows=200)


def _leaves(classes: DataFrame, trees: int, depth: int, leaf: int, pivots: int) -> tuple[DataFrame, list[DataFrame]]:
    """``node, rid`` of the leaves of all trees, and the staged levels that they are read from."""
    coordinate = lambda t, d: F.get("mins", (t + d * trees) % MINS)
    path = F.array(*(F.struct(F.lit(t).alias("t"), F.array(*(coordinate(F.lit(t), d) for d in range(depth))).alias("way")) for t in range(trees)))
    alive = classes.select("rid", F.explode(path).alias("p")).select("rid", F.xxhash64("p.t", F.get("p.way", F.lit(0))).alias("node"), F.slice("p.way", 2, depth - 1).alias("way"))
    total = trees * classes.count()
    found, levels = [], []
    for level in range(depth):
        counts = alive.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = lookup(alive, counts, "node", "size", total)
        # few rows are left below the first level
        sized = stage(sized.coalesce(max(LEAST_TASKS, total // EDGES_A_TASK)) if level else sized, f"level{level}")
        levels.append(sized)
        found.append(sized.where(F.col("size") <= leaf).select("node", "rid"))
        large = sized.where(F.col("size") > leaf)
        total = large.count()
        if not total:
            break
        if level < depth - 1:
            alive = large.select("rid", F.xxhash64("node", F.get("way", F.lit(0))).alias("node"), F.slice("way", 2, depth).alias("way"))
    blocks = F.ceil(F.col("size") / leaf)
    share = F.pmod(F.xxhash64("node", "rid"), F.lit(1 << 30)) / F.lit(1 << 30)
    own = F.pmod(F.xxhash64("rid", "node", F.lit(1)), blocks)
    place = F.when(share < pivots / F.col("size"), F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).otherwise(F.array(own.cast("long")))
    found.append(large.select("node", "rid", F.explode(place).alias("block")).select(F.xxhash64("node", "block").alias("node"), "rid"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out, levels


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows sorted by key, cut where the key changes: a table and where its groups start (one more)."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        keys = table.column(key).to_numpy()
        return table, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield cut(pa.Table.from_batches(held))
            held = []
        if keys[0] == keys[-1]:
            held.append(batch)
        else:
            last = len(keys) - int(np.argmax((keys != keys[-1])[::-1]))
            yield cut(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
    if held:
        yield cut(pa.Table.from_batches(held))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """The components of a symmetric matrix of links as stars: each one's first place beside every other."""
    out, left = [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        if left[root]:
            left[root] = False
            queue = [root]
            for x in queue:
                new = np.flatnonzero(linked[x] & left)
                left[new] = False
                out += [(root, y) for y in new.tolist()]
                queue += new.tolist()
    return out


def _edge_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _candidates(leaves: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Stars of what pairs in leaves that could be similar connect."""
    least = (threshold - SLACK) * MINS
    bytes_of = F.transform("mins", lambda m: m.bitwiseAND(127).cast("tinyint"))
    rows = leaves.join(classes.select("rid", "n", bytes_of.alias("low")), "rid")
    rows = rows.repartition("node").sortWithinPartitions("node", "rid").select("node", "rid", "n", "low")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups_of(batches, "node"):
            rid, n = table.column("rid").to_numpy(), table.column("n").to_numpy()
            low = table.column("low").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, MINS)
            size = np.diff(at)
            first = at[:-1][size == 2]
            fit = ((low[first] == low[first + 1]).sum(1) >= least) & (np.minimum(n[first], n[first + 1]) >= threshold * np.maximum(n[first], n[first + 1]) - 1e-9)
            out = [(rid[first[fit]], rid[first[fit] + 1])]
            for a, m in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
                x, c = low[a : a + m], n[a : a + m]
                same = np.zeros((m, m), np.int16)
                for j in range(MINS):
                    same += x[:, j, None] == x[None, :, j]
                edges = np.array(forest((same >= least) & (np.minimum(c[:, None], c) >= threshold * np.maximum(c[:, None], c) - 1e-9)), np.int64).reshape(-1, 2) + a
                out.append((rid[edges[:, 0]], rid[edges[:, 1]]))
            yield _edge_batch(out)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted distinct sets."""
    m = len(sets)
    owner = np.repeat(np.arange(m), list(map(len, sets)))
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = (count > 1)[inverse]
    owner, column = owner[keep], shared[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        x = np.zeros((m, columns), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        out += x @ x.T
    out[np.arange(m), np.arange(m)] = list(map(len, sets))
    return np.rint(out).astype(np.int64)


def _links(units: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Exact links within units of ``unit, side, rid, shingles``: among side 0,
    and between side 0 and side 1; a star of each component of a unit."""
    num, den = ratio
    rows = units.repartition("unit").sortWithinPartitions("unit", "side", "rid").select("unit", "side", "rid", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups_of(batches, "unit"):
            rid, side = table.column("rid").to_numpy(), table.column("side").to_numpy()
            raw = table.column("shingles").to_pylist()
            out = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                sets = [np.frombuffer(r, np.uint64) for r in raw[a:b]]
                n = np.array(list(map(len, sets)))
                if b - a == 2:
                    shared = np.zeros((2, 2), np.int64)
                    shared[0, 1] = shared[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
                else:
                    shared = intersections(sets)
                linked = (den * shared >= num * (n[:, None] + n - shared)) & (n[:, None] > 0) & ((side[a:b, None] == 0) | (side[None, a:b] == 0))
                edges = np.array(forest(linked), np.int64).reshape(-1, 2) + a
                out.append((rid[edges[:, 0]], rid[edges[:, 1]]))
            yield _edge_batch(out)

    return rows.mapInArrow(compare, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, ratio: tuple[int, int] = (80, 100), trees: int = 14, depth: int = 6, leaf: int = 256, block: int = 256) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of docs; sets
    are linked if ``ratio[1] * intersection >= ratio[0] * union``."""
    threshold = ratio[0] / ratio[1]
    sketch = stage(_sketch(docs, doc_id, text, shingle), "sketch")
    known = sketch.where("n > 0 and doc_id is not null")
    classes = known.groupBy("set_hash").agg(F.min("doc_id").alias("rid"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes, "classes")
    leaves, levels = _leaves(classes, trees, depth, leaf, 32)
    groups = label_components(_candidates(leaves, classes, threshold))
    discard(*levels)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = lookup(groups.select(F.col("node").alias("rid"), "component"), sizes, "component", "size", groups.count())
    texts = docs.select(F.col(doc_id).cast("long").alias("rid"), F.col(text).alias("text"))
    # texts are shuffled to their groups at every size: a broadcast of the members that small inputs allow would not last
    sets = _full_sets(members.join(texts.hint("merge"), "rid"), shingle)
    small = F.col("size") <= block
    blocks = F.ceil(F.col("size") / block).cast("long")
    own = F.pmod(F.xxhash64("rid", F.lit(2)), blocks)
    sets = stage(sets.withColumn("large", ~small).withColumn("blocks", blocks).withColumn("block", F.when(small, F.lit(0)).otherwise(own)), "sets")
    links = _links(sets.where("not large").select(F.col("component").alias("unit"), F.lit(0).alias("side"), "rid", "shingles"), ratio)
    if sets.where("large").limit(1).count():
        links = links.union(_large_links(sets.where("large"), ratio, block))
    final = label_components(links)
    discard(groups, sets)
    # equal sets are of one class and of its component; copies may be a great share of all rows
    placed = classes.join(final.select(F.col("node").alias("rid"), "component"), "rid", "left").select("set_hash", F.coalesce("component", "rid").alias("component"), "copies")
    found = lookup(known.select("doc_id", "n", "set_hash"), placed, "set_hash", "copies", sketch.count()).select("doc_id", "n", "component")
    # one id may stand on texts of several classes, whose least ids differ: these all link it
    bare = sketch.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = found.unionByName(bare)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))
    out.reads = (sketch, classes)  # staged; to be discarded by who has read the result
    return out


def _full_sets(rows: DataFrame, k: int) -> DataFrame:
    """rows with ``shingles`` instead of ``text``."""
    kept = [c for c in rows.columns if c != "text"]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*kept, "shingles"])

        return each

    return map_arrow(rows, make, rows.select(*kept, F.lit(b"").alias("shingles")).schema, rows=200)


def _large_links(sets: DataFrame, ratio: tuple[int, int], block: int) -> DataFrame:
    """Links within candidate groups of more than one block.

    Each block is compared with itself and with the group's pivots, about a
    block of random members: this joins most of what is alike in bulk. What is
    then outside the largest component of its group goes to ``_rare_links``.
    Pairs inside that component need no comparison: they are connected.
    """
    # the pivots stand in each block; other members in their own
    pivot = F.pmod(F.xxhash64("rid", F.lit(3)), F.col("size")) < block
    place = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = sets.select("component", "rid", "shingles", F.explode(place).alias("block")).select(F.xxhash64("component", "block").alias("unit"), F.lit(0).alias("side"), "rid", "shingles")
    labels = label_components(_links(first, ratio))
    named = sets.select("component", "rid", "size").dropDuplicates(["rid"]).join(labels.select(F.col("node").alias("rid"), F.col("component").alias("label")).hint("merge"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    named = stage(named, "labels")
    counts = named.groupBy("component", "label").agg(F.count(F.lit(1)).alias("members"))
    # one row a large group; groups that are one component by now are done
    mains = counts.groupBy("component").agg(F.max_by("label", F.struct("members", F.col("label"))).alias("main"), F.sum("members").alias("members"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    open_ = lookup(named.select("component", "rid", "label"), mains, "component", "members", named.count())
    open_ = open_.select("rid", "label", (F.col("label") != F.col("main")).alias("rest"))
    rows = sets.select("component", "rid", "shingles").join(open_.hint("merge"), "rid").withColumn("sid", F.xxhash64("shingles")).withColumn("n", (F.length("shingles") / 8).cast("int"))
    rows = stage(rows.dropDuplicates(["rid", "sid"]), "open-sets")
    rare = _rare_links(rows, ratio, block)
    discard(named, rows)
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").union(rare)


def _words_of(rows: DataFrame) -> DataFrame:
    """A row a shingle: rows with ``word``, a hash of component and shingle, instead of ``shingles``."""
    kept = [c for c in rows.columns if c != "shingles"]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.frombuffer(r, np.uint64) for r in batch.column("shingles").to_pylist()]
            size = np.array(list(map(len, sets)), np.int64)
            at = pa.array(np.repeat(np.arange(len(sets)), size))
            columns = [batch.column(c).take(at) for c in kept]
            with np.errstate(over="ignore"):
                words = hash64(np.concatenate(sets) + hash64(np.repeat(batch.column("component").to_numpy().view(np.uint64), size), 8), 9)
            return pa.RecordBatch.from_arrays([*columns, pa.array(words.view(np.int64))], names=[*kept, "word"])

        return each

    return map_arrow(rows, make, rows.select(*kept, F.lit(0).cast("long").alias("word")).schema, rows=64)


#: Bands of sizes in one list for each factor by which the sizes of linked sets may differ.
BANDS = 16


def _rare_units(rows: DataFrame, ratio: tuple[int, int], block: int) -> tuple[DataFrame, list[DataFrame]]:
    """What may meet in lists of rare tokens, ``unit, side, rid, sid, n, label, reach``, and the staged tables it is read from; see ``_rare_links``."""
    num, den = ratio
    ids = ["rid", "sid"]
    words = _words_of(rows)
    total = rows.agg(F.sum("n")).first()[0] or 0
    counted = lookup(words, words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "word", "df", total)
    # tokens that no other set has come first and are in no list
    order = counted.groupBy(*ids, "n", "label", "rest").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("shared"))
    entries = order.select(*ids, "n", "label", "rest", F.size("shared").alias("m"), F.posexplode("shared").alias("at", "token"))
    entries = entries.withColumn("left", F.col("m") - F.col("at")).where(F.col("left") * den >= F.col("n") * num)
    entries = entries.withColumn("reach", F.floor(((num + den) * F.col("left") - num * F.col("n")) / num)).select(F.col("token.word").alias("word"), *ids, "n", "label", "rest", "reach")
    entries = stage(entries, "entries")
    lists = entries.groupBy("word").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.max("rest").alias("any"), F.min("label").alias("low"), F.max("label").alias("high"))
    near = lookup(entries, lists.where("k > 1 and any and low < high").select("word", "k", "least"), "word", "k", entries.count()).where("reach >= least")
    # a list falls into bands of sizes: one of rest seeks in the bands it can reach, all are sought in their own
    width = max(math.log(den / num) / BANDS, 1e-3)
    band = lambda n: F.floor(F.log(n.cast("double")) / width).cast("int")
    most = F.least(F.col("reach"), F.floor(F.col("n") * den / num))
    bands = F.when(F.col("rest"), F.sequence(band(F.ceil(F.col("n") * num / den)), band(most)))
    own = [*ids, "n", "label", "reach"]
    at = lambda side: lambda b: F.struct(F.lit(side).alias("side"), F.xxhash64("word", b).alias("cell"))
    places = F.concat(F.array(at(1)(band(F.col("n")))), F.coalesce(F.transform(bands, at(0)), F.array().cast("array<struct<side:int,cell:bigint>>")))
    cells = stage(near.select(*own, F.explode(places).alias("at")).select("at.cell", "at.side", *own), "cells")

    def counted(rows: DataFrame, total: int) -> DataFrame:
        of = lambda side, n: (F.count_if(F.col("side") == side).alias(n), F.min(F.when(F.col("side") == side, F.col("n"))).alias(f"{n}_least"), F.max(F.when(F.col("side") == side, F.col("reach"))).alias(f"{n}_reach"))
        known = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("all"), *of(0, "r"), *of(1, "k")).where("r > 0 and k > 0")
        return lookup(rows, known, "cell", "all", total)

    # what nothing in its cell can meet from the other side is dropped
    met = counted(cells, cells.count()).where("if(side = 0, reach >= k_least and n <= k_reach, reach >= r_least and n <= r_reach)")
    met = stage(met.select("cell", "side", *own, "r", "k"), "met")
    # cells beyond a block are compared in blocks, by what is left in them
    beyond = (F.col("r") > block) | (F.col("k") > block)
    many = met.where(beyond).count()
    units = met.where(~beyond)
    if many:
        units = units.unionByName(counted(met.where(beyond).drop("r", "k"), many).select(*met.columns))
    across, down = F.ceil(F.col("k") / block).cast("long"), F.ceil(F.col("r") / block).cast("long")
    i, j = F.pmod(F.xxhash64(*ids, F.lit(4)), down), F.pmod(F.xxhash64(*ids, F.lit(5)), across)
    seeks = F.col("side") == 0
    units = units.withColumns({"i": i, "j": j, "times": F.sequence(F.lit(0).cast("long"), F.when(seeks, across).otherwise(down) - 1)})
    units = units.select("cell", "side", *own, "i", "j", F.explode("times").alias("time"))
    return units.select(F.xxhash64("cell", F.when(seeks, F.col("i")).otherwise(F.col("time")), F.when(seeks, F.col("time")).otherwise(F.col("j"))).alias("unit"), "side", *own), [entries, cells, met]


def meetings(n: np.ndarray, reach: np.ndarray, other_n: np.ndarray, other_reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may fit: those where the other's reach is at least n, or those where its size is within reach, whichever are fewer."""
    by_reach, by_n = np.argsort(other_reach, kind="stable"), np.argsort(other_n, kind="stable")
    first = np.searchsorted(other_reach[by_reach], n)
    end = np.searchsorted(other_n[by_n], reach, side="right")
    order, a, b = (by_reach, first, np.full(len(n), len(other_n))) if (len(other_n) - first).sum() <= end.sum() else (by_n, np.zeros(len(n), np.int64), end)
    size = b - a
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
    return np.repeat(np.arange(len(n)), size), order[at]


def _rare_links(rows: DataFrame, ratio: tuple[int, int], block: int) -> DataFrame:
    """Links of sets (``component, rid, sid, n, label, rest, shingles``; staged, no set of a rid twice)
    that ``rest`` marks to sets of other labels in their component.

    A set's tokens are ordered from the rarest in its component to the most
    frequent. Two sets meet in the list of their first common token; what they
    share is no more than either has from there on (its ``left``). So a set only
    needs to be in the lists of its first tokens, it can only be linked to sets
    up to a certain size there (``reach``), and lists where nothing of ``rest``
    can reach another label are dropped. Within a list a set of ``rest`` seeks
    only in the bands of sizes that it can reach, and what nothing there can reach
    back is dropped from a band; in a task, sizes and reaches are sorted, so only
    pairs of which one can reach the other are tested at all. Sets that share a
    frequent passage but are too different in what is rare thus never meet,
    however many they are and whatever else is in their lists. Pairs that can
    reach each other are compared on their full sets.
    """
    num, den = ratio
    ids = ["rid", "sid"]
    units, tables = _rare_units(rows, ratio, block)
    units = units.repartition("unit").sortWithinPartitions("unit", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups_of(batches, "unit"):
            c = {name: table.column(name).to_numpy() for name in ("rid", "sid", "n", "label", "reach", "side")}
            found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                mid = a + int(np.searchsorted(c["side"][a:b], 1))
                p, q = meetings(c["n"][a:mid], c["reach"][a:mid], c["n"][mid:b], c["reach"][mid:b])
                p, q = p + a, q + mid
                n, size = c["n"][p], c["n"][q]
                fit = (c["label"][p] != c["label"][q]) & (size <= c["reach"][p]) & (n <= c["reach"][q]) & (den * np.minimum(n, size) >= num * np.maximum(n, size))
                found.append((p[fit], q[fit]))
            p, q = (np.concatenate(v) for v in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c[name][v]) for v in (p, q) for name in ids], names=["x", "xs", "y", "ys"])

    pairs = units.select("unit", "side", *ids, "n", "label", "reach").mapInArrow(meet, "x long, xs long, y long, ys long").distinct()
    pairs = stage(pairs, "pairs")
    needs = pairs.select(F.col("x").alias("rid"), F.col("xs").alias("sid")).union(pairs.select("y", "ys")).groupBy("rid", "sid").agg(F.count(F.lit(1)).alias("n"))
    most = max(PAIRS_A_TASK, 2 * pairs.count() // HOT_SHARE)
    many = stage(needs.where(F.col("n") > most).select("rid", "sid", F.ceil(F.col("n") / PAIRS_A_TASK).cast("long").alias("parts")).coalesce(LEAST_TASKS), "many")
    full = _beside(_beside(pairs, rows, many, "x", "xs", "a_set"), rows, many, "y", "ys", "b_set")

    def verify() -> object:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for a, b in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * shared >= num * (len(a) + len(b) - shared))
            return pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(keep, pa.bool_())), batch.column("y").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

        return each

    links = stage(map_arrow(full, verify, "a long, b long"), "links")
    discard(*tables, pairs, many)
    return links


#: Pairs with one set that one task verifies.
PAIRS_A_TASK = 1000


def _beside(pairs: DataFrame, rows: DataFrame, many: DataFrame, rid: str, sid: str, out: str) -> DataFrame:
    """pairs with the set of one side; a set that many pairs need is sent to several tasks.

    ``many`` has those sets and their ``parts``, at most HOT_SHARE of each side; it is broadcast.
    """
    spread = F.broadcast(many.select(F.col("rid").alias(rid), F.col("sid").alias(sid), F.col("parts").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    keyed = pairs.join(spread, [rid, sid], "left").withColumn("_part", F.pmod(F.xxhash64("x", "xs", "y", "ys"), parts)).drop("_parts")
    sets = rows.select(F.col("rid").alias(rid), F.col("sid").alias(sid), F.col("shingles").alias(out)).join(spread, [rid, sid], "left")
    sent = sets.select(rid, sid, out, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    return keyed.join(sent.hint("merge"), [rid, sid, "_part"]).drop("_part")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id,
    nulls last; of several rows of that id the one with the least hash of its text."""
    rows = stage(packed(docs).withColumn("_at", F.monotonically_increasing_id()), "rows")
    own = F.col("_row")[text]
    found = near_duplicates(rows.select("_at", own.alias("_text")), doc_id="_at", text="_text", **options)
    order = rows.select("_at", F.col("_row")[doc_id].alias("_id"), F.xxhash64(own).alias("_tie"))
    grouped = found.where("n_shingles > 0").join(order.hint("merge"), found["doc_id"] == order["_at"])
    best = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_tie", "_at")).alias("best"))
    kept = stage(best.select(F.col("best._at").alias("_at")).union(found.where("n_shingles = 0").select(F.col("doc_id").alias("_at"))), "kept")
    discard(*found.reads)
    return rows.join(kept.hint("merge"), "_at", "left_semi").select("_row.*")
