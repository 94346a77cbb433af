"""Mixing sources to target weights.

Each source gets a budget of words. Its documents get hash-random keys, are
sorted by key in range buckets, and distributed prefix sums of their sizes
tell where the budget cuts, to the word. A budget beyond the source's size
repeats whole epochs first.

Defined cases: a null source is a source of its own and sorts last; a null or
empty text has size 0 and is taken 0 times; a text of any length is cut within
by whole words, and what stays keeps its white space; rows of equal or null ids
are rows of their own, in the order of a hash of id and text; rows that are
equal in all columns are told apart by their place in the table, which changes
no result; an empty table gives no rows; columns of the input may have any
names, those of the results included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import HOT_ROWS, HOT_SHARE, discard, lookup, packed, prefix_sums, range_sorted, stage

#: The separators of words.
SEPARATOR = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SEPARATOR}]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Targets of sources: ``share`` of all sizes dealt by weight, no more than
    ``cap`` times a source's size, the excess dealt again by weight.

    With sources sorted by cap / weight, the level that fills all those that
    stay below their cap is the largest of the levels that remain after each
    prefix of capped sources. Places and prefixes are prefix sums over ranges,
    so there may be any number of sources.
    """
    one = F.lit(1).cast("long")
    named = range_sorted(sources.withColumn("_one", one), F.col("_null"), F.col("_name"))
    placed = prefix_sums(named.withColumn("_all", F.lit(0)), ["_all"], [F.col("_at")], {"_place": "_one"}, "_task").drop("_task", "_at")
    turns = F.array(*map(F.lit, weights))
    placed = placed.withColumn("weight", F.element_at(turns, (F.col("_place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(cap))
    by_ratio = range_sorted(placed, F.col("cap") / F.col("weight"), F.col("_place"))
    total, weight = by_ratio.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    levels = prefix_sums(by_ratio, ["_all"], [F.col("_at")], {"_caps": "cap", "_weights": "weight"}, "_task")
    level = levels.agg(F.max((F.lit(total * share) - F.col("_caps")) / (F.lit(weight) - F.col("_weights")))).first()[0]
    done = by_ratio.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)).cast("double")).select("_null", "_name", "source_size", "target", "n")
    done = stage(done, "mix-sources")
    discard(named, by_ratio)
    return done


def _planned(base: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """base (``_null, _name, key, size`` and more; staged) with ``source_size, target, taken, epochs``."""
    counts = base.groupBy("_null", "_name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = water_fill(counts, weights, share, cap)
    rows = base.count()
    # rows of one key may be many (equal rows): these are spread over buckets of their own behind the others of their bucket
    hot = base.groupBy("_null", "_name", "key").agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > max(HOT_ROWS, rows // HOT_SHARE))
    base = base.join(F.broadcast(hot), ["_null", "_name", "key"], "left").withColumn("_source", F.struct("_null", "_name"))
    joined = lookup(base, sources.select(F.struct("_null", "_name").alias("_source"), "source_size", "target", "n"), "_source", "n", rows)
    # about sqrt(n) buckets of sqrt(n) rows: both levels of the sum stay small
    part = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    parts = F.floor(part * F.ceil(F.sqrt("n")) / F.lit(2**32)).cast("long")
    salt = F.pmod(F.xxhash64("_at"), F.ceil(F.sqrt("_copies")))
    crowd = F.col("_copies").isNotNull()
    joined = joined.withColumn("_bucket", F.struct(parts.alias("part"), F.when(crowd, F.col("key")).otherwise("").alias("key"), F.when(crowd, salt).otherwise(0).alias("salt")))
    summed = prefix_sums(joined, ["_null", "_name"], [F.col("key"), F.col("_at")], {"before": "size"}, "_bucket")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.least(F.greatest(budget - F.col("epochs") * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    return summed.withColumn("epochs", epochs.cast("long")).withColumn("taken", (F.col("epochs") * F.col("size") + rest).cast("long"))


def _keyed(rows: DataFrame, doc_id: Column, source: Column, text: Column, seed: str, *more: Column, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows with ``_null, _name, size, key, _at`` and without ``drop``, staged."""
    name = source.cast("string")
    key = F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), text, *more).cast("binary"))
    columns = {"_null": name.isNull(), "_name": F.coalesce(name, F.lit("")), "size": word_count(text), "key": key, "_at": F.monotonically_increasing_id()}
    return stage(rows.withColumns(columns).drop(*drop), "mix")


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """Words that the mix takes from each document.

    Returns ``doc_id, source, size, source_size, target, taken, epochs``:
    ``taken`` counts words with repeats; whole epochs come first, then the
    documents in the order of their keys until the budget, where the last one
    is cut. Reruns agree, since keys depend on id, text and seed only.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    base = _keyed(rows, F.col("doc_id"), F.col("source"), F.col("text"), seed, drop=("text",))
    return _planned(base, weights, share, cap).select("doc_id", "source", "size", "source_size", "target", "taken", "epochs")


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word."""
    # a piece ends with a word; a last one may be of separators only
    pieces = F.split(text, rf"(?<=[^{SEPARATOR}])(?=[{SEPARATOR}])")
    return F.array_join(F.slice(pieces, F.lit(1), n), "")


def apply_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    n_chars: str = "n_chars",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """The mixed corpus: each document's text as often as its epochs, then the
    words of the cut. The columns of docs stay; ``n_chars``, where there is
    one, counts anew. Whole rows travel with their keys, so nothing is joined
    by id. Rows differ in order from ``mix_sources`` where ids and texts are
    equal but other columns are not."""
    rows = packed(docs)
    others = [F.col("_row")[c].cast("string") for c in docs.columns if c not in (doc_id, text) and docs.schema[c].dataType.typeName() not in ("map", "binary", "variant")]
    base = _keyed(rows, F.col("_row")[doc_id], F.col("_row")[source], F.col("_row")[text], seed, *(F.coalesce(x, F.lit("")) for x in others))
    planned = _planned(base, weights, share, cap).where(F.col("taken") > 0)
    own = F.col("_row")[text]
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    cut = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(own, whole), F.when(cut > 0, F.array(first_words(own, cut))).otherwise(F.array().cast("array<string>")))
    out = planned.select("_row", F.explode(copies).alias("_text"))
    new = {text: F.col("_text")}
    if n_chars in docs.columns:
        new[n_chars] = F.length("_text").cast(docs.schema[n_chars].dataType)
    return out.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
