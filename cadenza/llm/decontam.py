"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the word sequences of all test items. Documents stream
through it; at every word it tells the longest suffix of the document so far
that occurs in an item. Where that length reaches the window, the words it
covers are hit. Items shorter than the window count as one window.

Defined cases: null and empty texts have no words and no hits; items without
words match nothing; a null item id is written as an empty name; equal items
under several ids are all reported; an item of more words than a block is cut
into pieces that share their windows; texts of any length are matched whole;
repeated documents, also of equal or null ids, give equal rows; an empty
benchmark gives no hits, an empty table of documents no rows. ``match_benchmark``
replaces columns that clash with its results, ``decontaminate`` keeps all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, map_arrow, packed, stage, words

#: Words of items in one automaton, which bounds the memory of a Python worker to about 200 MB. A larger benchmark
#: is matched block after block, with the documents staged between, so that no task ever holds two automata.
BLOCK_WORDS = 200_000
#: Blocks whose automata one pass over the documents takes: what is broadcast is bounded by their size, whatever the benchmark's.
BLOCKS_A_PASS = 8


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of words."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for name, sequence in items:
            if sequence:
                ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in sequence]
                sequences.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self._mark(sequences)
        pairs = {(a, b) for _, ids in sequences for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(a * (len(self.vocab) + 1) + b for a, b in pairs), dtype=np.int64)
        self.shortest = min([window, *(len(ids) for _, ids in sequences)])

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The part of state q for strings of length up to that of p and c."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # another item went this way
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        found = self.next[state].get(c)
        return (0, 0) if found is None else (found, length + 1)

    def _mark(self, sequences: list[tuple[str, list[int]]]) -> None:
        """For each state: the items that hold its window; short items that end here."""
        n = len(self.next)
        self.items: list[set[str]] = [set() for _ in range(n)]
        self.short: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for name, ids in sequences:
            state = length = 0
            for c in ids:
                state, length = self.step(state, length, c)
                while self.length[self.link[state]] >= self.window and self.link[state] > 0:
                    state = self.link[state]
                length = min(length, self.window, self.length[state])
                if length == self.window:
                    self.items[state].add(name)
            if len(ids) < self.window:
                self.short[state].append((len(ids), name))
        self.top = list(range(n))  # the state of the suffix of window words
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[up] >= self.window:
                self.top[v] = self.top[up]
            self.short[v] = self.short[v] + self.short[up]

    def encode(self, sequence: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, sequence, repeat(0)), np.int32, len(sequence))

    def match(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans of word positions (end exclusive, apart from each other), names of items, longest match."""
        spans: list[list[int]] = []
        names: set[str] = set()
        longest = 0
        for start, stop in self._runs(ids):
            state = length = 0
            for at, c in enumerate(ids[start:stop].tolist(), start):
                state, length = self.step(state, length, c)
                longest = max(longest, length)
                reach = 0
                if length >= self.window:
                    reach = length
                    names |= self.items[self.top[state]]
                for n, name in self.short[state]:
                    if n <= length:
                        reach = max(reach, n)
                        names.add(name)
                if reach:
                    first = at + 1 - reach
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append([first, at + 1])
        return [(a, b) for a, b in spans], names, longest

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches all of whose neighbouring words are neighbours in some
        item too; shorter ones than any window can hold no hit."""
        if not len(self.vocab) or len(ids) < self.shortest:
            return
        key = ids[:-1].astype(np.int64) * (len(self.vocab) + 1) + ids[1:]
        known = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        joined = np.zeros(len(ids) + 1, bool)  # joined[i]: i - 1 and i go together
        if len(self.pairs) and len(known):
            place = np.minimum(np.searchsorted(self.pairs, key[known]), len(self.pairs) - 1)
            joined[known[self.pairs[place] == key[known]] + 1] = True
        if self.shortest > 1:
            edge = np.diff(np.concatenate([[0], joined[1:-1].view(np.int8), [0]]))
            starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            keep = stops - starts >= self.shortest
            yield from zip(starts[keep].tolist(), stops[keep].tolist())
        else:
            edge = np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]]))
            yield from zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded size; never more than one block is on the driver."""
    block, size, step = [], 0, max(1, most - window + 1)
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        sequence = words(row["t"])
        for at in range(0, max(1, len(sequence) - window + 1), step):
            piece = sequence[at : at + step + window - 1]
            if block and size + len(piece) > most:
                yield block
                block, size = [], 0
            block.append((row["i"] or "", piece))
            size += len(piece)
    yield block


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with ``n_words``, ``hit_starts``, ``hit_ends`` (word positions of
    maximal hit stretches, end exclusive), ``hit_items`` and ``longest_match``.

    Documents are never shuffled: one narrow pass takes each batch of texts past
    BLOCKS_A_PASS automata, one after the other; only a benchmark of more blocks
    has the texts staged for a further pass.
    """
    names = ["n_words", "hit_starts", "hit_ends", "hit_items", "longest_match"]
    kept = [c for c in docs.columns if c not in names]
    rows = packed(docs.select(*kept)).withColumn("text", F.col("_row")[text])
    found = _match(rows, benchmark, item_id, item_text, window, block_words)
    return found.select(*(F.col("_row")[c].alias(c) for c in kept), *names)


def _match(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, window: int, block_words: int, max_span: int | None = None) -> DataFrame:
    """rows (``_row, text``) with the columns of ``match_benchmark``, and ``cut``: the text without hit stretches of over ``max_span`` words, null where there are none.

    It is cut in the pass that finds the stretches, so that a task has one Python worker, not one for either step.
    """
    names = ["n_words", "hit_starts", "hit_ends", "hit_items", "longest_match"]
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32()]
    types = ("long", "array<int>", "array<int>", "array<string>", "int")
    schema = rows.select("_row", "text", *(F.lit(None).cast(t).alias(n) for n, t in zip([*names, "cut"], [*types, "string"]))).schema
    out, last = rows, None
    for blocks in batched(_blocks(benchmark, item_id, item_text, block_words, window), BLOCKS_A_PASS):
        first = out is rows
        if not first:
            out = stage(out, "decontam")
            if last is not None:
                discard(last)
            last = out
        shared = [rows.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window)) for block in blocks]

        def make(shared=shared, first=first):
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = batch.column("text").to_pylist()
                found = [(0, *x) for x in zip(*([[None] * len(texts)] * 4 if first else [batch.column(x).to_pylist() for x in names[1:]]))]
                for one in shared:
                    automaton = one.value
                    found = [_match_one(automaton, t, *x) for t, (_, *x) in zip(texts, found)]
                    if len(shared) > 1:
                        del automaton
                        vars(one).pop("_value", None)  # a worker holds one automaton; the next batch loads it again from its disk
                columns = [list(c) for c in zip(*found)] or [[] for _ in names]
                cut = [None if max_span is None else _cut_longer(t, starts, ends, max_span) for t, (_, starts, ends, *_) in zip(texts, found)]
                return pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("text"), *(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(cut, pa.string())], names=["_row", "text", *names, "cut"])

            return each

        out = map_arrow(out, make, schema)
    return out


def _match_one(automaton: SuffixAutomaton, text: str | None, starts, ends, items, longest) -> tuple:
    sequence = words(text)
    spans, names, length = automaton.match(automaton.encode(sequence)) if sequence else ([], set(), 0)
    if starts:
        merged: list[list[int]] = []
        for a, b in sorted([*spans, *zip(starts, ends)]):
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        spans = merged
    return len(sequence), [a for a, _ in spans], [b for _, b in spans], sorted(names.union(items or ())), max(length, longest or 0)


def hit_words() -> Column:
    return F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def is_contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    """Any hit, and at least one word in ``one_in`` hit."""
    return (n_hit > 0) & (F.lit(one_in) * n_hit >= n_words)


#: The words of decontamination with their places in a text.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut_words(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """text without the stretches of words."""
    if not text or not len(starts):
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(starts, ends):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def _cut_longer(text: str | None, starts: list[int], ends: list[int], most: int) -> str | None:
    """text without the stretches of over ``most`` words; None if there are none."""
    long = [(a, b) for a, b in zip(starts, ends) if b - a > most]
    return cut_words(text, *map(list, zip(*long))) if long else None


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    n_chars: str = "n_chars",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    one_in: int = 20,
    max_span: int | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """docs without contaminated documents (coverage limit ``one_in``).

    With ``max_span``, stretches of more hit words than that are cut out of the
    documents that stay (length limit), and ``n_chars``, where docs have it,
    counts anew.
    """
    rows = packed(docs).withColumn("text", F.col("_row")[text])
    kept = _match(rows, benchmark, item_id, item_text, window, block_words, max_span).where(~is_contaminated(hit_words(), F.col("n_words"), one_in))
    if max_span is None:
        return kept.select("_row.*")
    done = kept.select("_row", F.coalesce("cut", "text").alias("text"))
    new = {text: F.col("text")}
    if n_chars in docs.columns:
        new[n_chars] = F.when(F.col("text") == F.col("_row")[text], F.col("_row")[n_chars]).otherwise(F.length("text").cast(docs.schema[n_chars].dataType))
    return done.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
