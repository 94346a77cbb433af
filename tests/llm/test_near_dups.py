"""Near duplicates and components against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cadenza.llm import near_dups
from cadenza.llm.common import label_components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
    flat = [(i, s) for i, group in sets.items() for s in group if s]
    links = [(a, b) for n, (a, x) in enumerate(flat) for b, y in flat[:n] if a != b and den * len(x & y) >= num * len(x | y)]
    return components(sets, links)


def corpus(seed=0, families=25, words=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, words))]
        for _ in range(rng.choice((1, 1, 2, 5))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 6))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    rows += [None, "", "  \t ", "one", "ONE", "two words", rows[0], rows[0].upper(), "shared passage " * 3 + rows[1]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "ratio"), [(3, (85, 100)), (5, (80, 100))])
def test_against_all_pairs(spark, k, ratio):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    out = {r["doc_id"]: r for r in near_dups.near_duplicates(df, shingle=k, ratio=ratio).collect()}
    want = brute(rows, k, *ratio)
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(shingles(dict(rows)[i], k)) for i, r in out.items())


def test_groups_beyond_a_block_stay_whole(spark):
    """A chain of near copies whose ends are unlike, and a family, both many times the block."""
    rng = random.Random(4)
    words = [f"v{i}" for i in range(100_000)]
    text = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(90):
        rows.append((i, " ".join(text)))
        text = list(text)
        text[rng.randrange(len(text))] = rng.choice(words)
    base = [rng.choice(words) for _ in range(200)]
    for i in range(100, 160):
        copy = list(base)
        copy[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dups.near_duplicates(df, shingle=3, ratio=(85, 100), leaf=8, block=8, depth=3).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute(rows, 3, 85, 100)


def test_null_and_repeated_ids_and_the_filter(spark):
    rows = [(None, "a b c d e f g"), (5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (7, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    out = near_dups.near_duplicates(df).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(None, None, False), (5, 3, False), (3, 3, True), (7, 7, True), (8, 8, True)}
    kept = near_dups.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 7, 8]  # a row with a null id is a copy like others
    assert near_dups.near_duplicates(df.limit(0)).count() == 0
    assert near_dups.drop_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    nodes = {n for a, b in links for n in (a, b) if a != b}
    out = label_components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in out.collect()} == {n: c for n, c in components(nodes, [x for x in links if x[0] != x[1]]).items()}
    assert label_components(spark.createDataFrame([], "a long, b long")).count() == 0


def boilerplate(n, seed=5):
    """Documents that share 400 of 446 words, a few of which are in fact near copies of each other."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(400)]
    rows = []
    for i in range(n):
        own = [f"u{rng.randrange(10**9)}" for _ in range(46)]
        rows.append((i, " ".join(own[:20] + common + own[20:])))
    for k in range(5):
        words = rows[k * 7][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((n + k, " ".join(words)))
    return rows


def test_a_passage_that_all_share_is_no_work_of_all_pairs(spark, monkeypatch):
    compared = []
    monkeypatch.setattr(near_dups, "_beside", lambda pairs, *a, inner=near_dups._beside: (compared.append(pairs.count()), inner(pairs, *a))[1])
    for n in (300, 600):
        rows = boilerplate(n)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        out = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(df, shingle=3, ratio=(85, 100), leaf=32, block=32).collect()}
        want = {i: i for i, _ in rows} | {n + k: k * 7 for k in range(5)}
        assert out == want
    assert max(compared) <= 20


def test_mixed_lengths_are_no_work_of_all_pairs(spark):
    """Long sets that share 880 of 1000 tokens and are not linked, and a short one that all of them can reach: tested pairs grow with the sets."""
    import numpy as np

    tested = {}
    for n in (500, 1000, 2000):
        rng = np.random.default_rng(n)
        common = rng.integers(1, 1 << 62, 880).astype(np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(1, 1 << 62, 120).astype(np.uint64)])) for _ in range(n)] + [np.unique(np.concatenate([common, rng.integers(1, 1 << 62, 20).astype(np.uint64)]))]
        rows = [(1, i, i, len(s), i, i > 0, s.tobytes()) for i, s in enumerate(sets)]
        df = spark.createDataFrame(rows, "component long, rid long, sid long, n int, label long, rest boolean, shingles binary").repartition(8)
        units, _ = near_dups._rare_units(df, (85, 100), 64)
        kept = units.toPandas()
        tested[n] = len(kept)
        for _, u in kept.groupby("unit"):
            x, y = u[u.side == 0], u[u.side == 1]
            tested[n] += len(near_dups.meetings(x.n.to_numpy(), x.reach.to_numpy(), y.n.to_numpy(), y.reach.to_numpy())[0])
        if n == 500:
            links = near_dups._rare_links(df, (85, 100), 64).collect()
            assert {(min(r), max(r)) for r in links} == {(i, n) for i in range(n)}
    assert tested[2000] < 2.5 * tested[1000] < 6 * tested[500] and tested[2000] < 2000 * 100, tested


def test_hot_keys_take_the_other_way_to_the_same_result(spark, monkeypatch):
    """With nearly every key counted as hot, stars, classes, nodes and lists are looked up by broadcast."""
    from cadenza.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_SHARE", 10**9)
    rng = random.Random(9)
    links = [(1, i) for i in range(2, 80)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    nodes = {n for a, b in links for n in (a, b) if a != b}
    out = label_components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in out.collect()} == components(nodes, [x for x in links if x[0] != x[1]])
    rows = corpus(seed=3, families=8) + [(1000 + i, "the same text for many documents here") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(df, shingle=3, ratio=(85, 100), leaf=4, block=4, depth=3).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_stars_take_no_step(spark, monkeypatch):
    from cadenza.llm import common

    staged = []
    monkeypatch.setattr(common, "stage", lambda df, tag, inner=common.stage: (staged.append(tag), inner(df, tag))[1])
    links = [(1, i) for i in range(2, 50)] + [(i, 100) for i in range(101, 150)] + [(101, 100), (100, 101), (200, 201)]
    out = label_components(spark.createDataFrame(links, "a long, b long").repartition(8))
    assert {r["node"]: r["component"] for r in out.collect()} == {n: 1 if n < 50 else 100 if n < 200 else 200 for link in links for n in link if n != 100} | {100: 100}
    assert len(staged) == 2, staged


def test_jobs_of_a_large_group_are_few(spark):
    """What a group beyond a block costs before any row of it: jobs, each of as many tasks as there are partitions."""
    rows = boilerplate(300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sc = spark.sparkContext
    sc.setJobGroup("large-group", "")
    out = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(df, shingle=3, ratio=(85, 100), leaf=32, block=32).collect()}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert out == {i: i for i, _ in rows} | {300 + k: k * 7 for k in range(5)}
    jobs = len(sc.statusTracker().getJobIdsForGroup("large-group"))
    assert 0 < jobs <= 180, jobs
