from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cytoplan.llm.components import connected_components
from cytoplan.llm.near_dedup import IDF_RANGE, Sampler, counted_shingles, drop_near_duplicates, near_duplicates, prefix_pairs, token_rows, weighted_jaccard

from .helpers import ODD, frame, prose

DATA = "/root/testdata/sf0.01"


def shingle_counts(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    if 0 < len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def classes_by_hand(rows):
    """All pairs, with exact document frequencies (the tables are too small for classes of shingles to collide)."""
    bags = [shingle_counts(t) for _, t in rows]
    held = Counter(s for b in bags for s in b)
    n = len(rows)
    weight = {s: 1 + IDF_RANGE * np.log((n + 1) / (m + 1)) / np.log(n + 2) for s, m in held.items()}
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if bags[i] and bags[j]:
                both = sum(weight[s] * min(c, bags[j][s]) for s, c in bags[i].items() if s in bags[j])
                whole = sum(weight[s] * c for b in (bags[i], bags[j]) for s, c in b.items()) - both
                if both / whole >= 0.8:
                    parent[find(i)] = find(j)
    out = defaultdict(set)
    for i, (doc, _) in enumerate(rows):
        out[find(i)].add(doc)
    return {frozenset(x) for x in out.values()}


def classes(spark, rows):
    got = defaultdict(set)
    out = near_duplicates(frame(spark, rows)).collect()
    for r in out:
        got[r.class_id].add(r.doc_id)
    assert len(out) == len(rows)
    assert all(k == min(v) for k, v in got.items())
    return {frozenset(x) for x in got.values()}


def test_against_brute_force(spark):
    rng, rows = random.Random(1), []
    for g in range(12):
        base = prose(120 + 20 * g, 1000 + g)
        for _ in range(1 + g % 5):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(prose(100, 5000 + k))) for k in range(20)]
    rows += [(900, "one two"), (901, "One, two!"), (902, "two one"), (903, ""), (904, None), (905, "...")]
    assert classes(spark, rows) == classes_by_hand(rows)


def test_large_group_of_copies_holds_together(spark):
    base, rng, rows = prose(200, 3), random.Random(2), []
    for i in range(400):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = f"c{i}"
        rows.append((i, " ".join(copy if i % 2 else base)))
    assert classes(spark, rows) == {frozenset(range(400))}


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    sampler = Sampler(400)
    a = rng.integers(0, 1 << 48, 300, dtype=np.uint64)
    b = np.concatenate([a[:220], rng.integers(0, 1 << 48, 80, dtype=np.uint64)])
    wa, wb = np.linspace(1, 2, 300), np.concatenate([np.linspace(1, 2, 300)[:220] * 1.1, np.ones(80)])
    one, two = (sampler.draw(h * np.uint64(0x9E3779B97F4A7C15), np.log(w), np.array([0])) for h, w in ((a, wa), (b, wb)))
    both = np.minimum(wa[:220], wb[:220]).sum()
    assert abs((one == two).mean() - both / (wa.sum() + wb.sum() - both)) < 0.08


def test_shingles_of_batches_with_nulls():
    texts = ["a b c d e f", None, "", "a b", "ÄÄ b c d e", "b c d e f"]
    got = {}
    for a, _, row, hashes, count in counted_shingles(pa.array(texts)):
        for r, h, c in zip(row, hashes, count, strict=True):
            got.setdefault(a + r, []).append((h, c))
    assert [len(got.get(i, [])) for i in range(6)] == [2, 0, 0, 1, 1, 1]
    assert got[5][0] in got[0]


def test_odd_cases_and_stage(spark):
    docs = frame(spark, ODD).withColumnsRenamed({"lang": "class_id", "source": "_key", "n_chars": "_lost"})
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, None]))
    assert near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_similar_texts_in_large_mixed_buckets_meet(spark):
    """Pairs of texts that share most words with all others, but not enough: the buckets are large and hold many classes."""
    base, rng, rows = prose(200, 11), random.Random(4), []
    for g in range(150):
        own = prose(18, 9000 + g)
        for _ in range(2):
            copy = base + own
            for _ in range(2):
                copy[rng.randrange(200)] = f"c{len(rows)}"
            rows.append((len(rows), " ".join(copy)))
    want = classes_by_hand(rows)
    assert sum(len(x) == 2 for x in want) > 100
    assert classes(spark, rows) == want


def test_prefix_pairs_leave_no_similar_pair_out(spark):
    rng, idf, rows = np.random.default_rng(3), np.ones(1 << 16), []
    for i in range(60):
        near = rng.permutation(40)[: 34 + i % 6]
        rows.append((i, i % 7, np.sort(near.astype("<u8")).tobytes()))
    members = spark.createDataFrame(rows, "node long, class long, shingles binary")
    got = {(r.one, r.two) for r in prefix_pairs(token_rows(members, spark.sparkContext.broadcast(idf), 0.8), 0.8).collect()}
    want = {(i, j) for i, a, x in rows for j, b, y in rows if i < j and a != b and weighted_jaccard(x, y, idf) >= 0.8}
    assert want and want <= got and all(i % 7 != j % 7 for i, j in got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables aren't here")
def test_recall_on_the_given_table(spark):
    """Every pair of the table with a plain similarity of 0.8 or more, and none far below it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bags = {r.doc_id: shingle_counts(r.text) for r in docs.collect()}
    where = defaultdict(list)
    for i, bag in bags.items():
        for s in bag:
            where[s].append(i)
    met = Counter((i, j) for s, ids in where.items() for i in ids for j in ids if i < j)

    def similarity(i, j):
        both = sum(min(c, bags[j][s]) for s, c in bags[i].items() if s in bags[j])
        return both / (sum(bags[i].values()) + sum(bags[j].values()) - both)

    alike = {(i, j): x for i, j in met if (x := similarity(i, j)) >= 0.6}
    near = [p for p, x in alike.items() if x >= 0.8]
    found = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert len(near) > 100 and np.mean([found[i] == found[j] for i, j in near]) >= 0.99
    classes = defaultdict(list)
    for i, c in found.items():
        classes[c].append(i)
    # whoever is in a class has a partner in it that is about as alike as asked
    for members in (x for x in classes.values() if len(x) > 1):
        assert all(any(alike.get((min(i, j), max(i, j)), 0) >= 0.78 for j in members if j != i) for i in members)


def test_a_very_long_text(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    long = " ".join(rng.choices(words, k=2_000_000))
    assert classes(spark, [(1, long), (2, long + " more"), (3, "a short text of six words")]) == {frozenset([1, 2]), frozenset([3])}


def test_a_crowd_by_changes_against_a_centre_loses_no_link(spark):
    """A base, near copies of it, texts that have changed too much, and a near copy of every fifth of those."""
    rng, idf, bags = np.random.default_rng(8), np.ones(1 << 16), []
    others = np.arange(1 << 30, (1 << 30) + 400)  # so many that most are in several texts
    single = iter(range(1 << 31, 1 << 32))
    base = np.arange(1000, 1200)

    def changed(bag, n):
        return np.concatenate([np.delete(bag, rng.permutation(len(bag))[:n]), rng.permutation(others)[: n - n // 2], [next(single) for _ in range(n // 2)]])

    bags = [base, *(changed(base, n) for n in (3, 8, 15, 18) for _ in range(5))]
    for i in range(150):
        bags.append(changed(base, 23 + i % 9))
        if i % 5 == 0:
            bags.append(changed(bags[-1], 6))
    rows = [(i, i, np.sort(x.astype("<u8")).tobytes()) for i, x in enumerate(bags)]
    members = spark.createDataFrame(rows, "node long, class long, shingles binary")
    shared = spark.sparkContext.broadcast(idf)
    tokens = token_rows(members, shared, 0.8)
    alike = {(i, j) for i, _, x in rows for j, _, y in rows if i < j and weighted_jaccard(x, y, idf) >= 0.8}
    got = {(r.one, r.two) for r in prefix_pairs(tokens, 0.8, members, shared).collect()}

    def joined(pairs):
        parent = list(range(len(rows)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in pairs:
            parent[find(i)] = find(j)
        first = {}
        return [first.setdefault(find(i), i) for i in range(len(rows))]

    assert sum(i > 20 for i, _ in alike) >= 30 and joined(got & alike) == joined(alike)
