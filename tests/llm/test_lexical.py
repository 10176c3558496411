from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from .helpers import ODD, frame, prose

from cytoplan.llm import lexical as lx

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def by_hand(docs, items, top=20):
    """Every document for every item."""
    read = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in read), sum(len(t) for _, t in read)
    df = Counter(w for _, t in read for w in set(t))
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, words in read:
            tf, score = Counter(words), 0
            for w in terms(text):
                if tf[w]:
                    m = 100 - 25 + (25 * len(words) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_every_pair(spark):
    rng = random.Random(4)
    docs = list(ODD) + [(100 + i, " ".join(prose(rng.choice([3, 30, 200]), i))) for i in range(400)]
    docs += [(900, docs[40][1]), (900, docs[40][1]), (None, docs[41][1])]
    items = [(i, " ".join(prose(rng.randrange(1, 40), 1000 + i))) for i in range(90)]
    items += [(500, None), (501, ""), (502, "!?"), (503, "nowhere to be found"), (504, "ÄÖ ONE one ß"), (None, items[0][1]), (0, items[0][1]), (505, docs[40][1][:200])]
    want = by_hand(docs, items)
    assert got(lx.ranked_search(frame(spark, docs, 4), items_of(spark, items))) == want
    assert got(lx.ranked_search(frame(spark, docs, 2), items_of(spark, items), block_bytes=3000)) == want  # in blocks


def test_ties_and_repeats(spark):
    docs = [(i, "alpha beta gamma") for i in range(60, 0, -1)] + [(None, "alpha beta gamma")] + [(5, "alpha beta gamma")] + [(70 + i, "delta epsilon") for i in range(80)]
    items = [(1, "alpha"), (2, "alpha alpha beta"), (2, "alpha alpha beta")]
    want = by_hand(docs, items)
    assert got(lx.ranked_search(frame(spark, docs), items_of(spark, items))) == want
    assert [r[2] for r in sorted(want) if r[0] == 1][:3] == [1, 2, 3]


def test_empty_tables_and_clashing_columns(spark):
    some = [(1, "a b"), (2, "b c")]
    assert got(lx.ranked_search(frame(spark, []), items_of(spark, some))) == []
    assert got(lx.ranked_search(frame(spark, some), items_of(spark, []))) == []
    assert got(lx.ranked_search(frame(spark, [(1, None), (2, " ")]), items_of(spark, some))) == []
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in some + [(3, "d")]], "doc_id long, text string, score string, rank int")
    assert got(lx.ranked_search(docs, items_of(spark, [(1, "a")]))) == by_hand(some + [(3, "d")], [(1, "a")])


def test_long_texts_in_pieces_and_terms_of_one_hash():
    vocabulary, number = lx.Vocabulary.of([b"w1", b"w2", "漢字".encode(), b"zz" * 300])
    texts = [" ".join(prose(3000, 1, 5)) + " W1", None, "漢字,漢字", "zz" * 300 + "." + "zz" * 301, ""]
    for size in (256, 1 << 20):
        total, rows, found, times = lx.term_counts(pa.array(texts), vocabulary, size)
        assert total.tolist() == [len(terms(t)) for t in texts]
        have = {(int(r), int(t)): int(n) for r, t, n in zip(rows, found, times, strict=True)}
        assert have == {(r, number[w.encode()]): n for r, t in enumerate(texts) for w, n in Counter(terms(t)).items() if w.encode() in number}
    same, names = lx.Vocabulary.of([b"aa", b"bb"])
    same.hashes[:] = same.hashes[0]  # as if both had one hash
    same.alike = 2
    data = np.frombuffer(b"aabb", dtype=np.uint8)
    same.marked[:] = True
    same.hashes[:] = lx.hash_spans(data, np.array([0]), np.array([2]))[0]
    assert same.find(data, np.array([0]), np.array([2]))[1].tolist() == [names[b"aa"]]


@pytest.mark.parametrize("seed", range(6))
def test_trees_prune_and_stay_exact(seed):
    rng = np.random.default_rng(seed)
    width, n = 300, 3000
    items = [{int(t): int(rng.integers(1, 9000)) for t in rng.choice(width, rng.integers(1, 12), replace=False)} for _ in range(200)]
    topics = rng.integers(0, 30, n)
    rows = np.repeat(np.arange(n), 8)
    cells = np.unique(np.stack([rows, (topics[rows] * 10 + rng.integers(0, 10, len(rows))) % width]), axis=1)
    values = rng.integers(1, 1_000_000, cells.shape[1])
    best, tree, added = lx.Best(200, 20), lx.ItemTree(items), 0
    for a in range(0, n, 500):
        part = (cells[0] >= a) & (cells[0] < a + 500)
        added += lx.search(tree, best, cells[0][part] - a, cells[1][part], values[part], np.arange(a, a + 500), np.zeros(500, dtype=bool))
    table = np.zeros((n, width), dtype=np.int64)
    table[cells[0], cells[1]] = values
    for place, item in enumerate(tree.order):
        scores = sum(table[:, t] * w for t, w in items[item].items())
        order = np.lexsort((np.arange(n), -scores))[:20]
        order = order[scores[order] > 0]
        assert best.ids[place].tolist() == order.tolist() and best.scores[place].tolist() == scores[order].tolist()
    assert added < n * 200 / 5  # most pairs were pruned
