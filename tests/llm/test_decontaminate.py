from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest

from cytoplan.llm import decontaminate as module
from cytoplan.llm.decontaminate import _numbers, contamination, decontaminate, index_items, find_hits, tile_running

from .helpers import ODD, frame, prose


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def tiles_by_hand(doc, item, least):
    """Greedy string tiling as published: again and again the longest unmarked match."""
    marked_doc, marked_item, tiles = [False] * len(doc), [False] * len(item), 0
    while True:
        best, matches = least - 1, []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not marked_doc[i + n] and not marked_item[j + n]:
                    n += 1
                if n > best:
                    best, matches = n, [(i, j)]
                elif n == best and n >= least:
                    matches.append((i, j))
        if not matches:
            return sum(marked_item), tiles
        for i, j in matches:
            if not any(marked_doc[i : i + best]) and not any(marked_item[j : j + best]):
                marked_doc[i : i + best] = marked_item[j : j + best] = [True] * best
                tiles += 1


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_against_brute_force(spark, block_bytes):
    items = [(100, " ".join(prose(30, 1))), (101, " ".join(prose(36, 2))), (102, "Only Three words"), (103, None), (104, " ".join(prose(30, 1))), (None, " ".join(prose(25, 7)))]
    a, b = prose(30, 1), prose(36, 2)
    rows = [
        *ODD,
        (50, " ".join([*prose(40, 3), *a, *prose(40, 4)])),
        (51, ", ".join([*b[18:], "x", *b[:18]]).upper()),
        (52, " ".join([*a[:12], *prose(9, 5), *a[20:]])),
        (53, " ".join([*a[:8], "stop", *b[:9]])),
        (54, "so only three words it is"),
        (55, "only two three words"),
        (56, " ".join([*a[:15], *a[:15], *a[10:25]])),
        (57, " ".join(prose(25, 7) * 2)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.text): {(h.item_id, round(h.coverage, 9), h.tiles) for h in r.hits} for r in contamination(frame(spark, rows), bench, block_bytes=block_bytes).collect()}
    for i, text in rows:
        want = set()
        for item, other in items:
            other = words(other)
            covered, tiles = tiles_by_hand(words(text), other, max(1, min(5, len(other)))) if other else (0, 0)
            if other and covered >= 0.6 * len(other):
                want.add((item, round(covered / len(other), 9), tiles))
        assert got[i, text] == want, (i, text)
    assert {50, 51, 52, 54, 57} <= {i for (i, _), h in got.items() if h}


def test_stage(spark):
    docs = frame(spark, [(1, "nothing to see in this text"), (2, " ".join(prose(30, 1))), (3, None)]).withColumnRenamed("lang", "hits")
    left = decontaminate(docs, spark.createDataFrame([(1, " ".join(prose(30, 1)))], "item_id long, text string"))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 3}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).count() == 3
    assert decontaminate(frame(spark, []), none).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_running_search_by_hand(seed):
    """Texts of very few words, where matches overlap in every way."""
    rng = random.Random(seed)
    doc, item = ([rng.choice("ab" if seed < 3 else "abcdef").encode() for _ in range(n)] for n in (70, 50))
    for width in (1, 2, 3):
        assert tile_running(*_numbers(doc, item), width) == tiles_by_hand(doc, item, width)


@pytest.mark.parametrize("pairs", [0, 8])
def test_both_searches_alike(monkeypatch, pairs):
    rng = random.Random(9)
    monkeypatch.setattr(module, "PAIRS", pairs)
    monkeypatch.setattr(module, "LISTED", 20)
    texts = [" ".join(rng.choices("abcd", k=60)) for _ in range(12)]
    seeds = index_items(list(range(6)), pa.array([" ".join(rng.choices("abcd", k=20)) for _ in range(6)]), 3)
    got = find_hits(pa.array(texts), seeds, 0.4)
    for text, hits in zip(texts, got, strict=True):
        want = {k: tiles_by_hand(words(text), words(seeds.texts[k]), 3) for k in range(6)}
        assert {h["item_id"]: (round(h["coverage"] * 20), h["tiles"]) for h in hits} == {k: x for k, x in want.items() if x[0] >= 8}


def test_repeated_words_and_long_texts():
    """200,000 equal words against an item of 800, and 20 MB around a passage."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(prose(60, 11, 5000))
    filler = " ".join(rng.choices(vocabulary, k=2_000_000))
    seeds = index_items([1, 2], pa.array(["so " * 800, passage]))
    start = time.perf_counter()
    got = find_hits(pa.array(["so " * 200_000, f"{filler} {passage} {filler}", None, ""]), seeds, 0.6)
    assert [[(h["item_id"], h["coverage"]) for h in hits] for hits in got] == [[(1, 1.0)], [(2, 1.0)], [], []]
    assert time.perf_counter() - start < 60
