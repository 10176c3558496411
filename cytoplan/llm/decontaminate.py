"""Benchmark decontamination by greedy string tiling.

Runs of five words that a document shares with a benchmark item are the seeds; they are found by rolling Karp-Rabin
hashes of the document's words.  Items whose seeds together reach far enough are tiled: for each the longest match is
marked first, then the next longest over words that are unmarked on both sides, and so on down to five words; what an
earlier tile cuts off a match stays as a shorter match.  The share of the item's words under tiles is its coverage: as
tiles may come in any order, passages whose sentences were moved are caught too.  Every match is compared word by word.

Where seeds are few, those on one diagonal join into maximal matches.  Where words repeat so often that the pairs of
seeds would outgrow both texts, the longest common run of unmarked words is searched by running Karp-Rabin over window
lengths instead, which takes memory in proportion to the texts; both give the same tiles.

The benchmark is dealt into blocks of bounded size; each block is a broadcast and one Arrow map over the documents.
The maps follow each other in one stage, so no document is ever shuffled.

Defined cases
-------------
* Null and empty texts have no words and no hits; items without words hit nothing.  An item of fewer than five words
  is hit if all its words stand in a row.
* Very long texts are hashed in pieces; a word and its place are all that is held of them.
* Repeated documents are judged alike; equal items hit alike.  Null ids are carried as they are.
* Of matches of one length, the one that is first in the document is marked first, then the first in the item.
* Hits are ordered by item.  An empty benchmark hits nothing; an empty table gives an empty result.
* Other columns stay, whatever their names; `hits` is added and replaces a column of that name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import fresh, plain, small_batches, tidied
from ._text import _power_tables, chunks, mix, shingles, texts_of, word_hashes, words_of

#: Words of a seed, which is also the shortest tile.
SEED = 5
#: A document is contaminated if tiles cover so much of an item.
COVERAGE = 0.6
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 16 << 20
#: Seeds of several documents that are listed at once.
LISTED = 1 << 20
#: Pairs of seeds that are listed for each word of both texts.
PAIRS = 8

HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.IntegerType())]))
_ARROW_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))


@dataclass
class Seeds:
    """The seeds of a block's items, by width."""

    ids: list[int | None]
    texts: list[str | None]
    lengths: np.ndarray
    #: width -> (sorted hashes, item and place of each)
    by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def index_items(ids: list[int | None], texts: pa.Array, seed: int = SEED) -> Seeds:
    data, offsets = texts_of(texts)
    words, counts = word_hashes(data, offsets)
    widths = np.minimum(counts, seed)
    by_width = {}
    for width in np.unique(widths[widths > 0]):
        chosen = widths == width
        number = np.where(chosen, counts, 0)
        hashes, each = shingles(words[np.repeat(chosen, counts)], number[chosen], int(width))
        item = np.repeat(np.flatnonzero(chosen), each)
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(each) - each, each)
        order = np.argsort(hashes, kind="stable")
        by_width[int(width)] = hashes[order], item[order], place[order]
    return Seeds(ids, texts.to_pylist(), counts, by_width)


def tile(places: np.ndarray, others: np.ndarray, width: int) -> tuple[int, int]:
    """Item words under tiles and the number of tiles, from the seeds' places in the document and in the item."""
    order = np.lexsort((places, places - others))
    places, others = places[order], others[order]
    joined = (np.diff(places) == 1) & (np.diff(others) == 1)
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    runs = np.diff(np.append(first, len(places)))
    heap = [(-int(n + width - 1), int(places[i]), int(others[i])) for i, n in zip(first, runs, strict=True)]
    heapq.heapify(heap)
    marked_doc, marked_item, tiles = set(), set(), 0
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [k for k in range(n) if i + k not in marked_doc and j + k not in marked_item]
        if len(free) == n:
            marked_doc.update(range(i, i + n))
            marked_item.update(range(j, j + n))
            tiles += 1
            continue
        start = 0
        for x in range(1, len(free) + 1):  # what is left of it, piece by piece
            if x == len(free) or free[x] != free[x - 1] + 1:
                if x - start >= width:
                    heapq.heappush(heap, (-(x - start), i + free[start], j + free[start]))
                start = x
    return len(marked_item), tiles


def tile_running(doc: np.ndarray, item: np.ndarray, width: int) -> tuple[int, int]:
    """The same from the words' numbers, by the longest common run of unmarked words again and again."""
    up, down = _power_tables(max(len(doc), len(item)) + 1)
    sides = []
    for words in (doc, item):
        prefix = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(mix(words.astype(np.uint64)) * up[: len(words)], out=prefix[1:])
        sides.append((prefix, np.zeros(len(words), dtype=bool)))

    def runs(side: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where unmarked runs of the length begin, and their hashes."""
        prefix, marked = sides[side]
        sums = np.append(0, np.cumsum(marked))
        at = np.flatnonzero(sums[length:] == sums[: len(sums) - length])
        return at, (prefix[at + length] - prefix[at]) * down[at]

    def common(length: int) -> bool:
        return bool(np.isin(runs(0, length)[1], runs(1, length)[1]).any())

    longest, tiles = min(len(doc), len(item)), 0
    while longest >= width and common(width):
        low, high = width, longest  # a common run has common parts
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        (starts, hashes), (places, others) = runs(0, low), runs(1, low)
        order = np.argsort(others, kind="stable")
        places, others = places[order], others[order]
        first, last = np.searchsorted(others, hashes, side="left"), np.searchsorted(others, hashes, side="right")
        ahead: dict[int, int] = {}  # of each hash, the first place that isn't used up
        end = 0
        for k in np.flatnonzero(last > first):
            i = int(starts[k])
            if i < end:
                continue
            x = ahead.get(int(first[k]), int(first[k]))
            while x < last[k] and (sides[1][1][places[x] : places[x] + low].any() or not np.array_equal(doc[i : i + low], item[places[x] : places[x] + low])):
                x += 1
            ahead[int(first[k])] = x
            if x < last[k]:
                sides[0][1][i : i + low] = True
                sides[1][1][places[x] : places[x] + low] = True
                tiles += 1
                end = i + low
        longest = low - 1
    return int(sides[1][1].sum()), tiles


def _numbers(doc: list[bytes], item: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    held: dict[bytes, int] = {}
    one, two = ([held.setdefault(w, len(held)) for w in words] for words in (doc, item))
    return np.array(one, dtype=np.int64), np.array(two, dtype=np.int64)


def covered_words(doc: list[bytes], item: list[bytes], at: np.ndarray, seeds: np.ndarray, places: np.ndarray, item_seeds: np.ndarray, width: int) -> tuple[int, int]:
    """Item words under tiles, and tiles: `at` and `places` are where the shared seeds stand, `seeds` and `item_seeds` which."""
    order = np.argsort(item_seeds, kind="stable")
    places, item_seeds = places[order], item_seeds[order]
    low, high = np.searchsorted(item_seeds, seeds, side="left"), np.searchsorted(item_seeds, seeds, side="right")
    times = high - low
    if times.sum() > PAIRS * (len(doc) + len(item)):
        return tile_running(*_numbers(doc, item), width)
    which = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
    one, two = np.repeat(at, times), places[which]
    same = np.fromiter((doc[i : i + width] == item[j : j + width] for i, j in zip(one.tolist(), two.tolist(), strict=True)), dtype=bool, count=len(one))
    return tile(one[same], two[same], width) if same.any() else (0, 0)


def find_hits(texts: pa.Array, seeds: Seeds, threshold: float) -> list[list[dict]]:
    """For every text the items that it contains."""
    data, offsets = texts_of(texts)
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    tables = {}
    for width, (hashes, _, _) in seeds.by_width.items():
        tables[width] = table = np.zeros(1 << 20, dtype=bool)
        table[hashes & np.uint64((1 << 20) - 1)] = True
    for a, b in chunks(offsets):
        words, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for width, (hashes, item, place) in seeds.by_width.items():
            enough = counts >= width
            rolled, each = shingles(words[np.repeat(enough, counts)], counts[enough], width)
            maybe = np.flatnonzero(tables[width][rolled & np.uint64((1 << 20) - 1)])
            low = np.searchsorted(hashes, rolled[maybe], side="left")
            high = np.searchsorted(hashes, rolled[maybe], side="right")
            maybe, low, high = maybe[high > low], low[high > low], high[high > low]
            doc = np.repeat(np.arange(len(each)), each)[maybe]
            at = maybe - (np.cumsum(each) - each)[doc]
            rows = a + np.flatnonzero(enough)
            # each seed of a document is listed with all its places in items once, however often the document repeats it
            first = np.unique(doc * (len(hashes) + 1) + low, return_index=True)[1]
            cost, whose = np.cumsum((high - low)[first]), doc[first]
            start = 0
            while start < len(first):
                end = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + LISTED, side="right")))
                end = int(np.searchsorted(whose, whose[end - 1], side="right"))
                part = first[start:end]
                times = (high - low)[part]
                which = np.repeat(low[part] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                of, by = np.repeat(doc[part], times), np.repeat(low[part], times)
                order = np.lexsort((item[which], of))
                which, of, by = which[order], of[order], by[order]
                cut = np.flatnonzero((np.diff(of) != 0) | (np.diff(item[which]) != 0)) + 1
                split: tuple[int, list[bytes]] = (-1, [])
                for x, y in zip(np.append(0, cut), np.append(cut, len(of)), strict=True):
                    k, row = int(item[which[x]]), int(rows[of[x]])
                    length = int(seeds.lengths[k])
                    reach = np.unique(place[which[x:y]])
                    if len(reach) + np.minimum(np.diff(reach, append=reach[-1] + width) - 1, width - 1).sum() < threshold * length:
                        continue  # all seeds together don't reach far enough
                    if split[0] != row:
                        split = row, words_of(texts[row].as_py())
                    here = slice(*np.searchsorted(doc, [of[x], of[x] + 1]))
                    covered, tiles = covered_words(split[1], words_of(seeds.texts[k]), at[here], low[here], place[which[x:y]], by[x:y], width)
                    if covered >= threshold * length:
                        out[row].append({"item_id": seeds.ids[k], "coverage": covered / length, "tiles": tiles})
                start = end
    for found in out:
        found.sort(key=lambda h: (h["item_id"] is not None, h["item_id"]))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, block_bytes: int = BLOCK_BYTES, into: str = "hits") -> DataFrame:
    """The documents with a column `into`: item_id, coverage and tiles of every benchmark item that they contain."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(into)
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out, names, at = plain(docs), [], docs.columns.index("text")
    own = out.columns
    for k in range(blocks):
        held = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        shared = spark.sparkContext.broadcast(index_items(held["item_id"].to_pylist(), held["text"]))
        name = fresh("hits")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = find_hits(batch.column(at), shared.value, threshold)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW_HITS)], names=[*batch.schema.names, name])

        out = out.mapInArrow(tidied(run), T.StructType([*out.schema, T.StructField(name, HITS)]))
        names.append(name)
    return out.select(*own, F.array_sort(F.flatten(F.array(*names)))).toDF(*docs.columns, into)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """The documents that contain no benchmark item, with their columns as they were."""
    name = fresh("hits")
    return contamination(docs, benchmark, into=name, **options).filter(F.size(name) == 0).drop(name)
