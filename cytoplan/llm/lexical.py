"""Ranked lexical search for a stated set of items, exact, by two trees.

1. One Arrow map reads every document once and keeps what it holds of the items' terms: how often each, and how many
   terms the document has in all.  The table is written to the shared folder; counts over it give the number of
   documents, all terms, and how many documents hold each term.
2. A document is a vector of whole numbers, for each term how much it saturates; an item is one of term weights times
   repeats.  A score is their product, and no coordinate is negative.
3. Items stand in a tree of eight children a node, documents of a batch in one of sixteen; both are sorted so that
   vectors with the same strongest term are neighbours.  A node holds the maxima of its members' coordinates, so the
   product of two nodes is at least the score of any member with any other.
4. Both trees are descended together.  A pair of nodes is pruned, with all its members, if its product is below the
   weakest kth score of the node's items so far.  Scores that are left are added up in 64-bit integers.
5. A task hands on its best documents of each item; the best of all are found in two steps, so that no task meets what
   all others have handed on for an item.

Items are dealt into blocks of bounded size; each block is read, counted and searched on its own.  Documents are never
shuffled, and no row is made for a pair of an item and a document but those that are handed on.

Defined cases
-------------
* Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.  Null and empty texts have none;
  such documents are found by no item and such items find none.
* Very long texts are read in pieces that end between terms.
* Ties go to the smaller doc_id, null ids last.  Repeated documents, and rows that share an id, take a rank each; so do
  repeated items, each of which is answered on its own.
* Empty tables give empty results.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import keep, small_batches
from ._text import _LOWER, _WORD, CHUNK_BYTES, chunks, cut_between, hash_spans, texts_of, word_spans, words_of

TOP = 20
#: Bytes of item texts in a block.
BLOCK_BYTES = 4 << 20
#: Children of a node of items and of documents.
ITEMS_A_NODE, DOCS_A_NODE = 8, 16
#: Documents of a batch, and numbers in its table, at most; the first batch of a task is smaller, to have scores to prune with.
BATCH, NUMBERS, FIRST = 2048, 1 << 22, 256
#: What floating point may be wrong by.
SLACK = 1e-9

RESULT = "item_id long, rank int, doc_id long, score long"


@dataclass
class Vocabulary:
    """The terms of a block of items, in the order of their hashes."""

    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    #: How many terms share a hash, at most.
    alike: int
    marked: np.ndarray

    @classmethod
    def of(cls, terms: list[bytes]) -> tuple[Vocabulary, dict[bytes, int]]:
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        data = np.frombuffer(b"".join(terms), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        hashes = hash_spans(data, starts, starts + sizes)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        marked = np.zeros(1 << 20, dtype=bool)
        marked[hashes & np.uint64((1 << 20) - 1)] = True
        alike = int(np.unique(hashes, return_counts=True)[1].max(initial=1))
        return cls(hashes, data, starts[order], sizes[order], alike, marked), {terms[k]: i for i, k in enumerate(order)}

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms, and their numbers; every letter is compared."""
        hashes = hash_spans(data, starts, ends)
        maybe = np.flatnonzero(self.marked[hashes & np.uint64((1 << 20) - 1)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        found, numbers = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for step in range(self.alike):
            number = np.minimum(at + step, len(self.hashes) - 1)
            fits = (self.hashes[number] == hashes[maybe]) & (self.sizes[number] == ends[maybe] - starts[maybe]) & (at + step < len(self.hashes))
            word, number = maybe[fits], number[fits]
            if len(word):
                sizes = self.sizes[number]
                begins = np.cumsum(sizes) - sizes
                inner = np.arange(sizes.sum()) - np.repeat(begins, sizes)
                same = _LOWER[data[np.repeat(starts[word], sizes) + inner]] == self.data[np.repeat(self.starts[number], sizes) + inner]
                whole = np.logical_and.reduceat(same, begins)
                found.append(word[whole])
                numbers.append(number[whole])
        return np.concatenate(found), np.concatenate(numbers)


def term_counts(column: pa.Array, vocabulary: Vocabulary, size: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text in all; and row, term and count of all that are in the vocabulary."""
    data, offsets = texts_of(column)
    total, width = np.zeros(len(offsets) - 1, dtype=np.int64), len(vocabulary.hashes)
    keys, times = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for a, b in chunks(offsets, size):
        part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        long = b == a + 1 and len(part) > 2 * size
        held = []
        for x, y in cut_between(part, _WORD, size) if long else [(0, len(part))]:
            starts, stops, counts = word_spans(part[x:y], np.array([0, y - x]) if long else ends, _WORD)
            total[a:b] += counts
            word, term = vocabulary.find(part[x:y], starts, stops)
            key = np.repeat(np.arange(a, b), counts)[word] * width + term
            held.append(np.unique(key, return_counts=True))
        key, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        keys.append(key)
        times.append(np.bincount(where, np.concatenate([n for _, n in held]), minlength=len(key)).astype(np.int64))
    key = np.concatenate(keys)
    return total, key // max(width, 1), key % max(width, 1), np.concatenate(times)


@dataclass
class Node:
    """Coordinates that any of its items has, and the largest value of each; children stand one level below."""

    terms: np.ndarray
    values: np.ndarray
    begin: int
    end: int


class ItemTree:
    """Levels of nodes from single items up to a few; `order` says which item stands where."""

    def __init__(self, vectors: list[dict[int, int]]):
        strongest = [max(v, key=lambda t: (v[t], t), default=-1) for v in vectors]
        self.order = sorted(range(len(vectors)), key=lambda i: (strongest[i], i))
        level = []
        for place, i in enumerate(self.order):
            terms = np.array(sorted(vectors[i]), dtype=np.int64)
            level.append(Node(terms, np.array([vectors[i][int(t)] for t in terms], dtype=np.int64), place, place + 1))
        self.levels = [level]
        while len(level) > ITEMS_A_NODE:
            above = []
            for a in range(0, len(level), ITEMS_A_NODE):
                children = level[a : a + ITEMS_A_NODE]
                terms, at = np.unique(np.concatenate([c.terms for c in children]), return_inverse=True)
                values = np.zeros(len(terms), dtype=np.int64)
                np.maximum.at(values, at, np.concatenate([c.values for c in children]))
                above.append(Node(terms, values, a, a + len(children)))
            self.levels.append(level := above)


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.scores = [np.zeros(0, dtype=np.int64)] * items
        self.ids = [np.zeros(0, dtype=np.int64)] * items
        self.missing = [np.zeros(0, dtype=bool)] * items
        #: Scores under this can't be among them.
        self.least = np.ones(items, dtype=np.int64)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids, missing = (np.concatenate(x) for x in ((self.scores[item], scores), (self.ids[item], ids), (self.missing[item], missing)))
        order = np.lexsort((ids, missing, -scores))[: self.top]
        self.scores[item], self.ids[item], self.missing[item] = scores[order], ids[order], missing[order]
        if len(order) == self.top:
            self.least[item] = scores[order[-1]]


def saturation(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """How much a document of n terms makes of a term that it holds tf times."""
    m = 100 - 25 + (25 * n * documents) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def search(tree: ItemTree, best: Best, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> int:
    """Adds a batch of documents (row, term and value of every coordinate); says how many scores were added up."""
    columns, column = np.unique(terms, return_inverse=True)
    table = np.zeros((len(ids), len(columns)))
    table[rows, column] = values
    strongest = table.argmax(axis=1)
    order = np.argsort(strongest, kind="stable")
    table, ids, missing = table[order], ids[order], missing[order]
    levels = [table]
    for _ in range(2):
        below = levels[-1]
        levels.append(np.maximum.reduceat(below, np.arange(0, len(below), DOCS_A_NODE), axis=0))
    weakest = [best.least]
    for level in tree.levels[1:]:
        weakest.append(np.array([weakest[-1][node.begin : node.end].min() for node in level]))
    added = 0
    stack = [(len(tree.levels) - 1, k, np.arange(len(levels[-1])), 2) for k in range(len(tree.levels[-1]))]
    while stack:
        height, k, nodes, depth = stack.pop()
        while depth > min(height, 2):  # few items need no upper levels of documents
            depth -= 1
            nodes = (nodes[:, None] * DOCS_A_NODE + np.arange(DOCS_A_NODE)).ravel()
            nodes = nodes[nodes < len(levels[depth])]
        node = tree.levels[height][k]
        at = np.searchsorted(columns, node.terms)
        here = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == node.terms)
        at, weights = at[here], node.values[here]
        if not len(at):
            continue
        bound = levels[depth][nodes[:, None], at] @ weights.astype(np.float64)
        nodes = nodes[bound * (1 + SLACK) >= weakest[height][k]]
        if not len(nodes):
            continue
        if height:
            stack += [(height - 1, child, nodes, depth) for child in range(node.begin, node.end)]
            continue
        scores = table[nodes[:, None], at].astype(np.int64) @ weights
        added += len(nodes)
        good = scores >= best.least[k]
        if good.any():
            best.add(k, scores[good], ids[nodes[good]], missing[nodes[good]])
    return added


def _block(docs: DataFrame, ids: list[int | None], texts: list[str], top: int) -> DataFrame | None:
    """item (its number in the block), item_id, doc_id and score of what each task has found."""
    counts = [Counter(words_of(text)) for text in texts]
    names = sorted(set().union(*counts))
    if not names:
        return None
    spark = docs.sparkSession
    vocabulary, number = Vocabulary.of(names)
    shared = spark.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, rows, terms, times = term_counts(batch.column(1), shared.value)
            ends = pa.array(np.searchsorted(rows, np.arange(len(total) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), *lists], names=["doc_id", "n", "terms", "times"])

    held = keep(docs.mapInArrow(read, "doc_id long, n long, terms array<int>, times array<long>"))
    documents, all_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = dict(held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect())
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in frequency.items()}
    vectors = [{number[w]: times * weight[number[w]] for w, times in c.items() if weight.get(number[w])} for c in counts]
    model = spark.sparkContext.broadcast((ItemTree(vectors), ids))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, item_ids = model.value
        best, most = Best(len(tree.order), top), FIRST
        for batch in batches:
            n = batch.column(1).to_numpy()
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy()
            ends = np.append(0, np.cumsum(sizes))
            terms = batch.column(2).flatten().to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(len(n)), sizes)
            values = saturation(batch.column(3).flatten().to_numpy(), n[rows], documents, all_terms)
            a = 0
            while a < len(n):
                b = min(a + most, len(n))
                while b > a + 1 and (b - a) * len(np.unique(terms[ends[a] : ends[b]])) > NUMBERS:
                    b = a + (b - a) // 2
                part = slice(ends[a], ends[b])
                if ends[b] > ends[a]:
                    search(tree, best, rows[part] - a, terms[part], values[part], doc_ids[a:b], missing[a:b])
                a, most = b, BATCH
        for place, item in enumerate(tree.order):
            if k := len(best.scores[place]):
                columns = [pa.array([item] * k, pa.int32()), pa.array([item_ids[item]] * k, pa.int64()), pa.array(best.ids[place], mask=best.missing[place]), pa.array(best.scores[place])]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    return held.mapInArrow(found, "item int, item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = None
    for k in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        part = _block(texts, held["item_id"].to_pylist(), held["text"].to_pylist(), top)
        if part is not None:
            part = part.withColumn("block", F.lit(k))
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], RESULT)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    first = out.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item", spread).orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")
