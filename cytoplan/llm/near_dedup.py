"""Near-duplicate detection by weighted min-hashing of TF-IDF shingles.

1. Shingles of five words are counted over all documents: how many documents hold a shingle is counted exactly for
   each of 65,536 classes of shingle hashes, a table whose size never depends on the corpus.  A shingle has the
   frequency of its class: the more a corpus outgrows the classes, the more alike the weights of rare shingles become.
2. A shingle's weight in a document is its count times a smoothed inverse document frequency between 1 and 1.25.
   The floor is on purpose: without it, the more copies a text has, the less its shared shingles would count against
   the few changed ones, and large groups of copies would fall below the threshold.
3. Improved consistent weighted sampling draws 30 samples of each document; ten bands of three samples, and all pairs
   of bands, are bucket keys.  Documents with the same shingles and counts are one candidate ("copies collapse").
4. In each bucket everyone is compared with the most central member only: the one that shares the most buckets with
   others.  So a group of any size gives as many pairs as members.
5. A pair is a link if the weighted Jaccard similarity of all its shingles is 0.8 or more.  Classes are the connected
   components of the links.
6. Buckets that still hold several classes are gone through once more: sorted by their further bands, so that the
   most alike stand together, each member is compared with its next four if they are of other classes.  This only
   joins most of what belongs together before the last step.
7. All members of the buckets that are of several classes even then are joined by an exact prefix filter: texts of
   similarity 0.8 share a shingle among those that make up more than the rarer fifth of either's weight, and neither
   weighs less than 0.8 of the other.  What a text shares with other classes bounds how heavy a partner may be (with
   weights v and w and a common weight c, c / (v + w - c) >= 0.8 asks for w <= 2.25 c - v): first all other classes
   together, then a class of several texts at once, whose members are met only if they all together hold enough of the
   text.  So near copies that have changed too much for their group don't meet each of its members.
   What is crowded (rarer-fifth shingles that CROWD texts or more hold) is told apart by its changes: each of the texts
   is compared with one centre, and two texts of one centre must share a change (a shingle that both have more or less
   often than the centre), unless both are links of the centre.  For with distances D to the centre and weights v, w and
   u (the centre's), a link asks for a distance of (v + w) / 9 at most, and D > (v + u) / 9 for who isn't a link of
   the centre; the common changes then weigh (D1 + D2 - (v + w) / 9) / 2 or more, which is above zero.  So near
   misses with changes of their own don't meet each other; how many others do depends on the centre.  Every pair of different classes that
   passes these bounds is compared, so no pair of a bucket that is similar enough is left out, however large the bucket
   is.

Defined cases
-------------
* Null and empty texts and texts without words are alone in their classes.  Texts of one to four words have one
  shingle, all their words.  Very long texts are hashed in pieces; eight bytes a shingle are held of them.
* Ties between central members go to the smaller hash of doc_id and text, which names a row.  Rows that repeat a doc_id and a text are in one class.
* Rows with a null doc_id take part; their class is the smallest doc_id in it, or null if there is none.
* Empty tables give empty results.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import fresh, keep, small_batches, tidied
from ._text import chunks, mix, shingles, texts_of, word_hashes
from .components import connected_components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
CLASSES = 1 << 16
#: How much more the rarest shingle weighs than the most frequent one.
IDF_RANGE = 0.25
#: The pass before the exact one: members are compared with the next so many, in parts of about so many.
NEIGHBOURS, PART = 4, 64
#: Texts that hold a shingle of the exact pass from which on they are told apart by their changes against a centre.
CROWD = 16
#: Bits of the table that keeps most texts without a bucket out of the shuffle of profiles (8 MB, whatever the corpus).
MARK_BITS = 1 << 26
#: Draws of the sampler are taken from tables of so many entries, one for each sample.
DRAWS = 1 << 14

_KEY = np.uint64((1 << 48) - 1)


def counted_shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of the rows: first row, rows, and each document's different shingles (row, 48-bit hash, count), sorted."""
    data, offsets = texts_of(column)
    for a, b in chunks(offsets):
        part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        hashes, each = shingles(*word_hashes(part, ends), WIDTH)
        keys = np.sort((hashes & _KEY) | (np.repeat(np.arange(b - a, dtype=np.uint64), each) << np.uint64(48)))
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        yield a, b - a, (keys[first] >> np.uint64(48)).astype(np.int64), keys[first] & _KEY, np.diff(np.append(first, len(keys)))


def class_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CLASSES - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents for each class of shingles, and all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(CLASSES, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, _, hashes, _ in counted_shingles(batch.column(0)):
                held += np.bincount(class_of(hashes), minlength=CLASSES)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(held[used], rows), pa.int64())], names=["class", "n"])

    sums = docs.select("text").mapInArrow(tidied(run), "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(CLASSES + 1, dtype=np.int64)
    held[sums["class"].to_numpy()] = sums["n"].to_numpy()  # class -1, all rows, goes last
    return held[:-1], int(held[-1])


def idf_table(held: np.ndarray, rows: int) -> np.ndarray:
    """Weight of a shingle of each class, from 1 to 1 + IDF_RANGE."""
    return 1 + IDF_RANGE * np.log((rows + 1) / (np.minimum(held, rows) + 1)) / np.log(rows + 2)


class Sampler:
    """Improved consistent weighted sampling, for all documents of a chunk at once."""

    def __init__(self, samples: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, (samples, DRAWS)).astype(np.float32)
        self.c = np.log(rng.gamma(2, 1, (samples, DRAWS))).astype(np.float32)
        self.beta = rng.random((samples, DRAWS), dtype=np.float32)
        self.turn = rng.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)

    def draw(self, hashes: np.ndarray, log_weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One 64-bit sample code per document (row) and sample (column); documents start at `first`."""
        out = np.empty((len(first), len(self.r)), dtype=np.uint64)
        logs = log_weights.astype(np.float32)
        shift = np.uint64(64 - (DRAWS - 1).bit_length())
        for k in range(len(self.r)):
            turned = hashes * self.turn[k]
            at = (turned >> shift).astype(np.intp)
            r, beta = self.r[k][at], self.beta[k][at]
            t = np.floor(logs / r + beta)
            a = self.c[k][at] - r * (t - beta) - r
            # the smallest a wins; as an ordered 32-bit integer it stands above what names the shingle and t
            bits = a.view(np.int32)
            order = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)
            name = (turned >> np.uint64(8)) + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)
            code = (order.astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))
            out[:, k] = np.minimum.reduceat(code, first)
        return out


def signatures(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """doc_id, d1 and d2 (a digest of shingles and counts; null without words) and bands of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, weights = Sampler(BANDS * ROWS), np.log(idf.value)
        rows_of = np.uint64(0x9E3779B97F4A7C15) ** np.arange(ROWS, dtype=np.uint64)
        for batch in batches:
            n = batch.num_rows
            digests, bands, words = np.zeros((n, 2), dtype=np.uint64), np.zeros((n, BANDS), dtype=np.uint64), np.zeros(n, dtype=bool)
            for a, _, row, hashes, count in counted_shingles(batch.column(1)):
                if not len(row):
                    continue
                first = np.flatnonzero(np.diff(row, prepend=-1))
                at = a + row[first]
                words[at] = True
                item = mix(hashes + count.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                digests[at, 0] = np.add.reduceat(item, first)
                digests[at, 1] = np.add.reduceat(mix(item ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
                codes = mix(sampler.draw(mix(hashes), weights[class_of(hashes)] + np.log(count), first))
                for i in range(BANDS):
                    bands[at, i] = mix((codes[:, i * ROWS : (i + 1) * ROWS] * rows_of).sum(axis=1, dtype=np.uint64) + np.uint64(i))
            none = pa.array(~words)
            digest = [pa.array(digests[:, i].view(np.int64), mask=~words) for i in range(2)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *digest, lists, none], names=["doc_id", "d1", "d2", "bands", "bare"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, d1 long, d2 long, bands array<long>, bare boolean")


def profiles(docs: DataFrame, marks: Broadcast) -> DataFrame:
    """doc_id and shingles (the 48-bit hashes, repeated as often as they stand there, sorted) of the marked documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy() % MARK_BITS
            batch = batch.filter(pa.array((marks.value[slot >> 3] >> (slot & 7)) & 1 == 1))
            for a, n, row, hashes, count in counted_shingles(batch.column(1)):
                whole = np.repeat(hashes.astype("<u8"), count)
                each = np.bincount(row, weights=count, minlength=n).astype(np.int64)
                cuts = np.concatenate([[0], np.cumsum(each)]) * 8
                lists = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(whole.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), lists.cast(pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, shingles binary")


def weighted_jaccard(one: bytes, two: bytes, idf: np.ndarray) -> float:
    """Similarity of two profiles under the weights of the table."""
    a, m = np.unique(np.frombuffer(one, dtype="<u8"), return_counts=True)
    b, n = np.unique(np.frombuffer(two, dtype="<u8"), return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    wa, wb = idf[class_of(a)] * m, idf[class_of(b)] * n
    both = np.minimum(wa[i], wb[j]).sum()
    whole = wa.sum() + wb.sum() - both
    return float(both / whole) if whole else 0.0


def _bucket_keys(bands: Column) -> Column:
    """Keys of all single bands and of all pairs of bands."""
    singles = [F.struct(F.lit(i).cast("short").alias("f"), bands[i].alias("h")) for i in range(BANDS)]
    pairs = [F.struct(F.lit(BANDS + i * BANDS + j).cast("short").alias("f"), F.xxhash64(bands[i], bands[j]).alias("h")) for i in range(BANDS) for j in range(i)]
    return F.array(*singles, *pairs)


def candidate_pairs(marked: DataFrame) -> DataFrame:
    """one and two: every member of a bucket with the bucket's most central one."""
    spread = F.pmod("h", F.lit(1024)).alias("k")  # a second key, so that Spark deals anew and can split a large bucket
    single = marked.select("node", F.posexplode("bands").alias("f", "h"))
    shared = single.groupBy("f", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = single.select("node", "f", "h", spread).join(shared.select("f", "h", "n", spread), ["f", "h", "k"])
    central = keep(met.groupBy("node").agg(F.sum("n").alias("weight")))
    members = keep(marked.join(central, "node").select("node", "weight", F.explode(_bucket_keys(F.col("bands"))).alias("b")).select("node", "weight", "b.f", "b.h"))
    leaders = members.groupBy("f", "h").agg(F.max(F.struct("weight", F.bitwise_not("node").alias("m"))).alias("top"), F.count(F.lit(1)).alias("n"))
    leaders = leaders.filter("n > 1").select("f", "h", F.bitwise_not(F.col("top.m")).alias("lead"), spread)
    pairs = members.select("node", "f", "h", spread).join(leaders, ["f", "h", "k"]).filter("node <> lead")
    return pairs.select(F.least("node", "lead").alias("one"), F.greatest("node", "lead").alias("two")).groupBy("one", "two").agg(F.lit(1).alias("met")).select("one", "two")


def cross_pairs(marked: DataFrame, classes: DataFrame) -> DataFrame:
    """one and two: neighbours in a bucket that are of different classes."""
    spread = F.pmod("h", F.lit(1024)).alias("k")
    known = marked.join(classes, "node", "left").select("node", "bands", F.coalesce("component", "node").alias("class"))
    single = known.select("node", "class", "bands", F.posexplode("bands").alias("f", "h"))
    mixed = single.groupBy("f", "h").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b")
    met = single.select("*", spread).join(mixed.select("f", "h", "n", spread), ["f", "h", "k"])
    further = F.concat(F.expr("slice(bands, f + 2, size(bands))"), F.expr("slice(bands, 1, f)"))
    # a large bucket in parts: by as many further bands as halve it to PART, and by a hash where all of them agree
    deep = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / PART))).cast("int")
    met = met.select("node", "class", "f", "h", "n", further.alias("order"), F.xxhash64(F.slice(further, 1, F.least(deep, F.lit(BANDS - 1)))).alias("part"))
    salt = F.when(F.col("n") > PART, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (16 * PART)))).otherwise(0)
    near = Window.partitionBy("f", "h", "part", "salt").orderBy("order", "node").rowsBetween(1, NEIGHBOURS)
    met = met.withColumn("salt", salt).select("node", "class", F.collect_list(F.struct("node", "class")).over(near).alias("following"))
    met = met.select("node", F.explode(F.filter("following", lambda x: x["class"] != F.col("class"))["node"]).alias("next"))
    return met.select(F.least("node", "next").alias("one"), F.greatest("node", "next").alias("two")).distinct()


def mixed_members(marked: DataFrame, classes: DataFrame) -> DataFrame:
    """node and class of everyone in a bucket of several classes."""
    spread = F.pmod("h", F.lit(1024)).alias("k")
    known = marked.join(classes, "node", "left").select("node", "bands", F.coalesce("component", "node").alias("class"))
    single = known.select("node", "class", F.posexplode("bands").alias("f", "h"))
    mixed = single.groupBy("f", "h").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b")
    return single.select("*", spread).join(mixed.select("f", "h", spread), ["f", "h", "k"]).select("node", "class").distinct()


def prefix(profile: bytes, idf: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, int]:
    """A text's different shingles and their weights, from the rarest on, and how many of them are its prefix: those
    without which less than `similarity` of its weight is left.

    The order is the same for all texts; how well it follows the frequencies decides on time only, not on the result.
    """
    a, m = np.unique(np.frombuffer(profile, dtype="<u8"), return_counts=True)
    each = idf[class_of(a)]
    order = np.lexsort((a, -each))
    parts = (each * m)[order]
    rest = np.cumsum(parts[::-1])[::-1]
    return a[order], parts, int((rest >= similarity * rest[0] * (1 - 1e-9)).sum()) if len(a) else 0


def token_rows(members: DataFrame, idf: Broadcast, similarity: float) -> DataFrame:
    """node, class, weight, token, part and head: a row for each shingle with its weight, and whether it is of the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                block = batch.slice(start, 256)
                found = [prefix(x, idf.value, similarity) for x in block.column(2).to_pylist()]
                size = [len(t) for t, _, _ in found]
                at = pa.array(np.repeat(np.arange(len(found)), size), pa.int64())
                none = np.zeros(0)
                tokens = np.concatenate([none.astype(np.uint64), *(t for t, _, _ in found)]).astype(np.int64)
                head = np.concatenate([none.astype(bool), *(np.arange(len(t)) < n for t, _, n in found)])
                weights = pa.array([p.sum() for _, p, _ in found], pa.float64())
                columns = [block.column(0).take(at), block.column(1).take(at), weights.take(at), pa.array(tokens), pa.array(np.concatenate([none, *(p for _, p, _ in found)])), pa.array(head)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "class", "weight", "token", "part", "head"])

    return members.select("node", "class", "shingles").mapInArrow(tidied(run), "node long, class long, weight double, token long, part double, head boolean")


def changes(profile: bytes, centre: bytes, idf: np.ndarray, similarity: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray] | None:
    """What a text has to share with others of its centre: its distance less what its own weight allows, the signed
    changes of which one must be the first common one, the weights of all changes from there on, and whether it can be
    the first with a text that isn't a link of the centre.  None far from the centre.
    """
    a, m = np.unique(np.frombuffer(profile, dtype="<u8"), return_counts=True)
    b, n = np.unique(np.frombuffer(centre, dtype="<u8"), return_counts=True)
    own, other = (idf[class_of(a)] * m).sum(), (idf[class_of(b)] * n).sum()
    tokens = np.union1d(a, b)
    more = np.zeros(len(tokens), dtype=np.int64)
    more[np.searchsorted(tokens, a)] += m
    more[np.searchsorted(tokens, b)] -= n
    tokens, more = tokens[more != 0], more[more != 0]
    parts = idf[class_of(tokens)] * np.abs(more)
    apart = parts.sum()
    if 3 * apart > own + other:  # a similarity below a half
        return None
    allowed = (1 - similarity) / (1 + similarity)
    excess, near = apart - allowed * own, allowed * other
    # least common weight with a text that isn't a link of the centre, and with any: two links aren't looked for
    strong = (excess + near) / 2
    least = strong if excess <= near else (excess - near) / (1 + allowed)
    order = np.lexsort((tokens, more < 0))  # gained ones are mostly the rarer ones
    rest = np.cumsum(parts[order][::-1])[::-1]
    first = rest >= least - 1e-9 * own
    signed = (tokens << np.uint64(1) | (more < 0))[order]
    return float(excess), signed[first].astype(np.int64), rest[first], rest[first] >= strong - 1e-9 * own


def crowd_changes(heads: DataFrame, members: DataFrame, idf: Broadcast, similarity: float, crowd: int) -> DataFrame:
    """node, centre, excess, change, rest and strong of all texts near a centre; one row of each text has no change."""
    spread = lambda c: F.pmod(c, F.lit(1024)).alias("k")
    middle = heads.groupBy("token").agg(F.count(F.lit(1)).alias("texts"), F.percentile_approx("weight", 0.5).alias("middle")).filter(F.col("texts") >= crowd).withColumn("k", spread(F.col("token")))
    held = heads.withColumn("k", spread(F.col("token"))).hint("merge").join(middle, ["token", "k"])
    # of those with about the usual weight the one of which others hold the most
    usual = F.col("weight").between(0.9 * F.col("middle"), F.col("middle") / 0.9)
    lead = held.groupBy("token", "k").agg(F.max(F.when(usual, F.struct((F.col("most") / F.col("weight")).alias("share"), "node"))).alias("lead"))
    led = held.select("node", "token", "k").hint("merge").join(lead, ["token", "k"]).groupBy("node").agg(F.max("lead").alias("lead")).select("node", F.col("lead.node").alias("centre"))
    pairs = led.hint("merge").join(members.select("node", "shingles"), "node").withColumn("k", F.pmod("node", F.lit(16)).cast("int"))
    whole = members.select(F.col("node").alias("centre"), F.col("shingles").alias("whole")).hint("merge").join(led.select("centre").distinct(), "centre", "left_semi")
    copies = whole.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))  # a centre can have very many texts
    pairs = pairs.hint("merge").join(copies, ["centre", "k"]).select("node", "centre", "shingles", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, centre, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found := changes(one, two, idf.value, similarity):
                    excess, *lists = found
                    rows.append((node, centre, excess, None, 0.0, False))
                    rows += [(node, centre, excess, *x) for x in zip(*(x.tolist() for x in lists), strict=True)]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["node", "centre", "excess", "change", "rest", "strong"])

    return pairs.mapInArrow(tidied(run), "node long, centre long, excess double, change long, rest double, strong boolean")


def prefix_pairs(rows: DataFrame, similarity: float, members: DataFrame | None = None, idf: Broadcast | None = None, crowd: int = CROWD) -> DataFrame:
    """one and two: pairs of different classes whose weights and common tokens allow the similarity, all that have it among them.

    `rows` are token_rows.  A member's `most` is the weight of the heaviest partner that its tokens in other classes
    allow.  Members of the smaller class of two look for the larger one by token and by a step of the weight.  With
    `members` and their weights, what is crowded is looked for by changes against centres; of two links of a centre only
    the pairs with the centre are then sure to be there.
    """
    loose, times = 1 + 1e-9, (1 + similarity) / similarity
    spread = lambda c: F.pmod(c, F.lit(1024)).alias("k")
    common = rows.groupBy("token").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b").select("token", spread(F.col("token")))
    shared = rows.select("*", spread(F.col("token"))).join(common.hint("merge"), ["token", "k"], "left_semi").drop("k")
    bounds = shared.groupBy("node").agg((times * F.sum("part") * loose - F.max("weight")).alias("most"), F.max("weight").alias("w")).filter(F.col("most") * loose >= similarity * F.col("w")).select("node", "most")
    heads = shared.filter("head").select("node", "class", "weight", "token").hint("merge").join(bounds, "node")
    sizes = rows.groupBy("class").agg(F.count_distinct("node").alias("n"))
    heads = keep(heads.withColumn("k", spread(F.col("class"))).hint("merge").join(sizes.withColumn("k", spread(F.col("class"))), ["class", "k"]).drop("k"))
    changed = None
    if members is not None:
        changed = keep(crowd_changes(heads, members, idf, similarity, crowd))
        centred = changed.filter("change is null").select("node", "centre")
        heads = keep(heads.hint("merge").join(centred, "node", "left"))
    else:
        heads = heads.withColumn("centre", F.lit(None).cast("long"))
    step = lambda w: F.floor(F.log(w) * 50).cast("int")
    whole = heads.select("token", F.col("class").alias("cx"), F.col("n").alias("nx"), F.col("centre").alias("ox"), "weight", "most", step(F.col("weight")).alias("step"))
    whole = whole.groupBy("token", "step", "cx", "nx", "ox").agg(F.min("weight").alias("wx"), F.max("most").alias("mx"))
    low, high = similarity * F.col("weight") / loose, F.least(F.col("weight") / similarity, "most") * loose
    asking = heads.withColumns({"low": low, "high": high}).filter("high >= low")
    asking = asking.select("token", F.col("node").alias("y"), F.col("class").alias("cy"), F.col("n").alias("ny"), F.col("centre").alias("oy"), F.col("weight").alias("wy"), "high", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))).alias("step"))
    smaller = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("cy") < F.col("cx")))
    fitting = smaller & (F.col("wy") <= F.col("mx") * loose) & (F.col("wx") <= F.col("high"))
    other = F.coalesce(F.col("oy") != F.col("ox"), F.lit(True))  # those of one centre are looked for by changes
    met = asking.join(whole.hint("merge"), ["token", "step"]).filter(fitting & other).select("y", "cx", "nx", "wy", "high")
    met = keep(met.groupBy("y", "cx", "nx", "wy").agg(F.max("high").alias("high")))
    # all that a class of several texts holds of a text
    held = rows.groupBy("class", "token").agg(F.max("part").alias("most_part"))
    several = met.filter("nx > 1")
    asked = several.select("y", "cx").withColumn("k", spread(F.col("y"))).hint("merge").join(rows.select(F.col("node").alias("y"), "token", "part", spread(F.col("node"))), ["y", "k"]).drop("k")
    both = asked.withColumn("k", spread(F.col("token"))).hint("merge").join(held.select(F.col("class").alias("cx"), "token", "most_part", spread(F.col("token"))), ["cx", "token", "k"])
    fits = both.groupBy("y", "cx").agg((times * F.sum(F.least("part", "most_part")) * loose).alias("sum"))
    several = several.join(fits.hint("merge"), ["y", "cx"]).select("y", "cx", "wy", F.least("high", F.col("sum") - F.col("wy")).alias("high"))
    left = met.filter("nx = 1").select("y", "cx", "wy", "high").unionByName(several).filter(F.col("high") * loose >= similarity * F.col("wy"))
    inside = heads.groupBy("node", "class", "weight", "most").agg(F.lit(1).alias("one")).select(F.col("node").alias("x"), F.col("class").alias("cx"), F.col("weight").alias("wx"), F.col("most").alias("mx"), spread(F.col("class")))
    allowed = (F.col("wx") <= F.col("high") * loose) & (F.col("wy") <= F.col("mx") * loose) & (F.least("wx", "wy") >= similarity * F.greatest("wx", "wy") / loose)
    pairs = left.withColumn("k", spread(F.col("cx"))).hint("merge").join(inside, ["cx", "k"]).filter(allowed).select("x", "y")
    if changed is not None:
        texts = keep(heads.groupBy("node", "class", "weight", "most").agg(F.lit(1).alias("one")).drop("one"))
        found = keep(changed.filter("change is not null").hint("merge").join(texts, "node").withColumn("k", spread(F.col("change"))))
        named = lambda c: [F.col(old).alias(f"{new}{c}") for old, new in (("node", ""), ("class", "c"), ("weight", "w"), ("most", "m"), ("excess", "e"), ("rest", "r"))]
        both = found.filter("strong").select("centre", "change", "k", *named("x")).hint("merge").join(found.select("centre", "change", "k", *named("y")), ["centre", "change", "k"])
        enough = F.least("rx", "ry") >= (F.col("ex") + F.col("ey")) / 2 - 1e-9 * F.greatest("wx", "wy")
        allowed = (F.col("wx") <= F.col("my") * loose) & (F.col("wy") <= F.col("mx") * loose) & (F.least("wx", "wy") >= similarity * F.greatest("wx", "wy") / loose)
        both = both.filter((F.col("cx") != F.col("cy")) & enough & allowed).select("x", "y")
        own = centred.hint("merge").join(texts.select("node", "class"), "node").withColumn("k", F.pmod("node", F.lit(16)).cast("int"))
        whose = texts.select(F.col("node").alias("centre"), F.col("class").alias("other")).hint("merge").join(centred.select("centre").distinct(), "centre", "left_semi")
        whose = whose.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
        own = own.hint("merge").join(whose, ["centre", "k"]).filter("class <> other").select(F.col("node").alias("x"), F.col("centre").alias("y"))
        pairs = pairs.unionByName(both).unionByName(own)
    return pairs.select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two")).groupBy("one", "two").agg(F.lit(1).alias("met")).select("one", "two")


def marks_of(nodes: DataFrame) -> np.ndarray:
    """A table of MARK_BITS bits with the bits of all nodes set: it says no only for what isn't among them."""
    slot = F.pmod("node", F.lit(MARK_BITS)) + 1  # Spark's bitmaps begin at 1
    held = nodes.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toArrow()
    out = np.zeros(MARK_BITS // 8, dtype=np.uint8)
    for part, bits in zip(held["part"].to_pylist(), held["bits"].to_pylist(), strict=True):
        start = (part - 1) * 4096
        out[start : start + 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, text_key and stays (one of each class) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held, rows = document_frequencies(source)
    idf = spark.sparkContext.broadcast(idf_table(held, rows))
    # nodes: a number of its own for every row's text, as ids can be null or stand twice
    node = F.xxhash64("doc_id", "text")
    keyed = source.select(node.alias("doc_id"), "text")
    signed = keep(signatures(keyed, idf).withColumnRenamed("doc_id", "node"))
    copies = signed.filter("not bare").groupBy("d1", "d2").agg(F.min("node").alias("rep"), F.first("bands").alias("bands"))
    copies = keep(copies)
    marked = copies.select(F.col("rep").alias("node"), "bands")
    pairs = keep(candidate_pairs(marked))
    # whoever shares a bucket stands in a pair
    wanted = keep(pairs.select(F.explode(F.array("one", "two")).alias("node")).distinct())
    marks = spark.sparkContext.broadcast(marks_of(wanted))
    # merge joins: the plan is then the same at every size
    held_profiles = profiles(keyed, marks).withColumnRenamed("doc_id", "node").join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    held_profiles = keep(held_profiles)

    @F.pandas_udf("double")
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([weighted_jaccard(a, b, idf.value) for a, b in zip(one, two, strict=True)], dtype=float)

    spread = lambda c: F.pmod(c, F.lit(1024)).alias("k")
    left = held_profiles.select(F.col("node").alias("one"), F.col("shingles").alias("s1"), spread(F.col("node")))
    right = held_profiles.select(F.col("node").alias("two"), F.col("shingles").alias("s2"), spread(F.col("node")))

    def verified(pairs: DataFrame) -> DataFrame:
        compared = pairs.withColumn("k", spread(F.col("one"))).hint("merge").join(left, ["one", "k"]).drop("k")
        compared = compared.withColumn("k", spread(F.col("two"))).hint("merge").join(right, ["two", "k"])
        return keep(compared.filter(alike("s1", "s2") >= similarity).select("one", "two"))

    marked = keep(marked.join(wanted, "node", "left_semi"))
    links = verified(pairs)
    links = links.union(verified(cross_pairs(marked, connected_components(links, "one", "two"))))
    classes = connected_components(links, "one", "two")
    members = keep(mixed_members(marked, classes).hint("merge").join(held_profiles, "node"))
    more = verified(keep(prefix_pairs(keep(token_rows(members, idf, similarity)), similarity, members, idf)))
    classes = connected_components(links.union(more), "one", "two")
    classes = classes.withColumnRenamed("node", "rep")
    mapped = copies.select("d1", "d2", "rep").join(classes, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("class"))
    # rows of one digest can be very many: dealt by a second key
    second = F.pmod("d1", F.lit(1024))
    found = signed.select("node", "d1", "d2").withColumn("k", second).join(mapped.withColumn("k", second), ["d1", "d2", "k"], "left")
    found = keep(found.select("node", F.coalesce("class", "node").alias("class")).groupBy("node").agg(F.min("class").alias("class")))
    named = keep(source.select("doc_id", node.alias("node")).join(found, "node"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    sizes = named.groupBy("class").agg(best.alias("best"), F.count(F.lit(1)).alias("class_size"))
    # most classes are one row; only the others are joined back, dealt by a second key
    many = sizes.filter("class_size > 1").withColumn("k", spread(F.col("class")))
    out = named.withColumn("k", spread(F.col("class"))).join(many, ["class", "k"], "left")
    alone = F.col("class_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.col("node").alias("text_key"),
        (alone | (F.col("node") == F.col("best.node"))).alias("stays"),
    )


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one of each class, the one with the smallest doc_id; all columns stay as they are."""
    lost, name = fresh("lost"), fresh("key")
    gone = near_duplicates(docs, similarity).filter("not stays").select(F.col("text_key").alias(lost)).distinct()
    known = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return known.join(gone, known[name] == gone[lost], "left_anti").dropDuplicates([name]).drop(name)
