"""Near-duplicates by 64-bit SimHash fingerprints that differ in at most three bits, found by Golay-code fuzzy hashing.

1. A text's fingerprint: each bit is the majority of that bit in the XXH64 hashes of all its shingles of three words.
2. Equal fingerprints are one candidate, so copies of any number cost nothing from here on.
3. A fingerprint is cut into segments of 22, 21 and 21 bits.  Three differing bits leave, whichever way they fall, two
   segments with at most one each, so a pair is found under one of the three pairs of segments.
4. The perfect binary Golay code of 23 bits decodes any segment to the one codeword within three bits.  What a segment
   with one bit changed decodes to is one of at most six codewords, known from the segment's syndrome alone.  Every
   fingerprint is therefore held once for each pair of segments, under the two codewords that its own segments decode
   to, and looked for under all nearby codewords of both, at most 36.  If two fingerprints are within one bit on both
   segments, either finds the other.
5. Both sides are joined on the key of 24 bits and the pair of segments; the join's condition counts the differing
   bits, so nothing but true links leaves it.  No link is left out.  Components are those of the links.

A key that very many fingerprints share is one partition of an equi-join of two shuffles, which Spark splits on both
sides; what a key costs is its lookups times its holders, and a fingerprint is a holder three times in all.

Defined cases
-------------
* Words are runs without white space (space, 0x09-0x0D), A-Z lower-cased.  Texts of one or two words have one shingle,
  the whole sequence; null, empty and blank texts have the fingerprint zero and are linked like any other.
* A bit is set if more than half of the hashes have it; repeated shingles count each time.
* Very long texts are hashed in pieces that share two words.
* Rows with a null doc_id take part; a component is named by the smallest doc_id in it, null if there is none.
* Repeated rows come out each time.  Empty tables give empty results.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import fresh, keep, small_batches
from ._text import _LOWER, _SPACE, CHUNK_BYTES, chunks, cut_between, texts_of, word_spans
from .components import connected_components

WIDTH = 3
SEED = 42
DISTANCE = 3
#: First bit and bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed by the code), and its length.
GENERATOR, LENGTH, CHECK_BITS = 0b110001110101, 23, 11
#: Codewords that a word with one bit changed, or none, can decode to, at most.
NEARBY = 6


def set_bits(hashes: np.ndarray, each: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each row's hashes (`each` says how many a row has)."""
    out = np.zeros((len(each), 64), dtype=np.int64)
    full = np.flatnonzero(each)
    if not len(full):
        return out
    blocks = -(-each[full] // 255)  # eight counters of a byte fit into a word, and none may run over
    first = np.cumsum(blocks) - blocks
    inner = np.arange(blocks.sum()) - np.repeat(first, blocks)
    begins = np.repeat(np.cumsum(each[full]) - each[full], blocks) + 255 * inner
    lanes = np.stack([np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), begins) for k in range(8)])
    counts = lanes.astype("<u8").view(np.uint8).reshape(8, -1, 8).transpose(1, 2, 0).reshape(-1, 64)
    out[full] = np.add.reduceat(counts, first, axis=0, dtype=np.int64)
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every text's shingles, words joined by one space, and how many each text has.

    Without `short`, texts of fewer words than a shingle give none.
    """
    starts, ends, counts = word_spans(data, offsets, ~_SPACE)
    sizes = ends - starts
    places = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int(sizes.sum()) + len(sizes), 32, dtype=np.uint8)
    held = np.flatnonzero(~_SPACE[data])
    joined[held - np.repeat(starts - places, sizes)] = _LOWER[data[held]]
    each = np.maximum(counts - WIDTH + 1, 0)
    if short:
        each[(counts > 0) & (counts < WIDTH)] = 1
    row = np.repeat(np.arange(len(counts)), each)
    first = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + (np.cumsum(counts) - counts)[row]
    last = first + np.minimum(counts, WIDTH)[row] - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(places[first].tolist(), (places[last] + sizes[last]).tolist(), strict=True)
    return np.fromiter((digest(text[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(row)), each


def _pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A long text in pieces that end between words; each begins with the last two words before it."""
    for at, end in cut_between(data, ~_SPACE, size):
        words, begin = 0, at
        while begin and words < WIDTH - 1:  # back over two words
            while begin and _SPACE[data[begin - 1]]:
                begin -= 1
            inside = begin
            while begin and not _SPACE[data[begin - 1]]:
                begin -= 1
            words += inside > begin
        yield data[begin:end]


def fingerprints(column: pa.Array, size: int = CHUNK_BYTES) -> np.ndarray:
    """The fingerprint of every text, as unsigned 64-bit integers."""
    data, offsets = texts_of(column)
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    for a, b in chunks(offsets, size):
        part = data[offsets[a] : offsets[b]]
        if len(part) <= 2 * size:
            hashes, each = shingle_hashes(part, offsets[a : b + 1] - offsets[a])
            counts = set_bits(hashes, each)
        else:  # one long text
            counts, each = np.zeros((1, 64), dtype=np.int64), np.zeros(1, dtype=np.int64)
            for piece in _pieces(part, size):
                hashes, n = shingle_hashes(piece, np.array([0, len(piece)]), short=False)
                counts += set_bits(hashes, n)
                each += n
            if not each[0]:  # one or two very long words
                hashes, each = shingle_hashes(part, np.array([0, len(part)]))
                counts = set_bits(hashes, each)
        out[a:b] = np.packbits(counts * 2 > each[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all words of 12 bits (taken twice for a word of 23), and for each syndrome what to add to a word to
    reach the codewords that it and its neighbours decode to: the own one first, repeated to fill the row."""
    unit = []
    for bit in range(LENGTH):
        rest = 1 << bit
        for at in range(bit, CHECK_BITS - 1, -1):
            if rest >> at & 1:
                rest ^= GENERATOR << (at - CHECK_BITS)
        unit.append(rest)
    of = lambda word: int(np.bitwise_xor.reduce([0, *(unit[i] for i in range(LENGTH) if word >> i & 1)]))
    leader = np.full(1 << CHECK_BITS, -1, dtype=np.int64)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << i for i in bits)
            leader[of(word)] = word
    syndromes = np.array([[of(word) for word in range(1 << 12)], [of(word << 12) if word < 1 << CHECK_BITS else 0 for word in range(1 << 12)]])
    near = np.empty((1 << CHECK_BITS, NEARBY), dtype=np.int64)
    for s in range(1 << CHECK_BITS):
        found = list(dict.fromkeys([int(leader[s]), *(int(leader[s ^ unit[i]]) ^ 1 << i for i in range(LENGTH))]))
        near[s] = found + found[:1] * (NEARBY - len(found))
    return syndromes, near


_SYNDROMES, _NEAR = _golay()


def nearby_codewords(words: np.ndarray) -> np.ndarray:
    """For words of up to 23 bits the numbers (12 bits) of the codewords that they, or words one bit away, decode to; the own one first."""
    syndrome = _SYNDROMES[0][words & 0xFFF] ^ _SYNDROMES[1][words >> 12]
    return (words[:, None] ^ _NEAR[syndrome]) >> CHECK_BITS


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The keys that each fingerprint is held under, one for each pair of segments, and the lists of those it is looked for under."""
    near = [nearby_codewords(((prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)) for first, bits in SEGMENTS]
    own, sought = [], []
    for k, (i, j) in enumerate(PAIRS):
        both = (k << 24) | (near[i][:, :, None] << 12) | near[j][:, None, :]
        both = both.reshape(len(prints), NEARBY * NEARBY)
        own.append(both[:, 0])
        sought.append(both)
    keys = np.sort(np.hstack(sought), axis=1)
    new = np.ones(keys.shape, dtype=bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(new.sum(axis=1))), pa.int32()), pa.array(keys[new], pa.int32()))
    return np.stack(own, axis=1), lists


def links(prints: DataFrame) -> DataFrame:
    """u and v: all pairs of different fingerprints (column fp, each once) that differ in at most three bits; a pair may come more than once."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(a, 4096)
                own, sought = fuzzy_keys(fp.to_numpy(zero_copy_only=False).view(np.uint64))
                held = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel(), pa.int32()), len(PAIRS)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([fp, held, sought], names=["fp", "own", "sought"])

    keys = keep(prints.select("fp").mapInArrow(keyed, "fp long, own array<int>, sought array<int>"))
    holders = keys.select(F.explode("own").alias("key"), F.col("fp").alias("v"))
    lookups = keys.select(F.explode("sought").alias("key"), F.col("fp").alias("u"))
    alike = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
    return lookups.join(holders, (lookups["key"] == holders["key"]) & alike).select("u", "v")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], names=["doc_id", "fp"])

    printed = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long"))
    heads = keep(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = connected_components(links(heads), "u", "v").withColumnRenamed("node", "fp")
    named = heads.join(classes, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # fingerprints of very many documents: a second key lets Spark split them
    second = fresh("k")
    spread = F.pmod(F.col("fp"), F.lit(1024)).alias(second)
    of_print = named.join(smallest, "component").select("fp", "component_id", spread)
    out = printed.select("*", spread).join(of_print, ["fp", second])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
