"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded labelled sample.  The ordinary one is trained on windows of ordinary
texts.  The toxic one is trained on the stretches of toxic texts that set them apart: substrings of words, six bytes or
more, that are significantly more common in toxic than in ordinary documents (an exact binomial test with Bonferroni's
correction over all that are counted); each toxic document's stretches are one training sample.  The toxic compressor
has the ordinary dictionary's content behind it, so that ordinary language compresses alike with both.  (With toxic
texts trained whole, their ordinary words fill the dictionary and the two hardly differ; the README has figures.)

Every window of a document is compressed with both.  How much shorter the toxic dictionary makes a window is compared
with thresholds of 1 to 7 bytes; how many windows pass each, the largest gains and the mean give the score by a logistic
regression.  It is calibrated on every third document of the sample, which trained neither dictionary; toxic documents
weigh twice, as they are few.

The whole text of every document is read.  Labels are taken from a bounded sample: at most TOXIC_DOCS toxic and
ORDINARY_DOCS ordinary documents within SAMPLE_BYTES each (see `labelled_sample`).

Defined cases
-------------
* Null counts as empty; an empty text is one empty window.  Without toxic or without ordinary documents to train and
  to calibrate with nothing can be told apart: all scores are 0.
* Very long texts are scored a block of windows at a time.
* Rows are independent: repeated rows score alike, and a null doc_id counts as "" when rows are held out.  Of several
  labels of one doc_id the largest counts.  Empty tables give empty results.
* `classify_toxicity` reads doc_id and text only; `drop_toxic` keeps all columns as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import SAMPLE_BYTES, held_out, labelled_sample
from ._store import fresh, parts, plain, small_batches, tidied, trim

#: Labelled documents that are fitted.
TOXIC_DOCS, ORDINARY_DOCS = 1024, 4096
WINDOW, STEP = 48, 32
#: Content that is taken of each trained dictionary.
ORDINARY_BYTES, TOXIC_BYTES = 32768, 2048
#: Windows of ordinary text that the trainer is given at most: evenly spread ones, if the sample has more.
TRAINED_WINDOWS = 20000
#: Every so manieth document of the sample calibrates.
CALIBRATED = 3
SHORTEST, LONGEST = 6, 12
GAINS = (1, 2, 3, 4, 5, 6, 7)
#: Weight of a toxic document in the calibration.
TOXIC_WEIGHT = 2
THRESHOLD = 0.5
#: Words that are remembered with their stretches.
REMEMBERED = 1 << 16
#: Windows that are compressed at once.
BLOCK = 1 << 14

# letters and digits stay, A-Z lower-cased, all else is a space
_FOLD = bytes((c + 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").encode().translate(_FOLD).split()) + b" "


def windows(text: bytes) -> Iterator[bytes]:
    """Windows of WINDOW bytes every STEP bytes; the last one ends with the text."""
    last = max(0, len(text) - WINDOW)
    for i in range(0, last + 1, STEP):
        yield text[i : i + WINDOW]
    if last % STEP:
        yield text[last:]


def _stretches(word: bytes, common: set[bytes]) -> set[bytes]:
    """Parts of the word, of which every SHORTEST bytes are common."""
    x = b" " + word + b" "
    out, reach = set(), 0
    for k in range(len(x) - SHORTEST, -1, -1):
        reach = reach + 1 if x[k : k + SHORTEST] in common else 0
        out.update(x[k : k + n] for n in range(SHORTEST, min(LONGEST, SHORTEST + reach - 1) + 1))
    return out


def telling_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Parts of words that mark toxic texts, by how often they stand there, rarest first."""
    n, m = len(toxic), len(ordinary)
    share, fewest = n / (n + m), max(4, n // 200)
    short: Counter[bytes] = Counter()
    for text in toxic:
        short.update({x[k : k + SHORTEST] for w in set(text.split()) for x in (b" " + w + b" ",) for k in range(len(x) - SHORTEST + 1)})
    # a longer stretch can't be commoner than its parts
    common = {g for g, c in short.items() if c >= fewest}
    tests = len(short)
    del short

    def held_by(texts: list[bytes]) -> Counter[bytes]:
        out: Counter[bytes] = Counter()
        known: dict[bytes, frozenset[bytes]] = {}
        none: frozenset[bytes] = frozenset()
        for text in texts:
            found: set[bytes] = set()
            for word in set(text.split()):
                if word not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = frozenset(_stretches(word, common)) or none
                found |= known[word]
            out.update(found)
        return out

    held, other = held_by(toxic), held_by(ordinary)
    often = {g for g, c in held.items() if c >= fewest}
    tests += len(held)

    def chance(k: int, total: int) -> float:
        """Probability of k or more of `total` in toxic texts if the stretch didn't matter."""
        return sum(exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * log(share) + (total - i) * log(1 - share)) for i in range(k, total + 1))

    marks = set()
    for g in often:
        if (held[g] / n) >= 8 * (other[g] + 0.5) / m and chance(held[g], held[g] + other[g]) * tests < 0.05:
            marks.add(g)
    least = {g for g in marks if not any(g[a:b] in marks for a in range(len(g)) for b in range(a + SHORTEST, len(g) + 1) if b - a < len(g))}
    spans: Counter[bytes] = Counter()
    for text in toxic:
        for word in text.split():
            x = b" " + word + b" "
            covered = bytearray(len(x))
            for length in range(SHORTEST, LONGEST + 1):
                for k in range(len(x) - length + 1):
                    if x[k : k + length] in least:
                        covered[k : k + length] = b"\1" * length
            k = 0
            while k < len(x):
                e = k
                while e < len(x) and covered[e]:
                    e += 1
                if e > k:
                    spans[x[k:e]] += 1
                k = max(e, k + 1)
    return sorted(spans, key=lambda s: (spans[s], s))


def trained(samples: list[bytes], size: int, **options: int) -> bytes:
    """Content of a dictionary that zstandard trains on the samples; of very little text, the text itself."""
    try:
        return zstandard.train_dictionary(2 * size, samples, **options).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def toxic_samples(toxic: list[bytes], marks: list[bytes]) -> list[bytes]:
    """Of each toxic document the telling stretches as they stand in it."""
    if not marks:
        return []
    # the same space can end one word and begin the next
    some = re.compile(b"|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)))
    return [s for t in toxic if (s := b" ".join(some.findall(t.replace(b" ", b"  "))))]


class Distance:
    """Compressors with both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        settings = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=6, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False
        )
        self.compressors = []
        for content in (ordinary, toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress)

    def features(self, text: bytes) -> list[float]:
        one, two = self.compressors
        counts = np.zeros(2 * WINDOW, dtype=np.int64)  # windows by gain
        block: list[bytes] = []
        for w in windows(text):
            block.append(w)
            if len(block) == BLOCK:
                counts += np.bincount([len(one(x)) - len(two(x)) + WINDOW for x in block], minlength=2 * WINDOW)
                block = []
        if block:
            counts += np.bincount([len(one(x)) - len(two(x)) + WINDOW for x in block], minlength=2 * WINDOW)
        n = counts.sum()
        gains = np.arange(2 * WINDOW) - WINDOW
        held = np.flatnonzero(counts)[::-1]
        top = np.repeat(gains[held], np.minimum(counts[held], 3))[:3]
        passed = np.array([counts[WINDOW + g :].sum() for g in GAINS])
        return [top[0], top.mean(), (gains * counts).sum() / n, np.log(n), *np.log1p(passed), *passed[1:5] / n]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((rows - self.centre) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def dictionaries(toxic_texts: list[str], ordinary_texts: list[str], trained_windows: int = TRAINED_WINDOWS) -> Model:
    """Both dictionaries, and no weights yet; the ordinary one is trained on so many windows at most."""
    toxic, plain = [normalised(t) for t in toxic_texts], [normalised(t) for t in ordinary_texts]
    samples = [t[i : i + 256] for t in plain for i in range(0, max(1, len(t) - 255), 256)]
    ordinary = trained(samples[:: -(-len(samples) // trained_windows)], ORDINARY_BYTES)
    marks = trained(toxic_samples(toxic, telling_stretches(toxic, plain)), TOXIC_BYTES, k=16, d=6)
    return Model(ordinary, marks + b"\n" + ordinary, np.zeros(0), np.ones(0), np.zeros(0))


def calibrate(model: Model, rows: np.ndarray, labels: np.ndarray) -> Model:
    """The model with weights from features of documents that it wasn't trained on."""
    y = labels.astype(float)
    model.centre, model.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    z = np.hstack([np.ones((len(rows), 1)), (rows - model.centre) / model.scale])
    w, times = np.zeros(z.shape[1]), np.where(y > 0, TOXIC_WEIGHT, 1)
    for _ in range(50):  # Newton's method, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        w += np.linalg.solve((z * (times * p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (times * (y - p)) - w)
    model.weights = w
    return model


def split(sample: pa.Table) -> tuple[list[str], list[str], pa.Table]:
    """Toxic and ordinary texts that train, and the rows that calibrate: every CALIBRATED-th of each class."""
    marks = sample["label"].to_numpy().astype(np.int64)
    rank = np.zeros(len(marks), dtype=np.int64)
    for k in (0, 1):
        rank[marks == k] = np.arange((marks == k).sum())
    later = rank % CALIBRATED == CALIBRATED - 1
    train = [sample["text"].filter(pa.array(~later & (marks == k))).to_pylist() for k in (1, 0)]
    return train[0], train[1], sample.filter(pa.array(later))


def fit_on(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS, most_bytes: int = SAMPLE_BYTES, trained_windows: int = TRAINED_WINDOWS) -> Model | None:
    """The model of a bounded sample: documents and bytes of each class, and windows that the ordinary dictionary is trained on."""
    toxic, plain, rest = split(labelled_sample(docs, labels, "toxic", {0: ordinary_docs, 1: toxic_docs}, most_bytes))
    if not toxic or not plain or len(set(rest["label"].to_pylist())) < 2:
        return None
    spark = docs.sparkSession
    small_batches(spark)
    model = dictionaries(toxic, plain, trained_windows)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(shared.value.ordinary, shared.value.toxic)
        for batch in batches:
            found = [distance.features(normalised(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["at", "label", "x"])

    held = pa.table({"at": pa.array(range(len(rest)), pa.int64()), "label": rest["label"].cast(pa.int32()), "text": rest["text"]})
    held = spark.createDataFrame(held).repartition(parts(spark), "at").mapInArrow(tidied(run), "at long, label int, x array<double>").toArrow().sort_by("at")
    return calibrate(model, np.array(held["x"].to_pylist(), dtype=float), held["label"].to_numpy())


def with_score(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """The documents with their score in a column of that name."""
    trim()  # the sample that the model was fitted on is gone, but not from the driver's memory
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows, at = plain(docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Model | None = shared.value
        distance = Distance(held.ordinary, held.toxic) if held else None
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if distance and batch.num_rows:
                scores = held.scores(np.array([distance.features(normalised(t.as_py())) for t in batch.column(at)], dtype=float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(tidied(run), T.StructType([*rows.schema, T.StructField("score", T.DoubleType())])).toDF(*docs.columns, name)


def classify_toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; `bounds` are those of `fit_on`."""
    model = fit_on(docs, labels, **bounds)
    scored = with_score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, "score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns as they were; `bounds` are those of `fit_on`."""
    name = fresh("score")
    scored = with_score(docs, fit_on(docs, labels, **bounds), name)
    return scored.filter(F.col(name) < THRESHOLD).drop(name)
