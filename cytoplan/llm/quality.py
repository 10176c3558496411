"""Quality classifier by nearest-neighbour voting among latent-semantic vectors.

A document's terms are its byte trigrams, folded into 4,096 classes, with logarithmic counts and inverse document
frequencies of the sample, beside five measures of repetition and length.  A truncated singular value decomposition of
the sample gives the latent space.  The labelled vectors of the sample (bounded) are broadcast; every document's vector
is multiplied with all of them, block by block, and the ten nearest vote by a power of their cosine, each class with
the weight that makes the classes equal in the sample.

The whole text of every document is read.  Labels are taken from a bounded sample: at most PER_CLASS documents of each
class (see `labelled_sample`).

Defined cases
-------------
* Null counts as empty.  An empty text has no trigrams and is placed by its measures alone.
* Without positive votes, and without any training label, the score is 0.5; a sample of one class gives that class.
* Very long texts are counted piece by piece; a text is split into words and lines once for the measures.
* Ties between neighbours go to the earlier in the sample.  Rows are independent: repeated rows score alike, and a null
  doc_id counts as "" when rows are held out.  Of several labels of one doc_id the largest counts.
* Empty tables give empty results.  Other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import SAMPLE_BYTES, held_out, labelled_sample
from ._store import small_batches
from ._text import texts_of

#: Labelled documents that are fitted, of each class.
PER_CLASS = 2048
TERMS, DIMENSIONS, NEIGHBOURS, POWER = 4096, 48, 10, 4
#: Weight of the measures beside the (normalised) term vector.
MEASURES = 0.5
#: Documents in a block of products.
BLOCK = 256
THRESHOLD = 0.3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of trigram classes, and measures, of each text."""
    data, offsets = texts_of(texts)
    counts, measures = np.zeros((len(offsets) - 1, TERMS), dtype=np.float32), np.zeros((len(offsets) - 1, 5), dtype=np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for start in range(a, b - 2, 1 << 20):  # a very long text in pieces
            x = data[start : min(b, start + (1 << 20) + 2)].astype(np.uint32)
            h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts[i] += np.bincount((h ^ (h >> np.uint32(12))) % np.uint32(TERMS), minlength=TERMS)
        text = data[a:b].tobytes()
        words, lines = text.split(), [s for s in (line.strip() for line in text.split(b"\n")) if s]
        size = max(1, len(text))
        measures[i] = (
            len(set(words)) / max(1, len(words)),
            len(set(lines)) / max(1, len(lines)),
            min(1, len(words) / 200),
            np.log1p(size) / 12,
            np.log1p(size / max(1, len(lines))) / 10,
        )
    return counts, measures


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    class_weight: np.ndarray

    def latent(self, counts: np.ndarray, measures: np.ndarray) -> np.ndarray:
        terms = _unit(np.log1p(counts) * self.idf)
        return _unit((np.hstack([terms, MEASURES * (measures - 0.5)]) - self.mean) @ self.axes)

    def score(self, counts: np.ndarray, measures: np.ndarray) -> np.ndarray:
        """Share of the votes for label 1."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.latent(counts, measures) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1, None]
        above, level = cosine > least, cosine == least
        level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)  # of equal ones the earlier
        nearest = np.nonzero(above | level)[1].reshape(len(cosine), k)
        votes = np.maximum(np.take_along_axis(cosine, nearest, 1), 0).astype(np.float64) ** POWER * self.class_weight[nearest]
        total = votes.sum(axis=1)
        return np.where(total > 0, (votes * self.labels[nearest]).sum(axis=1) / np.maximum(total, 1e-300), 0.5)


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    counts, measures = features(texts)
    n = len(labels)
    idf = (np.log((n + 1) / ((counts > 0).sum(axis=0) + 1)) + 0.1).astype(np.float32)
    model = Model(idf, np.zeros(TERMS + 5, dtype=np.float32), np.zeros((TERMS + 5, DIMENSIONS), dtype=np.float32), np.zeros((0, DIMENSIONS), dtype=np.float32), labels, np.ones(n))
    if not n:
        return model
    rows = np.hstack([_unit(np.log1p(counts) * idf), MEASURES * (measures - 0.5)]).astype(np.float32)
    model.mean = rows.mean(axis=0)
    rows -= model.mean
    # randomised subspace iteration
    basis = np.random.default_rng(0).standard_normal((rows.shape[1], DIMENSIONS + 16)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    model.axes = np.ascontiguousarray((basis @ turn.T)[:, :DIMENSIONS])
    model.vectors = _unit(rows @ model.axes)
    share = np.bincount(labels, minlength=2)
    model.class_weight = (n / np.maximum(share, 1) / 2)[labels]
    return model


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; the fit takes at most so many labelled documents and bytes
    of their texts of each class."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled_sample(docs, labels, "quality", {0: per_class, 1: per_class}, most_bytes)
    model = fit(sample["text"], sample["label"].to_numpy().astype(np.int64))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                scores = shared.value.score(*features(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.clip(scores, 0, 1), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
