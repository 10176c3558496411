"""Lloyd's clustering of vectors in whole numbers, with a PCA-rotated filter in front of every distance.

1. Vectors become integers, floor(1024 * x) of each component; those of another length, or with a null, infinite or
   undefined component, are left out.
2. One pass sums moments per task; their principal axes rotate the space.  With each vector its leading coordinates in
   the rotated space and the norm of all the others are stored.
3. Each round is one Arrow map.  For a vector v and a centroid c the distance of the leading coordinates plus the squared
   difference of the residual norms is never more than |v - c|^2.  The centroid with the smallest bound is measured in
   integers first; whoever's bound isn't above that distance survives and is measured in integers, too.  The rotation
   is in floating point and bounds are lowered by more than its error, so it never decides anything.
4. A task sums its members by cluster; the sums of all tasks (clusters x components, whatever the corpus) give the next
   centroids on the driver.  Sums go as halves of 32 bits, so they can't overflow.

Vectors are never shuffled, and a cluster that holds nearly all of them costs no more than any other.

Defined cases
-------------
* Components beyond 2^27 after scaling are taken as 2^27, so that distances fit into 64 bits; inertia beyond 64 bits is
  given as the largest 64-bit number.
* Ties: the smaller cluster number.  Starting vectors with one hash (repeated ids) follow in the order of their
  components.  Equal starting vectors are clusters of their own, of which the first gets all members; empty clusters
  keep their centroid.  Fewer vectors than clusters give fewer clusters.
* Repeated rows count and come out each time.  A null id hashes like an empty one.
* Without vectors the result is empty.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import keep, small_batches

SCALE = 1024
CLUSTERS, ROUNDS, SEED = 8, 10, 3
COMPONENTS = 64
#: Rotated coordinates that are stored.
LEADING = 16
#: Largest component after scaling.
LARGEST = 1 << 27
#: Vectors that are compared at once.
BLOCK = 4096
#: What floating point may be wrong by, as a share of the squared norms.
SLACK = 1e-9

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_numbers(embedding: Column) -> Column:
    """floor(1024 * x) of every component, as integers."""
    bounded = lambda x: F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return F.transform(embedding.cast("array<double>"), lambda x: F.floor(bounded(x)).cast("int"))


def usable(embedding: Column, components: int) -> Column:
    """Whether a vector has so many components, none of them null or not finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(embedding) == components) & ~F.exists(embedding.cast("array<double>"), odd), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return values >> 32, values & 0xFFFFFFFF


@dataclass
class Rotation:
    """Mean and principal axes (columns, the strongest first) of the vectors, and how many coordinates are stored."""

    mean: np.ndarray
    axes: np.ndarray
    leading: int

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norm of the others."""
        turned = (vectors - self.mean) @ self.axes
        return np.ascontiguousarray(turned[:, : self.leading]), np.linalg.norm(turned[:, self.leading :], axis=1)


def principal_axes(vectors: DataFrame, components: int, leading: int) -> Rotation:
    """The rotation, from moments that each task sums (column q)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components + 1))
        for batch in batches:
            x = np.hstack([np.ones((batch.num_rows, 1)), _matrix(batch.column(0), components)])
            total += x.T @ x
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at], pa.float64())], names=["at", "total"])

    sums = vectors.select("q").mapInArrow(moments, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((components + 1) ** 2)
    for row in sums:
        total[row["at"]] = row["total"]
    total = total.reshape(components + 1, components + 1) / max(total[0], 1)
    mean = total[0, 1:]
    _, axes = np.linalg.eigh(total[1:, 1:] - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1]), min(leading, components))


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how many distances were measured."""
    c_lead, c_rest = turn(centroids)
    bound = ((lead[:, None, :] - c_lead) ** 2).sum(axis=2) + (rest[:, None] - c_rest) ** 2
    bound -= SLACK * ((lead**2).sum(axis=1) + rest**2)[:, None] + SLACK * ((c_lead**2).sum(axis=1) + c_rest**2) + SLACK

    def measured(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        apart = q[rows].astype(np.int64) - centroids[numbers]
        return (apart * apart).sum(axis=1)

    rows = np.arange(len(q))
    number = bound.argmin(axis=1)
    best = measured(rows, number)
    first, done = number.copy(), len(q)
    for k in range(len(centroids)):
        left = rows[(bound[:, k] <= best) & (first != k)]
        distance = measured(left, np.full(len(left), k))
        closer = (distance < best[left]) | ((distance == best[left]) & (k < number[left]))
        number[left[closer]], best[left[closer]] = k, distance[closer]
        done += len(left)
    return number, best, done


def _blocks(batches: Iterator[pa.RecordBatch], components: int, leading: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            yield part.column(0), _matrix(part.column(1), components), _matrix(part.column(2), leading), part.column(3).to_numpy()


def _sums(stored: DataFrame, centroids: np.ndarray, turn: Rotation) -> list[list[int]]:
    """For each cluster the exact sums of its members' components, then their number, then their squared distances."""
    clusters, components = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = (np.zeros((clusters, components + 2), dtype=np.int64) for _ in range(2))
        for _, q, lead, rest in _blocks(batches, components, turn.leading):
            number, best, _ = nearest(q, lead, rest, centroids, turn)
            for k in np.unique(number):
                mine = number == k
                for total, half in zip((high, low), _halves(q[mine].astype(np.int64)), strict=True):
                    total[k, :components] += half.sum(axis=0)
                for total, half in zip((high, low), _halves(best[mine]), strict=True):
                    total[k, components + 1] += half.sum()
                low[k, components] += mine.sum()
        at = np.flatnonzero(high.ravel() | low.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(high.ravel()[at]), pa.array(low.ravel()[at])], names=["at", "high", "low"])

    out = [[0] * (components + 2) for _ in range(clusters)]
    for row in stored.mapInArrow(run, "at int, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        k, i = divmod(row["at"], components + 2)
        out[k][i] = (row["high"] << 32) + row["low"]
    return out


def cluster_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    components: int = COMPONENTS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    leading: int = LEADING,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector.

    The starting centroids are the vectors whose `seed:vec_id` has the smallest SHA-256.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    column = F.col(f"`{embedding}`")
    kept = vectors.filter(usable(column, components)).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole_numbers(column).alias("q"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    starts = kept.orderBy(hashed, "q").limit(clusters).collect()
    if not starts:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([row["q"] for row in starts], dtype=np.int64)
    turn = principal_axes(kept, components, leading)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = turn(_matrix(batch.column(1), components).astype(np.float64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rest) + 1) * turn.leading, pa.int32()), pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(rest)], names=["vec_id", "q", "lead", "rest"])

    stored = keep(kept.mapInArrow(store, "vec_id long, q array<int>, lead array<double>, rest double"))
    for _ in range(rounds):
        sums = _sums(stored, centroids, turn)
        moved = np.array([[x // s[components] for x in s[:components]] if s[components] else c.tolist() for s, c in zip(sums, centroids, strict=True)], dtype=np.int64)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    spread = [s[components + 1] for s in _sums(stored, centroids, turn)]
    most = (1 << 63) - 1
    inertia, by_cluster = min(sum(spread), most), np.array([min(x, most) for x in spread], dtype=np.int64)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, q, lead, rest in _blocks(batches, components, turn.leading):
            number, best, _ = nearest(q, lead, rest, centroids, turn)
            columns = [ids, pa.array(number, pa.int32()), pa.array(best), pa.array(by_cluster[number]), pa.array(np.full(len(q), inertia)), pa.array([digests[k] for k in number])]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return stored.mapInArrow(assign, RESULT)
