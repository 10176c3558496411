from __future__ import annotations

import hashlib
import math

import numpy as np

from cytoplan.llm.centroids import cluster_vectors, nearest, principal_axes

SCHEMA = "vec_id long, embedding array<float>, cluster string, q int"


def vectors(spark, rows, partitions=3):
    """rows of (vec_id, embedding); with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(partitions)


def by_hand(rows, n, clusters=8, rounds=10):
    """Every distance, in Python's own integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    centroids = [q for _, q in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda q: min((apart(q, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[q for _, q in kept if place(q)[1] == k] for k in range(len(centroids))]
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    placed = [(i, *place(q)) for i, q in kept]
    within = [sum(d for _, d, k in placed if k == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, k, d, within[k], sum(within), sha[k]) for i, d, k in placed], key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_against_every_distance(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(5, 64))
    rows = [(i, (middles[i % 5] * 0.3 + rng.normal(size=64) * 0.2).tolist()) for i in range(300)]
    assert got(cluster_vectors(vectors(spark, rows))) == by_hand(rows, 64)


def test_odd_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(40)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 2.0, 3.0]), (104, [float("nan"), 0.0, 0.0, 0.0]), (105, [0.0, float("-inf"), 0.0, 0.0]), (106, [0.0] * 5)]
    rows += [(None, [0.5, 0.5, 0.5, 0.5]), (7, [0.25, -0.25, 0.0, 0.0])] + [(200 + i, [0.1, 0.1, 0.1, 0.1]) for i in range(60)] + rows[:3]
    assert got(cluster_vectors(vectors(spark, rows), components=4, leading=2)) == by_hand(rows, 4)


def test_equal_starts_leave_empty_clusters(spark):
    rows = [(i, [1.0, 2.0]) for i in range(9)] + [(9, [-5.0, 0.0])]
    assert got(cluster_vectors(vectors(spark, rows), components=2)) == by_hand(rows, 2)


def test_few_none_and_huge(spark):
    few = [(1, [0.5, 0.25]), (2, [3.0, 1.0])]
    assert got(cluster_vectors(vectors(spark, few), components=2)) == by_hand(few, 2)
    assert got(cluster_vectors(vectors(spark, []), components=2)) == []
    assert got(cluster_vectors(vectors(spark, [(1, None)]), components=2)) == []
    huge = cluster_vectors(vectors(spark, [(1, [1e30, -1e30]), (2, [1.0, 1.0])]), components=2, clusters=1).collect()
    assert len(huge) == 2 and all(r.distance > 0 for r in huge)


def test_filter_never_drops_the_nearest(spark):
    rng = np.random.default_rng(3)
    q = (rng.normal(size=(500, 16)) * [2000, 1000, 500, *[30] * 13]).astype(np.int32)
    turn = principal_axes(vectors(spark, []).sparkSession.createDataFrame([(x.tolist(),) for x in q], "q array<int>"), 16, 3)
    centroids = np.vstack([q[:20], q[:2]]).astype(np.int64)
    number, best, measured = nearest(q, *turn(q), centroids, turn)
    apart = ((q[:, None, :].astype(np.int64) - centroids) ** 2).sum(axis=2)
    assert (number == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
    assert measured < apart.size / 2  # it does filter
