from __future__ import annotations

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cytoplan.llm import sharding
from cytoplan.llm.sharding import feistel_shards, permuted, walks_needed

from .helpers import ODD, frame


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 97, 1000])
def test_permutation(spark, n):
    walks = walks_needed(spark, n, 5)
    got = [r.y for r in spark.range(n).select(permuted(F.col("id"), n, 5, walks).alias("y")).collect()]
    assert sorted(got) == list(range(n))


def test_shards(spark):
    rows = [*ODD, *((i, f"text {i % 7}") for i in range(100, 400))]
    got = feistel_shards(frame(spark, rows)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(24)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want


def test_same_places_for_other_partitions(spark):
    rows = [(i, f"t{i}") for i in range(200)]
    a, b = ({(r.doc_id, r.shard, r.slot) for r in feistel_shards(frame(spark, rows, n)).collect()} for n in (1, 7))
    assert a == b


def test_more_buckets_change_nothing(spark, monkeypatch):
    """Rows without an id, rows of one id and equal rows among them; a text of 3 MB."""
    rows = [*((None, f"t{i}") for i in range(60)), *((7, f"s{i}") for i in range(60)), *[(8, "same")] * 20, (9, "x" * 3_000_000)]
    whole = sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in feistel_shards(frame(spark, rows, 4)).collect())
    monkeypatch.setattr(sharding, "BUCKET_DIGITS", 1)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 1)
    other = sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in feistel_shards(frame(spark, rows, 2)).collect())
    assert whole == other and len({(s, t) for _, _, s, t in whole}) == len(rows)


def test_empty(spark):
    assert feistel_shards(frame(spark, [])).collect() == []
