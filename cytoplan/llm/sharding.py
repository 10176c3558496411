"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get dense global numbers in the order of a digest of doc_id, size and crc32: rows are dealt over buckets by its
first digits (so many that a bucket holds about BUCKET_ROWS), the buckets' counts give each its first number, and a row
number inside the bucket gives the rest, so no task sees more than a bucket.  How many buckets there are changes no
number.  A balanced Feistel network on a grid of ceil(sqrt(n)) x ceil(n / ceil(sqrt(n))) cells permutes the numbers; a
number that leaves the range walks on until it is back.  Shard and slot follow from the permuted number by division, so
they can be computed for any row number without reading other rows.

Law: `rows`; the counts of two shards differ by one at most.  Equal texts are rows like all others and may come into
different shards.

Defined cases
-------------
* A null text has no bytes: size 8, crc32 of no bytes (0).  A null doc_id counts as "" in the digest; rows without or
  with the same doc_id are spread over the buckets by size and crc32.
* Rows that are equal in doc_id, size and crc32 stand side by side and may swap their places, which nothing tells apart.
* Very long texts are only measured, where they stand.
* Empty tables give empty results.  Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import keep

PRIME = 2147483647
ROUNDS = 6
#: Hexadecimal digits of a bucket at least, and about how many rows one should hold.
BUCKET_DIGITS, BUCKET_ROWS = 3, 1 << 16


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three multipliers or offsets below PRIME for each round, by a Lehmer generator started at the seed."""
    x, keys = seed % (PRIME - 1) + 1, []
    for _ in range(ROUNDS):
        k = []
        for _ in range(3):
            x = x * 48271 % PRIME
            k.append(x)
        keys.append(tuple(k))
    return keys


def grid(n: int) -> tuple[int, int]:
    """Rows and columns of the smallest nearly square grid with n cells or more."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def permuted(x: Column, n: int, seed: int, walks: int) -> Column:
    """The permuted number of x in [0, n), walking at most `walks` times."""
    a, b = grid(n)
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("pqr", t, strict=True)], F.lit(i).alias("i")) for i, t in enumerate(round_keys(seed))])
    steps = F.flatten(F.array_repeat(keys, walks))

    def step(s: Column, k: Column) -> Column:
        done = s["done"] | (s["begun"] & (k["i"] == 0) & (s["l"] * b + s["r"] < n))
        even = k["i"] % 2 == 0
        t = (F.when(even, s["r"]).otherwise(s["l"]) + k["p"]) % PRIME
        t = (t * k["q"] + k["r"]) % PRIME
        t = (t * t + k["p"]) % PRIME
        return F.struct(
            F.when(~done & even, (s["l"] + t) % a).otherwise(s["l"]).alias("l"),
            F.when(~done & ~even, (s["r"] + t) % b).otherwise(s["r"]).alias("r"),
            done.alias("done"),
            F.lit(True).alias("begun"),
        )

    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"), F.lit(False).alias("done"), F.lit(False).alias("begun"))
    return F.aggregate(steps, start, step, lambda s: s["l"] * b + s["r"])


def walks_needed(spark: SparkSession, n: int, seed: int) -> int:
    """How often a number must be permuted until all are inside: found on the few cells outside of [0, n)."""
    a, b = grid(n)
    walks = 4
    while n and a * b > n:
        outside = spark.range(n, a * b).select(permuted(F.col("id"), n, seed, walks).alias("y"))
        if not outside.filter(F.col("y") >= n).limit(1).count():
            break
        walks *= 2
    return walks + 1


def feistel_shards(docs: DataFrame, shards: int = 24, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    rows = keep(rows.withColumn("digest", F.md5(name.cast("binary"))))
    n = rows.count()
    digits = BUCKET_DIGITS
    while n >> (4 * digits) > BUCKET_ROWS:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("digest", 1, digits))
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    firsts = buckets.select("bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("first"))
    order = Window.partitionBy("bucket").orderBy("digest", "doc_id", "size", "text_crc32")
    numbered = rows.withColumn("rank", F.row_number().over(order)).join(firsts, "bucket")
    x = F.col("first") + F.col("rank") - 1
    y = permuted(x, n, seed, walks_needed(spark, n, seed))
    return numbered.select("doc_id", "size", "text_crc32", y.alias("y")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("y") % shards).cast("int").alias("shard"),
        F.floor(F.col("y") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
