"""Exact de-duplication by a tree-merge of sorted digest runs.

Every document becomes a digest entry.  Entries are dealt over `runs` runs row by row, so a group of copies of any size
is spread evenly.  In each round `fan_in` neighbouring runs (two binomial rounds at once, for four) meet, range by range
of the digest: Spark sorts what arrives and a sort-based aggregate merges it, keeping for each digest one verified
identifier and the count.  After the last round one run is left, which holds the winners.  Winners then go back only to
the first runs, never to single documents of a group at once.

Defined cases
-------------
* Texts are equal if identical after lower-casing A-Z only.  The smallest identifier in the order of the tree stays;
  that order is descending doc_id, so the row with the largest doc_id stays (null is the smallest of all).
* A null text counts as empty; empty texts equal each other.  Very long texts are hashed where they stand; only their
  digests travel.
* Every row counts and comes out once, also rows that repeat a doc_id, a text or both.  A row is kept if its doc_id is
  that of the row that stays; `drop_copies` leaves one row of these.
* An empty table gives an empty result.  Other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import fresh, keep, parts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest is verified by the text's length and a second, independent hash.
KEY = ["digest", "n_bytes", "check"]


def digest_entries(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text), n_bytes and check of every row."""
    norm = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", norm.alias("norm")).select(
        "doc_id",
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
    )


def _merge(entries: DataFrame) -> DataFrame:
    """One multiway merge: runs that share a number meet in each range of the digest."""
    spark = entries.sparkSession
    return (
        entries.withColumn("part", F.substring("digest", 1, 2))
        .repartition(parts(spark), "run", "part")
        .groupBy("run", "part", *KEY)
        # the struct keeps Spark on a sort-based aggregate: sorted runs, merged
        .agg(F.max(F.struct("best.doc_id", "best.n_bytes")).alias("best"), F.sum("n").alias("n"))
        .drop("part")
    )


def exact_dedup(docs: DataFrame, runs: int = 256, fan_in: int = 4) -> DataFrame:
    """doc_id, keep_id (the document that stays), group_size, kept and text_sha256 of every document."""
    # written once, so that a row's run is the same for all readers
    entries = keep(digest_entries(docs).withColumn("run", F.pmod(F.monotonically_increasing_id(), F.lit(runs)).cast("int")))
    first = _merge(entries.withColumn("best", F.struct("doc_id", "n_bytes")).withColumn("n", F.lit(1).cast("long")))
    first = keep(first)
    level, left = first, runs
    while left > 1:
        left = -(-left // fan_in)
        level = _merge(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")))
    winners = level.filter("n > 1").select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    # what each first run has to know: at most one row for a digest and run
    known = first.select("run", *KEY).join(winners, KEY)
    found = entries.join(known, ["run", *KEY], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, **options: int) -> DataFrame:
    """The documents with one row for each text, the one with the largest doc_id; all columns stay as they are.

    Rows that repeat the doc_id and the text of the row that stays are dropped too (any one of them stays).
    """
    mark = lambda sha: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), sha)
    lost, name = fresh("lost"), fresh("name")
    gone = exact_dedup(docs, **options).filter("not kept").select(mark(F.col("text_sha256")).alias(lost))
    sha = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER).cast("binary"), 256)
    known = docs.withColumn(name, mark(sha))
    return known.join(gone, known[name] == gone[lost], "left_anti").dropDuplicates([name]).drop(name)
