"""Bounded samples of labelled documents, from which the classifiers are fitted."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) is divisible by this are held out.
FOLDS = 5
#: Bytes of text in a sample at most, for each class, if a caller doesn't say otherwise.
SAMPLE_BYTES = 24 << 20


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], most_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """text and label of at most so many training documents of each class, in the order of a hash of doc_id.

    Of each class never more than the stated rows, and of these, one after another, all that fit into what is left of
    `most_bytes`; a text that doesn't fit is passed over and costs the others nothing.  Sizes are compared first, then
    only the texts that were chosen are fetched.  Null labels, and those that aren't asked for, are left out; of several
    labels of one document the largest counts; of several texts of one doc_id the smallest.
    """
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = None
    for value, rows in sorted(most.items()):
        part = known.filter(F.col("label") == value).orderBy(order, "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)

    def of(wanted: DataFrame) -> DataFrame:
        # the documents of at most so many ids
        found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
        return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    left, kept = {value: most_bytes for value in most}, []
    for row in of(chosen).select("doc_id", "label", F.octet_length("text").alias("size")).orderBy(order, "doc_id").collect():
        if row["size"] <= left[row["label"]]:
            left[row["label"]] -= row["size"]
            kept.append((row["doc_id"], row["label"]))
    wanted = docs.sparkSession.createDataFrame(kept, chosen.schema)
    return of(wanted).orderBy(order, "doc_id").select("doc_id", "label", "text").toArrow()
