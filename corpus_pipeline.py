"""A training corpus from raw documents: toxic ones go, copies and near copies go, benchmark passages go, ids stay.

Defined cases
-------------
* A null text counts as empty in every stage; of all null and empty texts one document stays, which is encoded as no ids.
* Rows without a doc_id take part in all stages and lose to any doc_id among copies; of rows that repeat a doc_id and a
  text one stays, rows that share only a doc_id are documents of their own.
* Ties: the largest doc_id of equal texts stays, the smallest of near copies.
* Very long texts are read in pieces by every stage.
* Empty tables (documents, labels or benchmark) give empty results, or stages that drop nothing.
* Columns beside doc_id and text are carried through all stages, whatever their names; the last one replaces text by
  n_tokens and ids (columns of these names are replaced, too).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplan.llm._store import keep, small_batches
from cytoplan.llm.byte_bpe import encode
from cytoplan.llm.decontaminate import decontaminate as drop_contaminated
from cytoplan.llm.exact_dedup import drop_copies
from cytoplan.llm.near_dedup import drop_near_duplicates
from cytoplan.llm.queries import vocabulary
from cytoplan.llm.toxicity import drop_toxic


#: Bytes of an Arrow batch in the pipeline, whose stages share their executors' memory.
BATCH_BYTES = 2 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the classifier learns from the labels."""
    small_batches(spark, BATCH_BYTES)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left with n_tokens and ids (little-endian unsigned 32-bit integers) in place of their texts."""
    ranks, pattern = vocabulary()
    out = encode(docs, ranks, pattern)
    carried = [out[f"`{c}`"] for c in docs.columns if c not in ("text", "n_tokens", "ids")]
    return out.select(*carried, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte-level BPE", tokenize),
]

#: SQL can't express the classifier, the sampling or the merges; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs)
    return docs
