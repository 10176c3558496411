"""Alignments against the reference sequence: mismatch tags, and lookups by region and group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplan.functions import dna

#: Letters of a piece of a contig; pieces overlap by the longest span of a read that is looked for.
PIECE, OVERLAP = 1 << 16, 1 << 12
#: Windows of so many letters are looked up in pieces of that size.
SMALL = 512
#: Letters of pieces that are handed on at once.
TOGETHER = 1 << 20


def pieces(contigs: DataFrame, size: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """tid, piece, piece_start and letters of contigs (tid, sequence), cut so that no row is long.

    A contig is cut in one go: expressions would look for each piece from the contig's beginning on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                n = (len(text or "") - 1) // size + 1 or 1
                for first in range(0, n, step := max(1, TOGETHER // (size + overlap))):
                    piece = np.arange(first, min(first + step, n), dtype=np.int64)
                    letters = pa.array([None if text is None else text[k * size : (k + 1) * size + overlap] for k in piece.tolist()], pa.string())
                    tids = batch.column(0).take(pa.array(np.full(len(piece), i)))
                    yield pa.RecordBatch.from_arrays([tids, pa.array(piece), pa.array(piece * size), letters], names=["tid", "piece", "piece_start", "letters"])

    return contigs.select("tid", "sequence").mapInArrow(run, f"tid {dict(contigs.dtypes)['tid']}, piece long, piece_start long, letters string")


def with_letters(reads: DataFrame, contigs: DataFrame, first: Column, letters: Column, into: str, size: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """Adds `into`: so many letters of the reference from `first` on (fewer at the end of a contig, null without one).

    Windows of up to `overlap` letters lie in one piece; of longer ones only read_id goes to all pieces that they touch,
    and the letters come back to the read (so read_id must be unique among them).
    """
    rows = reads.withColumns({"_first": first.cast("long"), "_letters": letters.cast("long")})
    cut = pieces(contigs, size, overlap).select("tid", F.col("piece").alias("_piece"), F.col("piece_start").alias("_piece_start"), F.col("letters").alias("_held"))
    # a read is joined with as little of the contig as holds its window
    small = min(SMALL, size, overlap)
    level = F.when(F.col("_letters") > small, 1).otherwise(0)
    fine = pieces(contigs, small, small).select("tid", F.lit(0).alias("_level"), F.col("piece").alias("_piece"), F.col("piece_start").alias("_piece_start"), F.col("letters").alias("_held"))
    both = fine.unionByName(cut.withColumn("_level", F.lit(1)))
    short = rows.filter(F.coalesce(F.col("_letters") <= overlap, F.lit(True))).withColumn("_level", level)
    short = short.withColumn("_piece", F.floor(F.col("_first") / F.when(F.col("_level") == 0, small).otherwise(size))).join(both, ["tid", "_level", "_piece"], "left")
    text = F.substr("_held", (F.col("_first") - F.col("_piece_start") + 1).cast("int"), F.col("_letters").cast("int"))
    short = short.select(*reads.columns, text.alias(into))
    long = rows.filter(F.col("_letters") > overlap)
    touched = F.sequence(F.floor(F.col("_first") / size), F.floor((F.col("_first") + F.col("_letters") - 1) / size))
    parts = long.select("read_id", "tid", "_first", "_letters", F.explode(touched).alias("_piece")).join(cut, ["tid", "_piece"])
    begin = F.greatest(F.col("_first") - F.col("_piece_start"), F.lit(0))
    end = F.least(F.col("_first") + F.col("_letters") - F.col("_piece_start"), F.lit(size))
    part = F.struct("_piece", F.substr("_held", (begin + 1).cast("int"), (end - begin).cast("int")).alias("letters"))
    whole = parts.groupBy("read_id").agg(F.array_join(F.array_sort(F.collect_list(part))["letters"], "").alias(into))
    return short.unionByName(long.join(whole, "read_id", "left").select(*reads.columns, into))


def mismatch_tags(reads: DataFrame, contigs: DataFrame, size: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """read_id, nm and md of aligned reads: edits, and the string of matches, differing letters and deletions.

    A read that spans no more than `overlap` letters of the reference lies in one piece; longer ones are joined with all
    pieces that they touch, whose letters are put together again.  Reads beyond the contigs' ends aren't compared.
    """
    reach = dna.reference_length(F.col("cigar"))
    mapped = reads.filter(dna.lacks(F.col("flag"), dna.UNMAPPED) & (F.col("tid") >= 0)).select("read_id", "tid", "pos", "cigar", "seq", reach.alias("reach"))
    cut = pieces(contigs, size, overlap)
    short = mapped.filter(F.col("reach") <= overlap).withColumn("piece", F.floor(F.col("pos") / size)).join(cut, ["tid", "piece"])
    short = short.select("read_id", "cigar", "seq", F.substr("letters", (F.col("pos") - F.col("piece_start") + 1).cast("int"), F.col("reach")).alias("ref"))
    touched = F.sequence(F.floor(F.col("pos") / size), F.floor((F.col("pos") + F.col("reach") - 1) / size))
    long = mapped.filter(F.col("reach") > overlap).withColumn("piece", F.explode(touched)).join(cut, ["tid", "piece"])
    first = F.greatest(F.col("pos") - F.col("piece_start"), F.lit(0))
    last = F.least(F.col("pos") + F.col("reach") - F.col("piece_start"), F.lit(size))
    part = F.struct("piece", F.substr("letters", (first + 1).cast("int"), (last - first).cast("int")).alias("letters"))
    long = long.groupBy("read_id", "cigar", "seq").agg(F.array_sort(F.collect_list(part)).alias("x"))
    joined = short.unionByName(long.select("read_id", "cigar", "seq", F.array_join("x.letters", "").alias("ref")))
    # letters in step: the read's without insertions, the reference's, and what kind of place it is
    ops = dna.cigar_ops(F.col("cigar"))
    kinds = F.aggregate(ops, F.lit(""), lambda s, x: F.concat(s, F.when(x["op"].isin(*"M=X"), F.repeat(F.lit("M"), x["n"])).when(x["op"] == "D", F.repeat(F.lit("D"), x["n"])).when(x["op"] == "N", F.repeat(F.lit("N"), x["n"])).otherwise("")))
    rows = joined.select("read_id", "cigar", kinds.alias("kinds"), dna.lifted(F.col("cigar"), F.col("seq"), "-").alias("bases"), "ref")
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    steps = F.arrays_zip(letters("kinds").alias("k"), letters("bases").alias("b"), letters("ref").alias("r"))
    start = F.struct(F.lit("").alias("md"), F.lit(0).alias("run"), F.lit(0).alias("bad"), F.lit(False).alias("gap"))

    def step(s, x):  # noqa: ANN001, ANN202
        same = (x["k"] == "M") & (x["b"] == x["r"]) & (x["b"] != "N")
        change = (x["k"] == "M") & ~same
        gone = x["k"] == "D"
        opened = gone & ~s["gap"]
        text = F.when(change, F.concat(s["md"], s["run"].cast("string"), x["r"])).when(opened, F.concat(s["md"], s["run"].cast("string"), F.lit("^"), x["r"])).when(gone, F.concat(s["md"], x["r"])).otherwise(s["md"])
        return F.struct(
            text.alias("md"),
            F.when(same, s["run"] + 1).when(x["k"] == "N", s["run"]).otherwise(0).alias("run"),
            (s["bad"] + F.when(change | gone, 1).otherwise(0)).alias("bad"),
            gone.alias("gap"),
        )

    done = F.aggregate(steps, start, step)
    rows = rows.select("read_id", "cigar", done.alias("d"))
    return rows.select("read_id", (F.col("d.bad") + dna.cigar_length(F.col("cigar"), "I")).alias("nm"), F.concat("d.md", F.col("d.run").cast("string")).alias("md"))


def fetch(reads: DataFrame, tid: int, start: int, end: int) -> DataFrame:
    """Reads over [start, end) of a contig; on Parquet sorted by tid and pos the scan skips what lies outside."""
    return reads.filter((F.col("tid") == tid) & (F.col("pos") < end)).filter(F.col("pos") + dna.reference_length(F.col("cigar")) > start)


def with_sample(reads: DataFrame, groups: DataFrame, column: str = "lib") -> DataFrame:
    """Adds `sample` by the read group; reads of unknown groups are named after it."""
    held = groups.select(F.col("group").alias("_group"), "sample")
    return reads.join(held, F.col(column) == F.col("_group"), "left").withColumn("sample", F.coalesce("sample", F.col(column).cast("string"))).drop("_group")
