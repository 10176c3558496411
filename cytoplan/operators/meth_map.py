"""Methylation and hydroxymethylation maps of aligned bisulfite reads.

`reads` has ds (mc or hmc), tid, pos, flag, mapq, cigar, seq, xm (the call string, null if absent) and n_tags.  One
shuffle makes all maps: every read is lifted to the reference inside its row, positions that no counter can use are
dropped there, and one aggregation counts by chromosome, strand and position.  A position is a site if any read calls it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplan.functions import dna

from .ordering import numbered

# Letters of methylated calls, and the output columns.
METHYLATED = ("Z", "X", "H", "M", "U")
COUNTERS = ("c", "nc", "mc", "ch", "nch", "hmc")


@dataclass(frozen=True)
class Settings:
    """Defaults of the command line."""

    quality: int = 20
    coverage: int = 15
    tags: int = 7
    include_last_base: bool = False
    pad_short_reads: bool = True


def acceptable(settings: Settings = Settings()) -> Column:
    """A read that can be counted."""
    good = (F.col("tid") >= 0) & (F.col("pos") >= 0) & F.col("seq").rlike("^[ACGTN]{2}") & (F.col("n_tags") == settings.tags)
    return F.coalesce(good & F.col("xm").isNotNull() & (F.col("mapq") >= settings.quality), F.lit(False))


def filter_reads(reads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return reads.filter(acceptable(settings))


def classify_reads(reads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds `status`: unmapped, malformed or valid."""
    return reads.withColumn("status", F.when(F.col("tid") == -1, "unmapped").when(acceptable(settings), "valid").otherwise("malformed"))


def first_reads(reads: DataFrame, caps: DataFrame, order: str = "file_ord") -> DataFrame:
    """The first max_reads + 1 reads of each dataset and chromosome, in file order (the counter is tested before it grows).

    No task sorts a whole chromosome (see `ordering`).
    """
    ranked = numbered(reads, ["ds", "tid"], order, "_number").join(caps, ["ds", "tid"], "left")
    return ranked.filter(F.col("max_reads").isNull() | (F.col("_number") <= F.col("max_reads"))).select(*reads.columns)


def lifted_bases(reads: DataFrame, settings: Settings = Settings(), wanted: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """ds, chr, strand, pos, off, length, base and xm of every reference position under a read.

    `wanted` (of a letter's base and xm, and its offset) keeps the others from becoming rows.
    """
    n = F.length("seq")
    base, call = dna.lifted(F.col("cigar"), F.col("seq"), "D"), dna.lifted(F.col("cigar"), F.col("xm"), ".")
    rows = reads.select(
        "ds",
        F.col("tid").alias("chr"),
        F.when(dna.has(F.col("flag"), dna.REVERSE), 1).otherwise(0).alias("strand"),
        F.col("pos").alias("start"),
        n.alias("length"),
        base.alias("bases"),
        call.alias("calls"),
    )
    if settings.pad_short_reads:
        whole = F.greatest(F.length("bases"), F.col("length"))
        rows = rows.withColumn("calls", F.rpad("calls", whole, F.lit("."))).withColumn("bases", F.rpad("bases", whole, F.lit("R")))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    steps = F.transform(F.arrays_zip(letters("bases").alias("base"), letters("calls").alias("xm")), lambda b, i: F.struct(b["base"].alias("base"), b["xm"].alias("xm"), i.alias("off")))
    if wanted is not None:
        steps = F.filter(steps, lambda b: wanted(b, b["off"]))
    rows = rows.select("ds", "chr", "strand", "start", "length", F.explode(steps).alias("b"))
    return rows.select("ds", "chr", "strand", (F.col("start") + F.col("b.off")).cast("long").alias("pos"), "b.off", "length", "b.base", "b.xm")


def site_counts(reads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """chr, strand, pos and the six counters of every site."""
    own = F.when(F.col("strand") == 0, "C").otherwise("G")
    bases = lifted_bases(reads, settings, lambda b, off: (off < F.col("length")) & ((b["xm"] != ".") | (b["base"] != own)))
    counted = F.lit(True) if settings.include_last_base else F.col("off") <= F.col("length") - 2
    kinds = (("c", (F.col("xm") != ".") & ~F.col("xm").isin(*METHYLATED)), ("nc", F.col("xm") == "."), ("mc", F.col("xm").isin(*METHYLATED)))
    sums = []
    for ds, names in (("mc", ("c", "nc", "mc")), ("hmc", ("ch", "nch", "hmc"))):
        for name, (_, kind) in zip(names, kinds, strict=True):
            sums.append(F.count_if((F.col("ds") == ds) & counted & kind).alias(name))
    grouped = bases.groupBy("chr", "strand", "pos").agg(*sums, F.bool_or(F.col("xm") != ".").alias("_site"))
    return grouped.filter("_site").select("chr", "strand", "pos", *COUNTERS)


def candidate_sites(reads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """chr, strand and pos of every called position."""
    return lifted_bases(reads, settings, lambda b, off: (off < F.col("length")) & (b["xm"] != ".")).select("chr", "strand", "pos").distinct()


def strand_map(sites: DataFrame, strand: int, coverage: int = 15) -> DataFrame:
    """Sites of a strand with more than `coverage` calls in either dataset."""
    return sites.filter((F.col("strand") == strand) & ((F.col("c") + F.col("mc") > coverage) | (F.col("ch") + F.col("hmc") > coverage))).drop("strand")


def mixed_map(sites: DataFrame, coverage: int = 15) -> DataFrame:
    """Both strands summed; `coverage` calls or more in either dataset."""
    both = sites.groupBy("chr", "pos").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return both.filter((F.col("c") + F.col("mc") >= coverage) | (F.col("ch") + F.col("hmc") >= coverage))


def run_statistics(reads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Reads of each dataset, by status, with their share in percent."""
    marked = classify_reads(reads, settings).groupBy("ds").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("valid", "unmapped", "malformed")])
    return marked.withColumn("skipped_pct", F.round((F.col("unmapped") + F.col("malformed")) * 100 / F.col("total"), 6))


def snake_schedule(loads: DataFrame, workers: int, load: str = "length") -> DataFrame:
    """tid and worker: chromosomes by falling load, dealt to and fro over the workers (one row for each chromosome)."""
    rank = F.row_number().over(Window.orderBy(F.desc(load), "tid")) - 1
    turn = F.pmod(rank, F.lit(2 * workers))
    return loads.select("tid", load, F.when(turn < workers, turn).otherwise(2 * workers - 1 - turn).alias("worker"))


def read_loads(reads: DataFrame) -> DataFrame:
    """tid and load: the letters of all reads of each chromosome."""
    return reads.filter("tid >= 0").groupBy("tid").agg(F.sum(F.length("seq")).alias("load"))
