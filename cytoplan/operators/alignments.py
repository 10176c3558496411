"""Filters, statistics, order and duplicates of alignments.

`reads` has read_id, qname, tid, pos, flag, mapq, cigar, seq, qual, isize, nm and lib.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplan.functions import dna

from .ordering import numbered, numbered_by_spans, ranked
from .regions import chunk_counts, contained, overlapping


def _between(column: str, low: int, high: int) -> Column:
    """Bounds of -1 are open."""
    return (F.lit(low == -1) | (F.col(column) >= low)) & (F.lit(high == -1) | (F.col(column) <= high))


def filter_alignments(
    reads: DataFrame,
    *,
    unmapped: bool = False,
    proper_pairs: bool = False,
    unique: bool = False,
    errors: tuple[int, int] = (-1, -1),
    quality: tuple[int, int] = (-1, -1),
    length: tuple[int, int] = (-1, -1),
    regions: DataFrame | None = None,
    purge_mates: bool = True,
) -> DataFrame:
    """The filter chain; with purge_mates the mates of rejected paired reads go too."""
    flag = F.col("flag")
    if unmapped:  # asks nothing else
        return reads.filter(dna.has(flag, dna.UNMAPPED))
    rows = reads.withColumn("_length", F.length("seq"))
    good = _between("nm", *errors) & _between("mapq", *quality) & _between("_length", *length)
    if proper_pairs:
        good &= dna.lacks(flag, dna.PAIRED) | dna.has(flag, dna.PROPER)
    if unique:
        good &= dna.lacks(flag, dna.SECONDARY)
    good = F.coalesce(good, F.lit(False))
    kept, lost = rows.filter(good), rows.filter(~good)
    if regions is not None:
        inside = contained(kept.withColumn("_end", F.col("pos") + F.col("_length")), regions, "tid", "pos", "_end").drop("_end")
        lost = lost.unionByName(kept.join(inside.select("read_id"), "read_id", "left_anti"))
        kept = inside
    if purge_mates:
        kept = kept.join(lost.filter(dna.has(flag, dna.PAIRED)).select("qname").distinct(), "qname", "left_anti")
    return kept.select(*reads.columns)


def view(reads: DataFrame, *, min_mapq: int = 0, need: int = 0, forbid: int = 0, libraries: list[int] | None = None, keep_of_1024: int | None = None) -> DataFrame:
    """Quality, flag and library tests and a reproducible share of the read names."""
    test = (F.col("mapq") >= min_mapq) & dna.has(F.col("flag"), need) & dna.lacks(F.col("flag"), forbid)
    if libraries is not None:
        test &= F.col("lib").isin(*libraries)
    if keep_of_1024 is not None:
        test &= F.pmod(F.crc32(F.col("qname").cast("binary")), F.lit(1024)) < keep_of_1024
    return reads.filter(test)


def view_regions(reads: DataFrame, regions: DataFrame, **tests) -> DataFrame:  # noqa: ANN003
    """Reads of `view` whose aligned stretch meets one of the half-open regions (chrom is the tid)."""
    rows = view(reads, **tests).withColumn("_end", F.col("pos") + dna.reference_length(F.col("cigar")))
    return overlapping(rows, regions, "tid", "pos", "_end").drop("_end")


def mate_statistics(reads: DataFrame) -> DataFrame:
    """mate (1, 2, or 0 for reads that aren't paired), reverse, and mapped, unmapped and unique reads."""
    f = F.col("flag")
    mate = F.when(dna.lacks(f, dna.PAIRED), 0).when(dna.has(f, dna.FIRST), 1).otherwise(2)
    return reads.groupBy(mate.alias("mate"), dna.has(f, dna.REVERSE).alias("reverse")).agg(F.count_if(dna.lacks(f, dna.UNMAPPED)).alias("mapped"), F.count_if(dna.has(f, dna.UNMAPPED)).alias("unmapped"), F.count_if(dna.lacks(f, dna.SECONDARY)).alias("unique_reads"))


def mean_depth(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """tid, letters and depth: letters of mapped reads on each contig, and their mean over its length; tid -1: letters of unmapped reads."""
    mapped = dna.lacks(F.col("flag"), dna.UNMAPPED) & (F.col("tid") >= 0)
    sums = reads.groupBy(F.when(mapped, F.col("tid")).otherwise(-1).alias("tid")).agg(F.sum(F.length("seq")).alias("letters"))
    rows = contigs.select("tid", "length").unionByName(contigs.sparkSession.range(1).select(F.lit(-1).alias("tid"), F.lit(None).cast("long").alias("length"))).join(sums, "tid", "left")
    return rows.select("tid", F.coalesce("letters", F.lit(0)).alias("letters"), F.round(F.coalesce("letters", F.lit(0)) / F.col("length"), 6).alias("depth"))


def running_mean(reads: DataFrame, value: Column, by: str, order: str = "file_ord", last: int = 64) -> DataFrame:
    """by and mean: m = (m + x) / 2 over each group in file order, starting at the first value.

    A value counts half as much as the one behind it, so those more than `last` before the end are below the precision
    of a number; only the others are summed, and a group of fewer rows gives its first value the rest of the weight.
    """
    rows = numbered(reads.select(by, F.col(order), value.cast("double").alias("x")), [by], order, "i")
    sizes = rows.groupBy(by).agg((F.max("i") + 1).alias("n"))
    near = rows.join(sizes, by).filter(F.col("n") - F.col("i") <= last)
    weight = F.pow(F.lit(0.5), F.col("n") - F.col("i")) + F.when(F.col("i") == 0, F.pow(F.lit(0.5), F.col("n"))).otherwise(0)
    return near.groupBy(by).agg(F.sum(F.col("x") * weight).alias("mean"))


def flag_statistics(reads: DataFrame) -> DataFrame:
    """Counters of alignments that passed quality control and that didn't."""
    f = F.col("flag")
    paired = dna.has(f, dna.PAIRED)
    mapped, mate = dna.lacks(f, dna.UNMAPPED), dna.lacks(f, dna.MATE_UNMAPPED)
    tests = {
        "total": F.lit(True),
        "duplicates": dna.has(f, dna.DUPLICATE),
        "mapped": mapped,
        "paired": paired,
        "read1": paired & dna.has(f, dna.FIRST),
        "read2": paired & dna.has(f, dna.SECOND),
        "properly_paired": paired & dna.has(f, dna.PROPER) & mapped,
        "both_mapped": paired & mapped & mate,
        "singletons": paired & mapped & ~mate,
        "mate_elsewhere": paired & mapped & mate & (F.col("mtid") != F.col("tid")),
        "mate_elsewhere_q5": paired & mapped & mate & (F.col("mtid") != F.col("tid")) & (F.col("mapq") >= 5),
    }
    return reads.groupBy(dna.has(f, dna.QC_FAIL).alias("qc_fail")).agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def index_statistics(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Mapped and unmapped reads of every contig; reads without one under tid -1."""
    f = F.col("flag")
    counts = reads.groupBy("tid").agg(F.count_if(dna.lacks(f, dna.UNMAPPED)).alias("mapped"), F.count_if(dna.has(f, dna.UNMAPPED)).alias("unmapped"))
    all_contigs = contigs.select("tid", "length").unionByName(contigs.sparkSession.range(1).select(F.lit(-1).alias("tid"), F.lit(0).cast("long").alias("length")))
    return all_contigs.join(counts, "tid", "left").na.fill(0, ["mapped", "unmapped"])


def summary(reads: DataFrame) -> DataFrame:
    """One row of counts, extremes and means over all alignments."""
    f = F.col("flag")
    n = F.length("seq")
    letters = [F.sum(dna.count_of(F.col("seq"), b)).alias(f"n_{b.lower()}") for b in "ACGTN"]
    return reads.agg(
        F.count(F.lit(1)).alias("reads"),
        F.count_if(dna.lacks(f, dna.UNMAPPED)).alias("mapped"),
        F.count_if(dna.has(f, dna.UNMAPPED)).alias("unmapped"),
        F.count_if(dna.lacks(f, dna.SECONDARY)).alias("unique_reads"),
        F.count_if(dna.has(f, dna.REVERSE)).alias("reverse_reads"),
        F.min("isize").alias("min_isize"),
        F.max("isize").alias("max_isize"),
        F.sum("isize").alias("sum_isize"),
        F.min("mapq").alias("min_mapq"),
        F.max("mapq").alias("max_mapq"),
        F.sum("mapq").alias("sum_mapq"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.sum(F.size(F.filter(dna.cigar_ops(F.col("cigar")), lambda x: x["op"].isin("I", "D")))).alias("indels"),
        F.sum(dna.cigar_length(F.col("cigar"), "ID")).alias("indel_bases"),
        *letters,
        (~F.bool_or(dna.has(f, dna.PAIRED))).alias("single_end"),
    )


def histogram(reads: DataFrame, value: Column, name: str, top: int | None = None) -> DataFrame:
    """How many reads have each value; values from `top` on share one bucket."""
    bucket = value if top is None else F.least(value, F.lit(top))
    return reads.groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("reads"))


def depth(reads: DataFrame, mask: int = dna.UNMAPPED | dna.SECONDARY | dna.QC_FAIL | dna.DUPLICATE, span: int = 4096) -> DataFrame:
    """tid, pos and depth of all positions under aligned bases, deletions and skips aside.

    Starts and ends of aligned blocks are summed by position; running sums start anew in each span of positions, with the
    depth at which the span begins, so that no task holds a chromosome.
    """
    step = lambda s, x: F.struct(
        F.when(x["op"].isin(*"M=X"), F.concat(s["b"], F.array(F.struct(s["r"].alias("s"), (s["r"] + x["n"]).alias("e"))))).otherwise(s["b"]).alias("b"),
        (s["r"] + F.when(x["op"].isin(*"MDN=X"), x["n"]).otherwise(0)).alias("r"),
    )
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    blocks = reads.filter(dna.lacks(F.col("flag"), mask) & (F.col("tid") >= 0)).select("tid", F.explode(F.aggregate(dna.cigar_ops(F.col("cigar")), F.struct(none.alias("b"), F.col("pos").cast("long").alias("r")), step, lambda s: s["b"])).alias("x"))
    # a block is cut at the spans' borders
    parts = blocks.select("tid", "x.s", "x.e", F.explode(F.sequence(F.floor(F.col("x.s") / span), F.floor((F.col("x.e") - 1) / span))).alias("span"))
    parts = parts.select("tid", "span", F.greatest("s", F.col("span") * span).alias("s"), F.least("e", (F.col("span") + 1) * span).alias("e"))
    events = parts.select("tid", "span", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("v"))
    steps = events.groupBy("tid", "span", "v.at").agg(F.sum("v.d").alias("d"))
    w = Window.partitionBy("tid", "span").orderBy("at")
    runs = steps.select("tid", "at", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), F.lead("at").over(w).alias("next"))
    return runs.filter("depth > 0").select("tid", F.explode(F.sequence(F.col("at"), F.col("next") - 1)).alias("pos"), "depth")


def plain_depth(reads: DataFrame, span: int = 4096) -> DataFrame:
    """tid, pos and depth of all positions under reads, each taken as long as its letters, whatever its CIGAR and flags."""
    whole = reads.filter(F.length("seq") > 0).select("tid", "pos", F.lit(0).alias("flag"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"))
    return depth(whole, 0, span)


def coverage_histogram(depths: DataFrame, contigs: DataFrame, top: int = 99) -> DataFrame:
    """Positions of the genome at each depth (to `top`), and the share of the genome at that depth or more."""
    seen = depths.groupBy(F.least("depth", F.lit(top)).alias("depth")).agg(F.count(F.lit(1)).alias("positions"))
    total = contigs.agg(F.sum("length").alias("total"))
    rest = total.join(seen.agg(F.coalesce(F.sum("positions"), F.lit(0)).alias("seen"))).select(F.lit(0).cast("long").alias("depth"), (F.col("total") - F.col("seen")).alias("positions"))
    # at most top + 1 rows from here on
    w = Window.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return seen.select(F.col("depth").cast("long"), "positions").unionByName(rest).crossJoin(F.broadcast(total)).select("depth", "positions", F.round(F.sum("positions").over(w) / F.col("total"), 9).alias("fraction"))


def chunks(reads: DataFrame, size: int = 10_000) -> DataFrame:
    """Reads that touch each chunk of 10,000 positions."""
    rows = reads.filter("tid >= 0").select("tid", (F.col("pos") + 1).alias("s"), (F.col("pos") + F.length("seq") + 1).alias("e"))
    return chunk_counts(rows, "tid", "s", "e", size)


def sort_by_coordinate(reads: DataFrame) -> DataFrame:
    """Contig and position; reads without a contig last."""
    return reads.orderBy(F.when(F.col("tid") < 0, 1).otherwise(0), "tid", "pos", "read_id")


def sort_by_name(reads: DataFrame) -> DataFrame:
    """Natural order of names, numbers by value, then flag bits of first and second."""
    return reads.orderBy(dna.natural_key(F.col("qname")), F.col("flag").bitwiseAND(dna.FIRST | dna.SECOND), "read_id")


def coordinate_ranks(reads: DataFrame) -> DataFrame:
    """Adds `rank`: each read's place in coordinate order, from 0; reads without a contig stand last, by read_id."""
    contig = F.when(F.col("tid") < 0, F.lit((1 << 31) - 1)).otherwise(F.col("tid"))
    return ranked(reads, [contig, F.col("pos"), F.col("read_id")], "rank")


def name_ranks(reads: DataFrame) -> DataFrame:
    """Adds `rank`: each read's place in the natural order of names, then first and second of a pair, then read_id."""
    return ranked(reads, [dna.natural_key(F.col("qname")), F.col("flag").bitwiseAND(dna.FIRST | dna.SECOND), F.col("read_id")], "rank")


def drop_pair_duplicates(reads: DataFrame) -> DataFrame:
    """Of pairs with one library, contig, start and insert size the one with the best base qualities stays, with its mate."""
    f = F.col("flag")
    heads = reads.filter(dna.has(f, dna.PAIRED) & dna.lacks(f, dna.UNMAPPED | dna.MATE_UNMAPPED) & (F.col("mtid") == F.col("tid")) & (F.col("isize") > 0))
    best = heads.groupBy("lib", "tid", "pos", "isize").agg(F.max_by("read_id", F.struct("sumq", (-F.col("read_id")).alias("o"))).alias("best"))
    lost = heads.join(best, ["lib", "tid", "pos", "isize"]).filter("read_id <> best").select("qname").distinct()
    return reads.join(lost, "qname", "left_anti").select(*reads.columns)


def drop_single_duplicates(reads: DataFrame) -> DataFrame:
    """Of reads with one library, strand and start (reverse: end) the one with the best base qualities stays."""
    f = F.col("flag")
    reverse = dna.has(f, dna.REVERSE)
    mapped = dna.lacks(f, dna.UNMAPPED)
    place = F.when(reverse, F.col("pos") + dna.reference_length(F.col("cigar"))).otherwise(F.col("pos"))
    keyed = reads.withColumn("_place", place).withColumn("_reverse", reverse)
    best = keyed.filter(mapped).groupBy("lib", "tid", "_reverse", "_place").agg(F.max_by("read_id", F.struct("sumq", (-F.col("read_id")).alias("o"))).alias("read_id"))
    return reads.filter(~mapped).unionByName(reads.join(best.select("read_id"), "read_id", "left_semi").select(*reads.columns))


def fix_mates(reads: DataFrame) -> DataFrame:
    """Mate contig, mate position and insert size of pairs, from the other read of the same name."""
    f = F.col("flag")
    pick = lambda bit, c: F.max(F.when(dna.has(f, bit), F.col(c)))
    five = F.when(dna.has(f, dna.REVERSE), F.col("pos") + dna.reference_length(F.col("cigar"))).otherwise(F.col("pos"))
    rows = reads.withColumn("_five", five)
    pairs = rows.groupBy("qname").agg(*[pick(bit, c).alias(f"{c}_{i}") for i, bit in ((1, dna.FIRST), (2, dna.SECOND)) for c in ("tid", "pos", "_five")])
    joined = rows.join(pairs, "qname")
    first = dna.has(f, dna.FIRST)
    other = lambda c: F.when(first, F.col(f"{c}_2")).otherwise(F.col(f"{c}_1"))
    size = F.when(F.col("tid") == other("tid"), other("_five") - F.col("_five")).otherwise(0)
    return joined.filter(other("tid").isNotNull()).select("read_id", "qname", other("tid").alias("mate_tid"), other("pos").alias("mate_pos"), size.alias("insert_size"))


def merge_sorted(tables: list[DataFrame], group: str = "rg") -> DataFrame:
    """All tables in coordinate order, each row with its table's number."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn(group, F.lit(i))
        out = t if out is None else out.unionByName(t)
    return sort_by_coordinate(out)


def to_fastq(reads: DataFrame) -> DataFrame:
    """id, sequence and quality as they came from the machine."""
    f = F.col("flag")
    end = F.when(dna.has(f, dna.FIRST), "/1").when(dna.has(f, dna.SECOND), "/2").otherwise("")
    reverse = dna.has(f, dna.REVERSE)
    return reads.select(
        "read_id",
        F.concat("qname", end).alias("id"),
        F.when(reverse, dna.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("sequence"),
        F.when(reverse, F.reverse("qual")).otherwise(F.col("qual")).alias("quality"),
    )
