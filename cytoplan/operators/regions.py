"""Region sets: parsing, containment and overlap joins, set operations.

Interval joins are equi-joins on chromosome and bin.  Regions are dealt to the bins that they touch; a long one is found
by any point or interval through the bin of its start, so the probing side is never multiplied by more than its own bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_POSITION = 4294967295


def parse_regions(texts: DataFrame, column: str = "text", exact: bool = False) -> DataFrame:
    """chrom, start, end of lists like `1:100-200,2:300,X`; start defaults to 1, end to the largest position or, exact, the start."""
    one = texts.select(F.explode(F.filter(F.split(F.col(column), ","), lambda x: x != "")).alias("r"))
    start = F.regexp_extract("r", r"^[^:]+:(\d+)", 1)
    end = F.regexp_extract("r", r"^[^:]+:\d+-(\d+)", 1)
    first = F.when(start != "", start.cast("long")).otherwise(F.lit(1))
    return one.select(
        F.regexp_extract("r", r"^([^:]+)", 1).alias("chrom"),
        first.alias("start"),
        F.when(end != "", end.cast("long")).otherwise(first if exact else F.lit(MAX_POSITION)).alias("end"),
    )


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def contained(rows: DataFrame, regions: DataFrame, chrom: str, start: str, end: str, width: int = 10_000) -> DataFrame:
    """Rows whose closed interval lies in one region (closed, too)."""
    held = regions.select(F.col("chrom").alias("_r_chrom"), F.col("start").alias("_r_start"), F.col("end").alias("_r_end"), F.explode(_bins(F.col("start"), F.col("end"), width)).alias("_bin"))
    on = (F.col(chrom) == F.col("_r_chrom")) & (F.floor(F.col(start) / width) == F.col("_bin")) & (F.col("_r_start") <= F.col(start)) & (F.col("_r_end") >= F.col(end))
    return rows.join(held, on, "left_semi")


def overlapping(rows: DataFrame, beds: DataFrame, chrom: str, start: str, end: str, width: int = 8192) -> DataFrame:
    """Rows whose half-open interval meets a half-open one of `beds` (chrom, start, end); each row once, equal rows each."""
    held = beds.filter("end > start").select(F.col("chrom").alias("_r_chrom"), F.col("start").alias("_r_start"), F.col("end").alias("_r_end"), F.explode(_bins(F.col("start"), F.col("end") - 1, width)).alias("_hbin"))
    meets = (F.col(chrom) == F.col("_r_chrom")) & (F.col("_r_end") > F.col(start)) & (F.col("_r_start") < F.col(end))
    first, last = F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end) - 1) / width)
    near = rows.join(held, meets & (first == F.col("_hbin")), "left_semi")
    # only rows that reach further bins and met nothing in their first one ask there; equal ones ask as one
    rest = rows.filter(last > first).join(held, meets & (first == F.col("_hbin")), "left_anti")
    rest = rest.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_times")).withColumn("_key", F.struct(*rows.columns))
    probe = rest.withColumn("_bin", F.explode(F.sequence(first + 1, last)))
    found = probe.join(held, meets & (F.col("_bin") == F.col("_hbin")), "left_semi").select("_key", "_times").distinct()
    return near.unionByName(found.select("_key", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))).select("_key.*"))


def chunk_counts(rows: DataFrame, chrom: str, start: str, end: str, size: int) -> DataFrame:
    """Features that touch each chunk of a chromosome."""
    touched = rows.select(F.col(chrom).alias("chromosome"), F.explode(_bins(F.col(start), F.col(end), size)).alias("chunk_id"))
    return touched.groupBy("chromosome", "chunk_id").agg(F.count(F.lit(1)).alias("features_count"))


def unique_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same keys the first one, by `order`."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_row"))
    return best.select("_row.*")


def intersect_keep(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left table, repeats too, that the right one has."""
    return left.join(right.select(*keys), keys, "left_semi")


def intersect_smaller(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the table with fewer rows (of the first, if both have as many) that the other one has."""
    small, large = (one, two) if one.count() <= two.count() else (two, one)
    return intersect_keep(small, large, keys)


def complement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left table that the right one hasn't."""
    return left.join(right.select(*keys), keys, "left_anti")


def insert_regions(regions: DataFrame, more: DataFrame, contigs: DataFrame) -> DataFrame:
    """Both tables' regions; those on unknown chromosomes (not in contigs, column chrom) aren't taken, equal ones once."""
    columns = ["chrom", "start", "end"]
    return regions.select(*columns).unionByName(more.join(contigs.select("chrom"), "chrom", "left_semi").select(*columns)).distinct()


def remove_regions(regions: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the regions that are given exactly."""
    return regions.join(gone.select("chrom", "start", "end"), ["chrom", "start", "end"], "left_anti")


def count_regions(regions: DataFrame) -> DataFrame:
    """Regions of each chromosome."""
    return regions.groupBy("chrom").agg(F.count(F.lit(1)).alias("regions"))


def same_place(one: str, two: str, soft: bool = False) -> Column:
    """Whether two mapped regions (structs of chrom, start, end and strand) are one: on one strand the same start and end,
    on different strands start and end crossed.  With `soft` one border is enough: the start, or either of the crossed ones.
    """
    a, b = F.col(one), F.col(two)
    crossed = [a["start"] == b["end"], b["start"] == a["end"]]
    along = (a["start"] == b["start"]) if soft else (a["start"] == b["start"]) & (a["end"] == b["end"])
    return (a["chrom"] == b["chrom"]) & F.when(a["strand"] != b["strand"], crossed[0] | crossed[1] if soft else crossed[0] & crossed[1]).otherwise(along)


def from_gff(gff: DataFrame) -> DataFrame:
    """Regions of GFF rows, with coordinates as they are written."""
    return gff.select(F.col("sequence").alias("chrom"), "start", "end")


def from_bed(bed: DataFrame) -> DataFrame:
    """Regions of BED rows, with coordinates as they are written."""
    return bed.select("chrom", "start", "end")


def ordered_regions(regions: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Regions in the order of a list of chromosomes (chrom, ordinal), then start and end; others last, by name."""
    known = regions.join(chromosomes.select("chrom", "ordinal"), "chrom", "left")
    return known.orderBy(F.col("ordinal").asc_nulls_last(), "chrom", "start", "end").select(*regions.columns)


def merge_close(rows: DataFrame, by: list[str], start: str, end: str, gap: int, width: int = 1 << 20) -> DataFrame:
    """Intervals of a group joined where at most `gap` lies between them (gaps and islands).

    Islands are built inside spans of start positions; a span knows the largest end before it from a row for each span,
    and islands that go on over a border are joined by their numbers, so no task sorts a whole group.
    """
    span = F.floor(F.col(start) / width).alias("_span")
    rows = rows.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), span)
    ends = rows.groupBy(*by, "_span").agg(F.max("_e").alias("_far"))
    ahead = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_span", F.max("_far").over(ahead).alias("_far"))
    w = Window.partitionBy(*by, "_span").orderBy("_s", "_e")
    seen = F.greatest(F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_far")  # nulls are passed over
    rows = rows.join(ends, [*by, "_span"]).withColumn("_new", F.when(seen.isNull() | (F.col("_s") - seen > gap), 1).otherwise(0))
    rows = rows.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*by, "_span", "_k").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.count(F.lit(1)).alias("members"))
    # islands are numbered through: those that begin in spans before, and those of the span; what begins a span without
    # being new has the number of the last island before it
    begun = parts.groupBy(*by, "_span").agg(F.max("_k").alias("_n"))
    begun = begun.select(*by, "_span", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    parts = parts.join(begun, [*by, "_span"]).withColumn("_island", F.col("_before") + F.col("_k"))
    return parts.groupBy(*by, "_island").agg(F.min("_s").alias(start), F.max("_e").alias(end), F.sum("members").alias("members")).drop("_island")
