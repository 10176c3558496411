"""Writers: lines of SAM, VCF, FASTQ, GFF, BED and PED, and methylation maps in a file tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(*columns: Column | str, sep: str = "\t") -> Column:
    return F.concat_ws(sep, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(".")) for c in columns])


def sam_lines(reads: DataFrame) -> DataFrame:
    """reads as read_sam gives them; tags without a type in `tag_types` are text."""
    kind = (lambda k: F.coalesce(F.element_at("tag_types", k), F.lit("Z"))) if "tag_types" in reads.columns else (lambda _: F.lit("Z"))
    tags = F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda t: F.concat(t["key"], F.lit(":"), kind(t["key"]), F.lit(":"), t["value"]))), "\t")
    line = _text("qname", "flag", "rname", F.col("pos") + 1, "mapq", "cigar", "rnext", F.col("mpos") + 1, "isize", "seq", "qual")
    return reads.select(F.when(tags == "", line).otherwise(F.concat(line, F.lit("\t"), tags)).alias("value"))


def vcf_lines(variants: DataFrame) -> DataFrame:
    """Record lines; a quality below 0 is a dot."""
    qual = F.when(F.col("qual") < 0, ".").otherwise(F.format_string("%.2f", F.col("qual").cast("double")))
    line = _text("chrom", "pos", "id", "ref", "alt", qual, "filter", "info")
    return variants.select(F.when(F.size("samples") > 0, F.concat_ws("\t", line, "format", F.array_join("samples", "\t"))).otherwise(line).alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit("@"), F.col("id"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("quality")).alias("value"))


def gff_lines(rows: DataFrame) -> DataFrame:
    return rows.select(_text("sequence", "source", "feature", "start", "end", "score", "strand", "frame", "attribute").alias("value"))


def bed_lines(rows: DataFrame) -> DataFrame:
    return rows.select(_text("chrom", "start", "end", "name", "score", "strand").alias("value"))


def ped_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", "family", "individual", F.coalesce("father", F.lit("0")), F.coalesce("mother", F.lit("0")), F.col("sex").cast("string"), F.coalesce(F.col("phenotype").cast("string"), F.lit("."))).alias("value"))


def write_map(rows: DataFrame, path: str, strand: str, sep: str = " ") -> None:
    """A map under path/strand/chr=n, positions in order inside each file; ranges keep a chromosome in several tasks."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "chr", "pos").sortWithinPartitions("chr", "pos")
    ordered.select("chr", "pos", "c", "nc", "mc", "ch", "nch", "hmc").write.mode("overwrite").partitionBy("chr").csv(f"{path.rstrip('/')}/{strand}", sep=sep)


def signal_lines(signal: DataFrame) -> DataFrame:
    """position and value, for plots."""
    return signal.select(F.format_string("%.0f %.3f", F.col("plot_pos").cast("double"), F.col("signal").cast("double")).alias("value"))


def vcf_header_lines(header: DataFrame, filters: DataFrame | None = None) -> DataFrame:
    """Header lines of read rows (key and value), with lines of filters (id and description) in front of the column line."""
    columns = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
    named = header.filter("key <> 'samples'").select(F.when(F.col("key") == "fileformat", 0).otherwise(1).alias("part"), F.concat(F.lit("##"), "key", F.lit("="), "value").alias("value"))
    last = header.filter("key = 'samples'").select(F.lit(3).alias("part"), F.when(F.col("value") == "", columns).otherwise(F.concat(F.lit(columns + "\tFORMAT\t"), "value")).alias("value"))
    out = named.unionByName(last)
    if filters is not None:
        out = out.unionByName(filters.select(F.lit(2).alias("part"), F.concat(F.lit("##FILTER=<ID="), "id", F.lit(',Description="'), "description", F.lit('">')).alias("value")))
    return out.orderBy("part", "value").select("value")


def statistics_lines(statistics: DataFrame, sep: str = "\t") -> DataFrame:
    """Run statistics as a line of names and a line for each dataset."""
    names = statistics.columns
    lines = statistics.select(F.lit(1).alias("part"), F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]).alias("value"))
    head = statistics.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(sep.join(names)).alias("value"))
    return head.unionByName(lines).orderBy("part", "value").select("value")


def map_files(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """number (tid + 1) and rows of the file of every contig, also of those that have no site."""
    counts = rows.groupBy(F.col("chr").alias("tid")).agg(F.count(F.lit(1)).alias("rows"))
    return contigs.select("tid").join(counts, "tid", "left").select((F.col("tid") + 1).alias("number"), F.coalesce("rows", F.lit(0)).alias("rows"))
