"""Readers of line-based formats as DataFrames: SAM, VCF, GFF, BED, PED, FASTA and maps.

Each reader takes a path that Spark can read (gzip by its ending) and parses with column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytoplan.functions import dna
from cytoplan.functions.text import last_entries


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).withColumn("value", F.regexp_replace("value", r"\r$", ""))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignments of SAM lines: eleven columns, `tags` (name to value), n_tags and `tag_types`; header lines are left out.

    Of tags that repeat the last one counts, but n_tags counts all.
    """
    rows = lines.filter("value <> '' AND NOT value LIKE '@%'").select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 11)
    tags = F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(0)))
    named = lambda value: last_entries(F.transform(tags, lambda t: F.struct(F.substring(t, 1, 2).alias("k"), value(t).alias("v"))))
    c = F.col("c")
    return rows.select(
        c[0].alias("qname"),
        c[1].cast("int").alias("flag"),
        c[2].alias("rname"),
        (c[3].cast("int") - 1).alias("pos"),
        c[4].cast("int").alias("mapq"),
        c[5].alias("cigar"),
        c[6].alias("rnext"),
        (c[7].cast("int") - 1).alias("mpos"),
        c[8].cast("int").alias("isize"),
        c[9].alias("seq"),
        c[10].alias("qual"),
        named(lambda t: F.substr(t, F.lit(6))).alias("tags"),
        F.size(tags).alias("n_tags"),
        named(lambda t: F.substring(t, 4, 1)).alias("tag_types"),
    )


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_sam(_lines(spark, path))


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """name, length and tid of the header's contigs, in the order of the header's lines (of repeated names the first)."""
    at = _lines(spark, path).filter("value LIKE '@SQ%'").withColumn("_line", F.monotonically_increasing_id())
    rows = at.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"), "_line")
    first = rows.groupBy("name").agg(F.min_by("length", "_line").alias("length"), F.min("_line").alias("_line"))
    return first.select("name", "length", (F.row_number().over(Window.orderBy("_line")) - 1).alias("tid"))  # a row for each contig


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """line, kind (HD, SQ, RG, PG, CO) and fields (name to value; a comment under CO) of the header's lines."""
    rows = _lines(spark, path).filter("value RLIKE '^@[A-Z][A-Z]'").withColumn("line", F.monotonically_increasing_id())
    kind = F.substring("value", 2, 2)
    parts = F.filter(F.slice(F.split("value", "\t"), 2, 1_000_000), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:"))
    fields = last_entries(F.transform(parts, lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substr(x, F.lit(4)).alias("v"))))
    return rows.select("line", kind.alias("kind"), F.when(kind == "CO", F.create_map(F.lit("CO"), F.substr("value", F.lit(5)))).otherwise(fields).alias("fields"), "value")


def read_groups(header: DataFrame) -> DataFrame:
    """group, sample and library of the header's read groups."""
    f = lambda k: F.element_at("fields", k)
    return header.filter("kind = 'RG'").select(f("ID").alias("group"), f("SM").alias("sample"), f("LB").alias("library"))


def merge_headers(headers: list[DataFrame]) -> DataFrame:
    """The lines of several headers, the first file's first; of contigs, groups and programs with one name the first stays."""
    every = None
    for i, h in enumerate(headers):
        h = h.withColumn("file", F.lit(i))
        every = h if every is None else every.unionByName(h)
    name = F.when(F.col("kind") == "SQ", F.element_at("fields", "SN")).when(F.col("kind").isin("RG", "PG"), F.element_at("fields", "ID")).when(F.col("kind") == "HD", "").otherwise(F.col("value"))
    place = F.struct("file", "line")
    first = every.withColumn("_name", name).groupBy("kind", "_name").agg(F.min_by(F.struct("file", "line", "value"), place).alias("x"))
    rank = F.when(F.col("kind") == "HD", 0).when(F.col("kind") == "SQ", 1).when(F.col("kind") == "RG", 2).when(F.col("kind") == "PG", 3).otherwise(4)
    return first.select(rank.alias("rank"), "kind", "x.file", "x.line", "x.value").orderBy("rank", "file", "line")


def reheadered(header: DataFrame, names: DataFrame) -> DataFrame:
    """The header's lines with contigs renamed by a table of name and new_name."""
    contig = F.when(F.col("kind") == "SQ", F.element_at("fields", "SN"))
    rows = header.join(names.select(F.col("name").alias("_name"), "new_name"), contig == F.col("_name"), "left")
    value = F.when(F.col("new_name").isNotNull(), F.regexp_replace("value", F.lit(r"\tSN:[^\t]*"), F.concat(F.lit("\tSN:"), "new_name"))).otherwise(F.col("value"))
    return rows.select("line", "kind", "fields", value.alias("value"))


def without_groups(header: DataFrame, groups: list[str]) -> DataFrame:
    """The header without these read groups."""
    return header.filter(~((F.col("kind") == "RG") & F.coalesce(F.element_at("fields", "ID").isin(*groups), F.lit(False))))


def _good_record(c: Column) -> Column:
    return F.coalesce((F.size(c) >= 8) & c[0].rlike("^[A-Za-z0-9_.,]+$") & c[1].rlike("^[0-9]+$") & c[3].rlike("^[ACGTNacgtn.]+$"), F.lit(False))


def malformed_vcf(lines: DataFrame) -> DataFrame:
    """value of the record lines that parse_vcf leaves out."""
    return lines.filter("value <> '' AND NOT value LIKE '#%'").filter(~_good_record(F.split("value", "\t")))


def read_vcf_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of several files side by side: chrom, pos, ref, alt and `files`, the samples of each file that has the site."""
    every = None
    for i, path in enumerate(paths):
        rows = read_vcf(spark, path).select("chrom", "pos", "ref", "alt", F.struct(F.lit(i).alias("file"), "id", "qual", "format", "samples").alias("x"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("chrom", "pos", "ref", "alt").agg(F.array_sort(F.collect_list("x")).alias("files"))


def parse_vcf(lines: DataFrame) -> DataFrame:
    """Records of VCF lines; a QUAL of `.` is -1, an ALT that begins with 0 is `.`; malformed lines are left out."""
    rows = lines.filter("value <> '' AND NOT value LIKE '#%'").select(F.split("value", "\t").alias("c"))
    c = F.col("c")
    return rows.filter(_good_record(c)).select(
        c[0].alias("chrom"),
        c[1].cast("long").alias("pos"),
        c[2].alias("id"),
        c[3].alias("ref"),
        F.when(c[4].startswith("0"), ".").otherwise(c[4]).alias("alt"),
        F.when(c[5] == ".", -1.0).otherwise(c[5].try_cast("double")).alias("qual"),
        c[6].alias("filter"),
        c[7].alias("info"),
        F.coalesce(F.get("c", F.lit(8)), F.lit("")).alias("format"),
        F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(0))).alias("samples"),
    )


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_vcf(_lines(spark, path))


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """key and value of the header lines; the column line's sample names under the key `samples`."""
    rows = _lines(spark, path).filter("value LIKE '#%'")
    return rows.select(
        F.when(F.col("value").startswith("##"), F.regexp_extract("value", "^##([^=]+)=", 1)).otherwise("samples").alias("key"),
        F.when(F.col("value").startswith("##"), F.regexp_extract("value", "^##[^=]+=(.*)$", 1)).otherwise(F.array_join(F.slice(F.split("value", "\t"), 10, 1_000_000), "\t")).alias("value"),
    )


def parse_gff(lines: DataFrame) -> DataFrame:
    rows = lines.filter("value <> '' AND NOT value LIKE '#%'").select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 8)
    c = F.col("c")
    score = F.when(c[5] == ".", None).otherwise(c[5].try_cast("double"))
    return rows.select(c[0].alias("sequence"), c[1].alias("source"), c[2].alias("feature"), c[3].cast("long").alias("start"), c[4].cast("long").alias("end"), score.alias("score"), c[6].alias("strand"), c[7].alias("frame"), F.get("c", F.lit(8)).alias("attribute"))


def read_gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_gff(_lines(spark, path))


def parse_bed(lines: DataFrame) -> DataFrame:
    """chrom, start, end and the optional columns; one-column lines aside, a line with two columns is a position from 1."""
    rows = lines.filter("value <> '' AND NOT value RLIKE '^(#|track|browser)'").select(F.split("value", r"[ \t]+").alias("c")).filter(F.size("c") >= 2)
    c = F.col("c")
    point = F.size("c") == 2
    return rows.select(
        c[0].alias("chrom"),
        F.when(point, c[1].cast("long") - 1).otherwise(c[1].cast("long")).alias("start"),
        F.when(point, c[1].cast("long")).otherwise(F.get("c", F.lit(2)).cast("long")).alias("end"),
        F.get("c", F.lit(3)).alias("name"),
        F.get("c", F.lit(4)).try_cast("double").alias("score"),
        F.get("c", F.lit(5)).alias("strand"),
        F.slice("c", 7, F.greatest(F.size("c") - 6, F.lit(0))).alias("more"),
    )


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_bed(_lines(spark, path))


def parse_ped(lines: DataFrame) -> DataFrame:
    """family, individual, father, mother (0: null), sex and phenotype (`.`: null)."""
    rows = lines.filter("value <> '' AND NOT value LIKE '#%'").select(F.split(F.trim("value"), r"[ \t]+").alias("c")).filter(F.size("c") >= 6)
    c = F.col("c")
    parent = lambda x: F.when(x != "0", x)
    return rows.select(c[0].alias("family"), c[1].alias("individual"), parent(c[2]).alias("father"), parent(c[3]).alias("mother"), c[4].try_cast("int").alias("sex"), F.when(c[5] != ".", c[5].try_cast("double")).alias("phenotype"))


def read_ped(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_ped(_lines(spark, path))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name and sequence of each record."""
    rows = spark.read.option("lineSep", ">").text(path).filter("value <> ''")
    return rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("name"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")).alias("sequence"))


def fasta_slice(fasta: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """Letters start to end (from 1, closed), cut to the sequence."""
    first = F.greatest(F.lit(start), F.lit(1))
    return fasta.filter(F.col("name") == name).select("name", F.substr("sequence", first, F.greatest(F.least(F.lit(end), F.length("sequence")) - first + 1, F.lit(0))).alias("sequence"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """name and length from lines `>name start finish`."""
    rows = _lines(spark, path).select(*[F.regexp_extract("value", r"^>(\S+) (\d+) (\d+)", i).alias(n) for i, n in ((1, "name"), (2, "a"), (3, "b"))]).filter("name <> ''")
    return rows.select("name", (F.col("b").cast("long") - F.col("a").cast("long") + 1).alias("length"))


def read_map(spark: SparkSession, path: str | list[str], legacy: bool = False) -> DataFrame:
    """A methylation map's rows; legacy takes the fifth column for hmc, as older plots did."""
    rows = spark.read.csv(path, sep=" ", schema="pos long, c long, nc long, mc long, ch long, nch long, hmc long")
    return rows.withColumn("hmc", F.col("ch")) if legacy else rows


def reads_for_maps(sam: DataFrame, contigs: DataFrame, ds: str) -> DataFrame:
    """SAM rows in the shape that the maps take."""
    named = sam.join(contigs.select(F.col("name").alias("rname"), "tid"), "rname", "left")
    return named.select(F.lit(ds).alias("ds"), F.coalesce("tid", F.lit(-1)).alias("tid"), "pos", "flag", "mapq", "cigar", "seq", F.element_at("tags", "XM").alias("xm"), "n_tags", "qname", F.when(dna.has(F.col("flag"), dna.REVERSE), 1).otherwise(0).alias("strand"))


def read_caps(spark: SparkSession, path: str, ds: str) -> DataFrame:
    """ds, tid and max_reads of a binary file of caps: a count (one byte for mc, none for hmc) and that many 32-bit numbers."""
    raw = spark.read.format("binaryFile").load(path).select(F.hex("content").alias("h"))
    skip = 2 if ds == "mc" else 0
    body = F.substr("h", F.lit(skip + 1))
    words = F.regexp_extract_all(body, F.lit("[0-9A-F]{8}"), F.lit(0))
    if ds == "mc":
        words = F.slice(words, 1, F.conv(F.substring("h", 1, 2), 16, 10).cast("int"))
    rows = raw.select(F.posexplode(words).alias("tid", "w"))
    turned = F.concat(*[F.substring("w", i, 2) for i in (7, 5, 3, 1)])  # the low byte stands first
    return rows.select(F.lit(ds).alias("ds"), "tid", F.conv(turned, 16, 10).cast("long").alias("max_reads"))
