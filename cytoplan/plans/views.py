"""Sequencing tables derived from the general ones: the same SQL text runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplan.functions import dna

READS = """
SELECT (((l_orderkey * 10 + l_linenumber) * 30000 + l_partkey) * 2000 + l_suppkey) * 60 + CAST(l_quantity AS BIGINT) AS read_id,
  'q' || CAST(l_orderkey * 4 + CAST(floor(l_linenumber / 2) AS BIGINT) AS STRING) AS qname,
  CASE WHEN l_returnflag = 'N' THEN 'hmc' ELSE 'mc' END AS ds,
  CASE WHEN l_orderkey % 97 = 0 THEN -1 ELSE CAST(l_suppkey % 24 AS INT) END AS tid,
  CAST((l_partkey * 37 + l_linenumber * 11) % 2000 AS INT) AS pos,
  CAST(1 + (CASE WHEN l_partkey % 3 > 0 THEN 2 ELSE 0 END) + (CASE WHEN l_partkey % 11 = 0 THEN 4 ELSE 0 END)
    + (CASE WHEN l_partkey % 13 = 0 THEN 8 ELSE 0 END) + (CASE WHEN l_linestatus = 'F' THEN 0 ELSE 16 END)
    + (CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END) + (CASE WHEN l_partkey % 17 = 0 THEN 256 ELSE 0 END)
    + (CASE WHEN l_partkey % 19 = 0 THEN 512 ELSE 0 END) + (CASE WHEN l_partkey % 23 = 0 THEN 1024 ELSE 0 END) AS INT) AS flag,
  CAST(l_quantity AS INT) AS mapq,
  CASE CAST(l_orderkey % 5 AS INT)
    WHEN 0 THEN CAST(20 + l_linenumber * 4 AS STRING) || 'M'
    WHEN 1 THEN '5S' || CAST(15 + l_linenumber * 4 AS STRING) || 'M'
    WHEN 2 THEN '8M2D' || CAST(12 + l_linenumber * 4 AS STRING) || 'M'
    WHEN 3 THEN '6=3I' || CAST(10 + l_linenumber * 4 AS STRING) || 'M1X'
    ELSE '10M4N' || CAST(10 + l_linenumber * 4 AS STRING) || 'M' END AS cigar,
  substr(repeat('ACGTTGCANGCATCGACCGG', 4), CAST(1 + (l_orderkey + l_linenumber) % 20 AS INT), CAST(20 + l_linenumber * 4 AS INT)) AS seq,
  substr(repeat('.z.Z..x.h.H..X.m.u', 5), CAST(1 + (l_orderkey * 7 + l_linenumber) % 18 AS INT), CAST(20 + l_linenumber * 4 AS INT)) AS xm,
  substr(repeat('IIHGFEDCBA#5I', 6), CAST(1 + (l_orderkey * 3 + l_linenumber) % 13 AS INT), CAST(20 + l_linenumber * 4 AS INT)) AS qual,
  CAST(CASE WHEN l_orderkey % 10 = 0 THEN 6 ELSE 7 END AS INT) AS n_tags,
  CAST(l_suppkey % 24 AS INT) AS mtid,
  CAST(l_partkey % 400 - 100 AS INT) AS isize,
  CAST(l_partkey % 7 AS INT) AS nm,
  CAST(l_suppkey % 3 AS INT) AS lib,
  CAST((l_partkey * 13 + l_linenumber) % 1000 AS INT) AS sumq,
  (l_orderkey * 8 + l_linenumber) * 30000 + l_partkey AS file_ord
FROM {lineitem}
"""

CONTIGS = "SELECT CAST(n_nationkey AS INT) AS tid, n_name AS name, CAST(2100 + (n_nationkey * 7919) % 500 AS BIGINT) AS length FROM {nation} WHERE n_nationkey < 24"

REGIONS = "SELECT CAST(s_suppkey % 24 AS INT) AS chrom, CAST((s_suppkey * 131) % 1500 AS BIGINT) AS start, CAST((s_suppkey * 131) % 1500 + 60 + s_suppkey % 200 AS BIGINT) AS \"end\" FROM {supplier}"

VARIANTS = """
SELECT CASE WHEN o_orderkey % 31 = 0 THEN 'X' ELSE CAST(o_custkey % 22 + 1 AS STRING) END AS chrom,
  CAST((o_orderkey * 53) % 1000000 AS BIGINT) AS pos,
  CASE WHEN o_orderkey % 3 = 0 THEN 'rs' || CAST(o_orderkey AS STRING) ELSE '.' END AS id,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'A' WHEN 1 THEN 'G' WHEN 2 THEN 'C' ELSE 'TA' END AS ref,
  CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'G' WHEN 1 THEN 'A' WHEN 2 THEN 'T' WHEN 3 THEN 'G,T' ELSE 'GA' END AS alt,
  CASE WHEN o_orderkey % 13 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS qual,
  CASE WHEN o_orderkey % 7 = 0 THEN 'PASS' WHEN o_orderkey % 11 = 0 THEN 'old' ELSE '.' END AS filter,
  CASE WHEN o_orderkey % 17 = 0 THEN 'AA=1;H2' ELSE 'AA=1;DP=' || CAST(o_custkey % 80 AS STRING) || ';H2' END AS info,
  CASE WHEN o_orderkey % 41 = 0 THEN 'DP' ELSE 'GT:DP' END AS format,
  CAST(o_orderkey % 3 AS STRING) || '' AS k0, o_orderkey AS okey, o_custkey AS ckey
FROM {orders}
"""

#: The genotype of sample i, as arithmetic; the fifth is missing now and then.
GENOTYPES = [f"CAST((okey + {i} * ckey) % 2 AS STRING) || '/' || CASE WHEN (okey * {i + 1} + ckey) % 9 = 0 THEN '.' ELSE CAST((ckey + {i}) % 2 AS STRING) END || ':' || CAST(okey % 50 AS STRING)" for i in range(6)]

#: Letters of a raw read: every text is cut into reads of so many, one behind the other.
READ_LETTERS = 80

_SEQUENCE = "translate(lower(text), 'etaoinshrdlucmfwypvbgkjqxz', 'ACGTACGTACGTACGTNCGTACGTAC')"
_QUALITY = "translate(lower(text), 'etaoinshrdlucmfwypvbgkjqxz', 'IIHGFEDCBA#5IIHGFEDCBA#5II')"


def cut(column: str, letters: int = READ_LETTERS) -> str:
    """A text in pieces of so many letters, as an array, on both engines."""
    return f"regexp_extract_all({column}, '(?s).{{1,{letters}}}', 0)"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _read(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace('"end"', "`end`"), **tables(spark, sf_dir, table))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, READS, "lineitem")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, CONTIGS, "nation")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, REGIONS, "supplier")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, VARIANTS, "orders")
    return rows.selectExpr("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", f"array({', '.join(GENOTYPES)}) AS samples", "okey")


#: Places of a diploid genome: every so manieth differs between the two copies; and letters that are read wrongly.
HET_EVERY, WRONG_EVERY = 17, 60


def _letter(tid: Column, at: Column, copy: Column | None = None) -> Column:
    """The letter of a genome without repeats, in either of its two copies."""
    n = F.pmod(F.xxhash64(tid, at), F.lit(4))
    if copy is not None:
        n = (n + F.when((copy == 1) & (F.pmod(F.xxhash64(tid, at), F.lit(HET_EVERY)) == 0), 1).otherwise(0)) % 4
    return F.substr(F.lit("ACGT"), (n + 1).cast("int"), F.lit(1))


def genome_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of both copies of a genome that grows with the table, so that depth doesn't; an order's reads start at one
    place, come from one copy and have the same gaps."""
    base = reads(spark, sf_dir).select("read_id", "qname", "lib", "mapq", "cigar", "qual", F.floor(F.col("file_ord") / 240000).alias("okey"), (F.col("read_id") % 3).cast("int").alias("tid"))
    rows = base.select("read_id", "qname", "lib", "mapq", "cigar", "qual", "tid", "okey", (F.col("okey") * 3).cast("int").alias("pos"), F.when(F.col("read_id") % 2 == 1, dna.REVERSE).otherwise(0).alias("flag"))
    shown = F.transform(
        dna.places(F.col("cigar")),
        lambda p, i: F.when((p >= 0) & (F.pmod(F.xxhash64("read_id", i), F.lit(WRONG_EVERY)) > 0), _letter(F.col("tid"), (F.col("pos") + p).cast("long"), F.col("okey") % 2)).otherwise(
            F.substr(F.lit("ACGT"), (F.pmod(F.xxhash64("okey", i), F.lit(4)) + 1).cast("int"), F.lit(1))
        ),
    )
    rows = rows.withColumn("seq", F.array_join(shown, ""))
    return rows.withColumn("qual", F.rpad(F.substr("qual", F.lit(1), F.length("seq")), F.length("seq"), F.lit("F"))).drop("okey")


def genome_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, length and sequence of the genome's first copy."""
    last = _read(spark, sf_dir, "SELECT max(l_orderkey) AS okey FROM {lineitem}", "lineitem")
    rows = last.select((F.coalesce("okey", F.lit(0)) * 3 + 300).cast("long").alias("length"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tid"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("length") - 1), lambda i: _letter(F.col("tid"), i)), "")
    return rows.select("tid", "length", text.alias("sequence"))


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ordinal, sequence and quality of the reads that all documents are cut into."""
    whole = _read(spark, sf_dir, f"SELECT doc_id, {_SEQUENCE} AS s, {_QUALITY} AS q FROM {{documents}}", "documents")
    rows = whole.selectExpr("doc_id", f"{cut('s')} AS sequence", f"{cut('q')} AS quality").selectExpr("doc_id", "posexplode(arrays_zip(sequence, quality)) AS (ordinal, r)")
    return rows.selectExpr("CAST(doc_id AS STRING) || '_' || CAST(ordinal AS STRING) AS id", "ordinal", "r.sequence", "r.quality")


def plain(sql: str) -> str:
    """The SQL text with table names in place."""
    for name in ("lineitem", "nation", "supplier", "orders", "documents"):
        sql = sql.replace(f"{{{name}}}", name)
    return sql


DUCK_READS = f"v_reads AS ({plain(READS)})"
DUCK_CONTIGS = f"v_contigs AS ({plain(CONTIGS)})"
DUCK_REGIONS = f"v_regions AS ({plain(REGIONS)})"
DUCK_VARIANTS = f"v_vcf AS (SELECT *, [{', '.join(GENOTYPES)}] AS samples FROM ({plain(VARIANTS)}))"
DUCK_RAW = f"""v_raw AS (SELECT CAST(doc_id AS STRING) || '_' || CAST(ordinal AS STRING) AS id, CAST(ordinal AS INT) AS ordinal, s[ordinal + 1] AS sequence, q[ordinal + 1] AS quality
FROM (SELECT doc_id, s, q, unnest(range(len(s))) AS ordinal FROM (SELECT doc_id, {cut(_SEQUENCE)} AS s, {cut(_QUALITY)} AS q FROM documents)))"""
