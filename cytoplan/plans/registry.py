"""Queries of the operators over the tables in a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplan.functions import dna, text
from cytoplan.operators import alignments as al
from cytoplan.operators import calling as ca
from cytoplan.operators import genotypes as ge
from cytoplan.operators import indels as ind
from cytoplan.operators import meth_map as mm
from cytoplan.operators import phasing as ph
from cytoplan.operators import pileup as pl
from cytoplan.operators import raw_reads as rr
from cytoplan.operators import realign as ra
from cytoplan.operators import reference as rf
from cytoplan.operators import regions as rg
from cytoplan.operators import reports as rp
from cytoplan.operators import scoring as sc
from cytoplan.operators import signal as sg
from cytoplan.operators import spectrum as sp
from cytoplan.operators import target_cut as tc
from cytoplan.operators import variants as va
from cytoplan.operators.store import kept

from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Low enough for the given tables.
COVERAGE = 3


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*views: str) -> str:
    return "WITH " + ", ".join(views)


# ---- methylation maps

_GOOD = "tid >= 0 AND pos >= 0 AND regexp_matches(seq, '^[ACGTN]{2}') AND n_tags = 7 AND xm IS NOT NULL AND mapq >= 20"
_OPS = """ops AS (SELECT r.*, unnest(range(1, len(n) + 1)) AS k, n, o FROM (SELECT *, list_transform(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1), lambda x: CAST(x AS INT)) AS n, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2) AS o FROM good) r),
placed AS (SELECT *, n[k] AS size, o[k] AS op,
  coalesce(sum(CASE WHEN o[k] IN ('M', 'D', 'N', '=', 'X') THEN n[k] ELSE 0 END) OVER (PARTITION BY read_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ref_at,
  coalesce(sum(CASE WHEN o[k] IN ('M', 'I', 'S', '=', 'X') THEN n[k] ELSE 0 END) OVER (PARTITION BY read_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS read_at FROM ops),
span AS (SELECT read_id, sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN size ELSE 0 END) AS reach FROM placed GROUP BY read_id),
walked AS (
  SELECT read_id, ds, tid AS chr, CASE WHEN flag & 16 > 0 THEN 1 ELSE 0 END AS strand, pos AS start, length(seq) AS length, ref_at + i AS off, CASE WHEN op IN ('D', 'N') THEN 'D' ELSE substr(seq, CAST(read_at + i + 1 AS BIGINT), 1) END AS base, CASE WHEN op IN ('D', 'N') THEN '.' ELSE substr(xm, CAST(read_at + i + 1 AS BIGINT), 1) END AS xm
  FROM (SELECT *, unnest(range(size)) AS i FROM placed WHERE op IN ('M', 'D', 'N', '=', 'X'))
  UNION ALL
  SELECT read_id, ds, tid, CASE WHEN flag & 16 > 0 THEN 1 ELSE 0 END, pos, length(seq), unnest(range(CAST(reach AS BIGINT), length(seq))), 'R', '.' FROM good JOIN span USING (read_id)),
bases AS (SELECT *, CAST(start + off AS BIGINT) AS pos FROM walked)"""
_BASES = f"{_with(v.DUCK_READS)}, good AS (SELECT * FROM v_reads WHERE {_GOOD}), {_OPS}"
_SITES = f"""{_BASES}, sites AS (SELECT DISTINCT chr, strand, pos FROM bases WHERE xm <> '.' AND off < length),
cnt AS (SELECT s.chr, s.strand, s.pos,
  CAST(sum(CASE WHEN ds = 'mc' AND xm <> '.' AND xm NOT IN ('Z', 'X', 'H', 'M', 'U') THEN 1 ELSE 0 END) AS BIGINT) AS c,
  CAST(sum(CASE WHEN ds = 'mc' AND xm = '.' AND base <> CASE WHEN s.strand = 0 THEN 'C' ELSE 'G' END THEN 1 ELSE 0 END) AS BIGINT) AS nc,
  CAST(sum(CASE WHEN ds = 'mc' AND xm IN ('Z', 'X', 'H', 'M', 'U') THEN 1 ELSE 0 END) AS BIGINT) AS mc,
  CAST(sum(CASE WHEN ds = 'hmc' AND xm <> '.' AND xm NOT IN ('Z', 'X', 'H', 'M', 'U') THEN 1 ELSE 0 END) AS BIGINT) AS ch,
  CAST(sum(CASE WHEN ds = 'hmc' AND xm = '.' AND base <> CASE WHEN s.strand = 0 THEN 'C' ELSE 'G' END THEN 1 ELSE 0 END) AS BIGINT) AS nch,
  CAST(sum(CASE WHEN ds = 'hmc' AND xm IN ('Z', 'X', 'H', 'M', 'U') THEN 1 ELSE 0 END) AS BIGINT) AS hmc
  FROM sites s LEFT JOIN bases b ON b.chr = s.chr AND b.strand = s.strand AND b.pos = s.pos AND b.off <= b.length - 2 GROUP BY s.chr, s.strand, s.pos)"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mm.site_counts(mm.filter_reads(v.reads(spark, sf_dir)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mm.mixed_map(_sites(spark, sf_dir), COVERAGE)


@query(f"{_SITES} SELECT chr, pos, c, nc, mc, ch, nch, hmc FROM cnt WHERE strand = 0 AND (c + mc > {COVERAGE} OR ch + hmc > {COVERAGE})")
def meth_map_forward(spark, sf_dir):
    return mm.strand_map(_sites(spark, sf_dir), 0, COVERAGE)


@query(f"{_SITES} SELECT chr, pos, c, nc, mc, ch, nch, hmc FROM cnt WHERE strand = 1 AND (c + mc > {COVERAGE} OR ch + hmc > {COVERAGE})")
def meth_map_reverse(spark, sf_dir):
    return mm.strand_map(_sites(spark, sf_dir), 1, COVERAGE)


@query(f"{_SITES} SELECT chr, pos, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in mm.COUNTERS)} FROM cnt GROUP BY chr, pos HAVING sum(c) + sum(mc) >= {COVERAGE} OR sum(ch) + sum(hmc) >= {COVERAGE}")
def meth_map_mix(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"{_SITES} SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in mm.COUNTERS)}, count(*) AS sites FROM cnt")
def meth_totals(spark, sf_dir):
    return _sites(spark, sf_dir).agg(*[F.sum(c).alias(c) for c in mm.COUNTERS], F.count(F.lit(1)).alias("sites"))


@query(f"{_BASES} SELECT DISTINCT chr, CAST(strand AS INT) AS strand, pos FROM bases WHERE xm <> '.' AND off < length")
def candidate_sites(spark, sf_dir):
    return mm.candidate_sites(mm.filter_reads(v.reads(spark, sf_dir)))


@query(f"{_BASES} SELECT ds, chr, base, xm, count(*) AS n, CAST(sum(off) AS BIGINT) AS offsets FROM bases GROUP BY ds, chr, base, xm")
def cigar_lift_bases(spark, sf_dir):
    return mm.lifted_bases(mm.filter_reads(v.reads(spark, sf_dir))).groupBy("ds", "chr", "base", "xm").agg(F.count(F.lit(1)).alias("n"), F.sum("off").alias("offsets"))


@query(f"{_with(v.DUCK_READS)}, good AS (SELECT * FROM v_reads), {_OPS} SELECT read_id, CAST(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN size ELSE 0 END) AS INT) AS ref_length, CAST(sum(CASE WHEN op IN ('M', 'D', 'N') THEN size ELSE 0 END) AS INT) AS legacy_length, CAST(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN size ELSE 0 END) AS INT) AS query_length FROM placed GROUP BY read_id")
def cigar_ref_span(spark, sf_dir):
    c = F.col("cigar")
    return v.reads(spark, sf_dir).select("read_id", dna.reference_length(c).alias("ref_length"), dna.reference_length(c, legacy=True).alias("legacy_length"), dna.query_length(c).alias("query_length"))


_STATUS = f"CASE WHEN tid = -1 THEN 'unmapped' WHEN {_GOOD} THEN 'valid' ELSE 'malformed' END"


@query(f"{_with(v.DUCK_READS)}, s AS (SELECT ds, {_STATUS} AS status FROM v_reads) SELECT ds, count(*) AS total, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'unmapped') AS unmapped, count(*) FILTER (status = 'malformed') AS malformed, round((count(*) FILTER (status <> 'valid')) * 100 / count(*), 6) AS skipped_pct FROM s GROUP BY ds")
def read_filter_counts(spark, sf_dir):
    return mm.run_statistics(v.reads(spark, sf_dir))


@query(f"{_with(v.DUCK_READS)} SELECT ds, tid, count(*) AS total, count(*) FILTER ({_GOOD}) AS passed FROM v_reads GROUP BY ds, tid")
def reads_per_chromosome(spark, sf_dir):
    return v.reads(spark, sf_dir).groupBy("ds", "tid").agg(F.count(F.lit(1)).alias("total"), F.count_if(mm.acceptable()).alias("passed"))


_CAPS = "SELECT ds, tid, CAST(5 + tid * 2 AS BIGINT) AS max_reads FROM (SELECT DISTINCT ds, tid FROM {reads}) WHERE tid >= 0"


@query(f"{_with(v.DUCK_READS)}, caps AS ({_CAPS.replace('{reads}', 'v_reads')}), n AS (SELECT *, row_number() OVER (PARTITION BY ds, tid ORDER BY file_ord) AS rn FROM v_reads) SELECT n.read_id, n.ds, n.tid FROM n LEFT JOIN caps USING (ds, tid) WHERE max_reads IS NULL OR rn <= max_reads + 1")
def read_cap_first_k(spark, sf_dir):
    reads = v.reads(spark, sf_dir)
    return mm.first_reads(reads, spark.sql(_CAPS, reads=reads)).select("read_id", "ds", "tid")


@query(f"{_with(v.DUCK_READS)}, l AS (SELECT tid, CAST(sum(length(seq)) AS BIGINT) AS load FROM v_reads WHERE tid >= 0 GROUP BY tid), r AS (SELECT *, row_number() OVER (ORDER BY load DESC, tid) - 1 AS k FROM l) SELECT tid, load, CAST(CASE WHEN k % 10 < 5 THEN k % 10 ELSE 9 - k % 10 END AS INT) AS worker FROM r")
def chromosome_snake_schedule(spark, sf_dir):
    """Chromosomes dealt evenly by the letters of their reads, as output files are grouped."""
    return mm.snake_schedule(mm.read_loads(v.reads(spark, sf_dir)), 5, "load")


_SAMPLES = 20


@query(f"""{_SITES}, one AS (SELECT chr, pos, CAST(sum(c) AS BIGINT) AS c, CAST(sum(nc) AS BIGINT) AS nc, CAST(sum(mc) AS BIGINT) AS mc FROM cnt GROUP BY chr, pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY chr) // {_SAMPLES} AS steps FROM one WHERE pos BETWEEN 100 AND 1900)
SELECT a.chr, a.i * {1800 // _SAMPLES} + 100 AS plot_pos, round(avg(b.c + b.nc + b.mc), 6) AS coverage, round(avg(b.mc) / greatest(max(b.mc), 1), 6) AS signal
FROM ranked a JOIN ranked b ON a.chr = b.chr AND b.i BETWEEN a.i AND a.i + a.steps - 1 WHERE a.i < {_SAMPLES} AND a.steps > 0 GROUP BY a.chr, a.i""")
def signal_window(spark, sf_dir):
    one = mm.mixed_map(_sites(spark, sf_dir), 0)
    return sg.window_signal(one, 100, 1900, _SAMPLES).select("chr", "plot_pos", F.round("coverage", 6).alias("coverage"), F.round("signal", 6).alias("signal"))


# ---- regions and sets


@query(f"{_with(v.DUCK_READS, v.DUCK_REGIONS)} SELECT read_id FROM v_reads r WHERE EXISTS (SELECT 1 FROM v_regions g WHERE g.chrom = r.tid AND g.start <= r.pos AND g.\"end\" >= r.pos + length(r.seq))")
def region_semi_join(spark, sf_dir):
    reads = v.reads(spark, sf_dir).select("read_id", "tid", "pos", (F.col("pos") + F.length("seq")).alias("stop"))
    return rg.contained(reads, v.regions(spark, sf_dir), "tid", "pos", "stop", 500).select("read_id")


@query(f"{_with(v.DUCK_READS, v.DUCK_REGIONS)} SELECT read_id FROM v_reads r WHERE EXISTS (SELECT 1 FROM v_regions g WHERE g.chrom = r.tid AND g.\"end\" > r.pos AND g.start < r.pos + length(r.seq))")
def bed_overlap_semi(spark, sf_dir):
    reads = v.reads(spark, sf_dir).select("read_id", "tid", "pos", (F.col("pos") + F.length("seq")).alias("stop"))
    return rg.overlapping(reads, v.regions(spark, sf_dir), "tid", "pos", "stop", 500).select("read_id")


@query(f"{_with(v.DUCK_READS)}, c AS (SELECT tid, unnest(range((pos + 1) // 100, (pos + 1 + length(seq)) // 100 + 1)) AS k FROM v_reads WHERE tid >= 0) SELECT tid AS chromosome, k AS chunk_id, count(*) AS features_count FROM c GROUP BY tid, k")
def chunk_counts(spark, sf_dir):
    return al.chunks(v.reads(spark, sf_dir), 100)


@query(f"""{_with(v.DUCK_REGIONS)}, s AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v_regions),
n AS (SELECT *, sum(CASE WHEN seen IS NULL OR start - seen > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS members FROM n GROUP BY chrom, island""")
def merge_close_regions(spark, sf_dir):
    return rg.merge_close(v.regions(spark, sf_dir), ["chrom"], "start", "end", 20)


_LISTS = "SELECT CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN CAST(s_suppkey AS STRING) || ':' || CAST(s_suppkey * 10 AS STRING) || '-' || CAST(s_suppkey * 20 AS STRING) || ',X' WHEN 1 THEN 'Y:' || CAST(s_suppkey AS STRING) ELSE 'MT,' END AS text FROM {supplier}"


@query(f"WITH t AS ({v.plain(_LISTS)}), r AS (SELECT unnest(string_split(text, ',')) AS r FROM t), p AS (SELECT regexp_extract(r, '^([^:]+)', 1) AS chrom, regexp_extract(r, '^[^:]+:(\\d+)', 1) AS a, regexp_extract(r, '^[^:]+:\\d+-(\\d+)', 1) AS b FROM r WHERE r <> '') SELECT chrom, CASE WHEN a = '' THEN 1 ELSE CAST(a AS BIGINT) END AS start, CASE WHEN b = '' THEN 4294967295 ELSE CAST(b AS BIGINT) END AS \"end\" FROM p")
def parse_region_lists(spark, sf_dir):
    return rg.parse_regions(spark.sql(_LISTS, **v.tables(spark, sf_dir, "supplier")))


_HALF = "SELECT qname FROM v_reads WHERE lib = 0"


@query(f"{_with(v.DUCK_READS)} SELECT DISTINCT qname FROM v_reads")
def set_unique(spark, sf_dir):
    return v.reads(spark, sf_dir).select("qname").distinct()


@query(f"{_with(v.DUCK_READS)} SELECT read_id, qname FROM v_reads WHERE lib <> 0 AND qname IN ({_HALF})")
def set_intersect(spark, sf_dir):
    reads = v.reads(spark, sf_dir).select("read_id", "qname", "lib")
    return rg.intersect_keep(reads.filter("lib <> 0"), reads.filter("lib = 0"), ["qname"]).select("read_id", "qname")


@query(f"{_with(v.DUCK_READS)} SELECT read_id, qname FROM v_reads WHERE lib <> 0 AND qname NOT IN ({_HALF})")
def set_complement(spark, sf_dir):
    reads = v.reads(spark, sf_dir).select("read_id", "qname", "lib")
    return rg.complement(reads.filter("lib <> 0"), reads.filter("lib = 0"), ["qname"]).select("read_id", "qname")


# ---- alignments

_CHAIN = "(flag & 1 = 0 OR flag & 2 > 0) AND flag & 256 = 0 AND nm BETWEEN 0 AND 4 AND mapq >= 10 AND length(seq) >= 28"


@query(f"{_with(v.DUCK_READS)}, bad AS (SELECT DISTINCT qname FROM v_reads WHERE NOT ({_CHAIN}) AND flag & 1 > 0) SELECT read_id FROM v_reads WHERE {_CHAIN} AND qname NOT IN (SELECT qname FROM bad)")
def bam_filter_chain(spark, sf_dir):
    return al.filter_alignments(v.reads(spark, sf_dir), proper_pairs=True, unique=True, errors=(0, 4), quality=(10, -1), length=(28, -1)).select("read_id")


@query(f"{_with(v.DUCK_READS, v.DUCK_REGIONS)}, bad AS (SELECT DISTINCT qname FROM v_reads WHERE mapq < 10), inside AS (SELECT * FROM v_reads r WHERE EXISTS (SELECT 1 FROM v_regions g WHERE g.chrom = r.tid AND g.start <= r.pos AND g.\"end\" >= r.pos + length(r.seq))), out AS (SELECT DISTINCT qname FROM v_reads WHERE read_id NOT IN (SELECT read_id FROM inside)) SELECT read_id FROM inside WHERE mapq >= 10 AND qname NOT IN (SELECT qname FROM bad) AND qname NOT IN (SELECT qname FROM out)")
def mate_purge_anti(spark, sf_dir):
    return al.filter_alignments(v.reads(spark, sf_dir), quality=(10, -1), regions=v.regions(spark, sf_dir)).select("read_id")


@query(f"{_with(v.DUCK_READS)} SELECT read_id FROM v_reads WHERE flag & 4 > 0")
def bam_filter_unmapped(spark, sf_dir):
    return al.filter_alignments(v.reads(spark, sf_dir), unmapped=True).select("read_id")


@query(f"{_with(v.DUCK_READS)} SELECT read_id FROM v_reads WHERE mapq >= 15 AND flag & 3 = 3 AND flag & 1024 = 0 AND lib IN (0, 2)")
def samtools_view(spark, sf_dir):
    return al.view(v.reads(spark, sf_dir), min_mapq=15, need=3, forbid=1024, libraries=[0, 2]).select("read_id")


@query(f"""{_with(v.DUCK_READS)} SELECT flag & 512 > 0 AS qc_fail, count(*) AS total, count(*) FILTER (flag & 1024 > 0) AS duplicates, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 1 > 0) AS paired,
count(*) FILTER (flag & 65 = 65) AS read1, count(*) FILTER (flag & 129 = 129) AS read2, count(*) FILTER (flag & 3 = 3 AND flag & 4 = 0) AS properly_paired, count(*) FILTER (flag & 1 > 0 AND flag & 12 = 0) AS both_mapped,
count(*) FILTER (flag & 1 > 0 AND flag & 12 = 8) AS singletons, count(*) FILTER (flag & 1 > 0 AND flag & 12 = 0 AND tid <> mtid) AS mate_elsewhere, count(*) FILTER (flag & 1 > 0 AND flag & 12 = 0 AND tid <> mtid AND mapq >= 5) AS mate_elsewhere_q5 FROM v_reads GROUP BY 1""")
def flagstat(spark, sf_dir):
    return al.flag_statistics(v.reads(spark, sf_dir))


@query(f"{_with(v.DUCK_READS, v.DUCK_CONTIGS)}, k AS (SELECT tid, length FROM v_contigs UNION ALL SELECT -1, 0) SELECT k.tid, k.length, count(read_id) FILTER (flag & 4 = 0) AS mapped, count(read_id) FILTER (flag & 4 > 0) AS unmapped FROM k LEFT JOIN v_reads r ON r.tid = k.tid GROUP BY k.tid, k.length")
def idxstats(spark, sf_dir):
    return al.index_statistics(v.reads(spark, sf_dir), v.contigs(spark, sf_dir))


_LETTERS = ", ".join(f"CAST(sum(length(seq) - length(replace(seq, '{b}', ''))) AS BIGINT) AS n_{b.lower()}" for b in "ACGTN")


@query(f"""{_with(v.DUCK_READS)}, i AS (SELECT read_id, regexp_extract_all(cigar, '(\\d+)[ID]', 1) AS x FROM v_reads), t AS (SELECT sum(len(x)) AS indels, sum(list_sum(list_transform(x, lambda y: CAST(y AS INT)))) AS bases FROM i)
SELECT count(*) AS reads, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 > 0) AS unmapped, count(*) FILTER (flag & 256 = 0) AS unique_reads, count(*) FILTER (flag & 16 > 0) AS reverse_reads, min(isize) AS min_isize, max(isize) AS max_isize, CAST(sum(isize) AS BIGINT) AS sum_isize,
min(mapq) AS min_mapq, max(mapq) AS max_mapq, CAST(sum(mapq) AS BIGINT) AS sum_mapq, CAST(min(length(seq)) AS INT) AS min_length, CAST(max(length(seq)) AS INT) AS max_length, (SELECT CAST(indels AS BIGINT) FROM t) AS indels, (SELECT CAST(bases AS BIGINT) FROM t) AS indel_bases, {_LETTERS}, count(*) FILTER (flag & 1 > 0) = 0 AS single_end FROM v_reads""")
def bam_stats_global(spark, sf_dir):
    return al.summary(v.reads(spark, sf_dir))


@query(f"{_with(v.DUCK_READS)} SELECT least(nm, 5) AS errors, count(*) AS reads FROM v_reads GROUP BY 1")
def nm_histogram(spark, sf_dir):
    return al.histogram(v.reads(spark, sf_dir), F.col("nm"), "errors", 5)


@query(f"{_with(v.DUCK_READS)} SELECT mapq AS quality, count(*) AS reads FROM v_reads GROUP BY 1")
def quality_histogram(spark, sf_dir):
    return al.histogram(v.reads(spark, sf_dir), F.col("mapq"), "quality")


@query(f"{_with(v.DUCK_READS)} SELECT CAST((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) * 100 // length(seq) AS INT) AS gc, count(*) AS reads FROM v_reads GROUP BY 1")
def gc_histogram(spark, sf_dir):
    return al.histogram(v.reads(spark, sf_dir), dna.gc_percent(F.col("seq")), "gc")


_DEPTH = f"""{_with(v.DUCK_READS, v.DUCK_CONTIGS)}, good AS (SELECT * FROM v_reads WHERE flag & 1796 = 0 AND tid >= 0), {_OPS}, d AS (SELECT tid, p AS pos, count(*) AS depth FROM (SELECT tid, unnest(range(CAST(pos + ref_at AS BIGINT), CAST(pos + ref_at + size AS BIGINT))) AS p FROM placed WHERE op IN ('M', '=', 'X')) GROUP BY tid, p)"""


@query(f"{_DEPTH} SELECT tid, pos, depth FROM d")
def depth_per_base(spark, sf_dir):
    return al.depth(v.reads(spark, sf_dir), span=256)


@query(f"""{_DEPTH}, t AS (SELECT CAST(sum(length) AS BIGINT) AS total FROM v_contigs), h AS (SELECT least(depth, 99) AS depth, count(*) AS positions FROM d GROUP BY 1 UNION ALL SELECT 0, total - (SELECT count(*) FROM d) FROM t)
SELECT depth, positions, round(CAST(sum(positions) OVER (ORDER BY depth DESC) AS BIGINT) / (SELECT total FROM t), 9) AS fraction FROM h""")
def coverage_histogram(spark, sf_dir):
    return al.coverage_histogram(al.depth(v.reads(spark, sf_dir)), v.contigs(spark, sf_dir))


@query(f"{_with(v.DUCK_READS)} SELECT read_id, row_number() OVER (ORDER BY CASE WHEN tid < 0 THEN 1 ELSE 0 END, tid, pos, read_id) - 1 AS rank FROM v_reads")
def coordinate_sort(spark, sf_dir):
    """Every read's place in the sorted file."""
    return al.coordinate_ranks(v.reads(spark, sf_dir)).select("read_id", "rank")


@query(f"{_with(v.DUCK_READS)} SELECT read_id, row_number() OVER (ORDER BY CAST(substr(qname, 2) AS BIGINT), flag & 192, read_id) - 1 AS rank FROM v_reads")
def name_sort(spark, sf_dir):
    """Every read's place in the file sorted by name."""
    return al.name_ranks(v.reads(spark, sf_dir)).select("read_id", "rank")


@query(f"{_with(v.DUCK_READS)} SELECT read_id, tid, pos FROM v_reads ORDER BY CASE WHEN tid < 0 THEN 1 ELSE 0 END, tid, pos, read_id LIMIT 500")
def coordinate_sort_topk(spark, sf_dir):
    return al.sort_by_coordinate(v.reads(spark, sf_dir)).select("read_id", "tid", "pos").limit(500)


@query(f"{_with(v.DUCK_READS)} SELECT read_id, qname FROM v_reads ORDER BY CAST(substr(qname, 2) AS BIGINT), flag & 192, read_id LIMIT 500")
def name_sort_topk(spark, sf_dir):
    return al.sort_by_name(v.reads(spark, sf_dir)).select("read_id", "qname").limit(500)


@query(f"{_with(v.DUCK_READS)}, h AS (SELECT *, row_number() OVER (PARTITION BY lib, tid, pos, isize ORDER BY sumq DESC, read_id) AS rn FROM v_reads WHERE flag & 1 > 0 AND flag & 12 = 0 AND mtid = tid AND isize > 0) SELECT read_id FROM v_reads WHERE qname NOT IN (SELECT qname FROM h WHERE rn > 1)")
def rmdup_pe(spark, sf_dir):
    return al.drop_pair_duplicates(v.reads(spark, sf_dir)).select("read_id")


@query(f"{_with(v.DUCK_READS)}, good AS (SELECT * FROM v_reads), {_OPS}, k AS (SELECT r.read_id, row_number() OVER (PARTITION BY lib, tid, flag & 16, CASE WHEN flag & 16 > 0 THEN pos + reach ELSE pos END ORDER BY sumq DESC, read_id) AS rn FROM v_reads r JOIN span USING (read_id) WHERE flag & 4 = 0) SELECT read_id FROM k WHERE rn = 1 UNION ALL SELECT read_id FROM v_reads WHERE flag & 4 > 0")
def rmdup_se(spark, sf_dir):
    return al.drop_single_duplicates(v.reads(spark, sf_dir)).select("read_id")


@query(f"""{_with(v.DUCK_READS)}, good AS (SELECT * FROM v_reads), {_OPS}, f AS (SELECT r.*, CAST(CASE WHEN flag & 16 > 0 THEN pos + reach ELSE pos END AS INT) AS five FROM v_reads r JOIN span USING (read_id)),
p AS (SELECT qname, max(CASE WHEN flag & 64 > 0 THEN tid END) AS t1, max(CASE WHEN flag & 64 > 0 THEN pos END) AS p1, max(CASE WHEN flag & 64 > 0 THEN five END) AS f1, max(CASE WHEN flag & 128 > 0 THEN tid END) AS t2, max(CASE WHEN flag & 128 > 0 THEN pos END) AS p2, max(CASE WHEN flag & 128 > 0 THEN five END) AS f2 FROM f GROUP BY qname),
j AS (SELECT read_id, qname, tid, five, CASE WHEN flag & 64 > 0 THEN t2 ELSE t1 END AS mate_tid, CASE WHEN flag & 64 > 0 THEN p2 ELSE p1 END AS mate_pos, CASE WHEN flag & 64 > 0 THEN f2 ELSE f1 END AS mate_five FROM f JOIN p USING (qname))
SELECT read_id, qname, mate_tid, mate_pos, CASE WHEN tid = mate_tid THEN mate_five - five ELSE 0 END AS insert_size FROM j WHERE mate_tid IS NOT NULL""")
def fixmate_pairs(spark, sf_dir):
    return al.fix_mates(v.reads(spark, sf_dir))


@query(f"{_with(v.DUCK_READS)} SELECT read_id, CASE WHEN ds = 'mc' THEN 0 ELSE 1 END AS rg FROM v_reads")
def merge_union(spark, sf_dir):
    reads = v.reads(spark, sf_dir)
    return al.merge_sorted([reads.filter("ds = 'mc'"), reads.filter("ds = 'hmc'")]).select("read_id", "rg")


@query(f"{_with(v.DUCK_READS)} SELECT read_id, qname || CASE WHEN flag & 64 > 0 THEN '/1' ELSE '/2' END AS id, CASE WHEN flag & 16 > 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS sequence, CASE WHEN flag & 16 > 0 THEN reverse(qual) ELSE qual END AS quality FROM v_reads")
def bam2fq(spark, sf_dir):
    return al.to_fastq(v.reads(spark, sf_dir))


@query(f"{_with(v.DUCK_READS, v.DUCK_REGIONS)}, good AS (SELECT * FROM v_reads WHERE mapq >= 5 AND flag & 512 = 0), {_OPS} SELECT r.read_id FROM good r JOIN span USING (read_id) WHERE EXISTS (SELECT 1 FROM v_regions g WHERE g.chrom = r.tid AND g.\"end\" > r.pos AND g.start < r.pos + reach)")
def view_regions(spark, sf_dir):
    return al.view_regions(v.reads(spark, sf_dir), v.regions(spark, sf_dir), min_mapq=5, forbid=512).select("read_id")


@query(f"{_with(v.DUCK_READS)} SELECT CAST(CASE WHEN flag & 1 = 0 THEN 0 WHEN flag & 64 > 0 THEN 1 ELSE 2 END AS INT) AS mate, flag & 16 > 0 AS reverse, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 > 0) AS unmapped, count(*) FILTER (flag & 256 = 0) AS unique_reads FROM v_reads GROUP BY 1, 2")
def mate_statistics(spark, sf_dir):
    return al.mate_statistics(v.reads(spark, sf_dir))


@query(f"{_with(v.DUCK_READS, v.DUCK_CONTIGS)}, s AS (SELECT CASE WHEN flag & 4 = 0 AND tid >= 0 THEN tid ELSE -1 END AS tid, CAST(sum(length(seq)) AS BIGINT) AS letters FROM v_reads GROUP BY 1), k AS (SELECT tid, length FROM v_contigs UNION ALL SELECT -1, NULL) SELECT k.tid, coalesce(letters, 0) AS letters, round(coalesce(letters, 0) / length, 6) AS depth FROM k LEFT JOIN s USING (tid)")
def mean_depth(spark, sf_dir):
    return al.mean_depth(v.reads(spark, sf_dir), v.contigs(spark, sf_dir))


@query(f"{_with(v.DUCK_READS)}, o AS (SELECT ds, list(CAST(length(seq) AS DOUBLE) ORDER BY file_ord) AS x FROM v_reads GROUP BY ds) SELECT ds, round(list_reduce([x[1]] || x, lambda m, y: (m + y) / 2), 6) AS mean FROM o")
def running_mean_length(spark, sf_dir):
    return al.running_mean(v.reads(spark, sf_dir), F.length("seq"), "ds").select("ds", F.round("mean", 6).alias("mean"))


@query(f"{_with(v.DUCK_READS)} SELECT qname, read_id FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY file_ord, read_id) AS rn FROM v_reads) WHERE rn = 1")
def set_unique_first(spark, sf_dir):
    """The first read of every name in file order."""
    rows = v.reads(spark, sf_dir).select("qname", "read_id", F.struct("file_ord", "read_id").alias("at"))
    return rg.unique_first(rows, ["qname"], "at").select("qname", "read_id")


@query(f"{_with(v.DUCK_READS)} SELECT read_id, qname FROM v_reads WHERE lib = 0 AND qname IN (SELECT qname FROM v_reads WHERE lib <> 0)")
def set_intersect_smaller(spark, sf_dir):
    reads = v.reads(spark, sf_dir).select("read_id", "qname", "lib")
    return rg.intersect_smaller(reads.filter("lib <> 0"), reads.filter("lib = 0"), ["qname"]).select("read_id", "qname")


# ---- raw reads


@query(f"{_with(v.DUCK_RAW)} SELECT id, CAST(len(list_filter(string_split(quality, ''), lambda c: NOT ascii(c) BETWEEN 35 AND 80)) AS INT) AS outside FROM v_raw")
def fastq_quality_range(spark, sf_dir):
    return rr.quality_range(v.raw_reads(spark, sf_dir), 35, 80)


@query(f"{_with(v.DUCK_RAW)} SELECT id, CAST(length(sequence) AS INT) AS length, {', '.join(f'''CAST(length(sequence) - length(replace(sequence, '{b}', '')) AS INT) AS n_{b.lower()}''' for b in 'ACGTN')}, round(list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c))) / length(quality), 6) AS mean_quality FROM v_raw")
def fastq_stats(spark, sf_dir):
    return rr.read_statistics(v.raw_reads(spark, sf_dir))


@query(f"{_with(v.DUCK_RAW)} SELECT id, coalesce(length(sequence) BETWEEN 40 AND 80 AND list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c))) / length(quality) BETWEEN 50 AND 65 AND length(sequence) - length(replace(sequence, 'N', '')) < 4, false) AS passed FROM v_raw")
def fastq_filter(spark, sf_dir):
    return rr.filter_reads(v.raw_reads(spark, sf_dir), (40, 80), (50, 65), 4).select("id", "passed")


@query(f"{_with(v.DUCK_RAW)} SELECT id, substr(sequence, 4, greatest(length(sequence) - 8, 0)) AS sequence, substr(quality, 4, greatest(length(sequence) - 8, 0)) AS quality FROM v_raw")
def fastq_trim(spark, sf_dir):
    return rr.trim(v.raw_reads(spark, sf_dir), 3, 5).select("id", "sequence", "quality")


@query(f"{_with(v.DUCK_RAW)} SELECT id, reverse(translate(sequence, 'ACGT', 'TGCA')) AS rc, regexp_replace(translate(sequence, 'ACGT', '0123'), '[^0-3]', '4', 'g') AS code, replace(sequence, 'C', 'T') AS bs FROM v_raw")
def sequence_functions(spark, sf_dir):
    s = F.col("sequence")
    return v.raw_reads(spark, sf_dir).select("id", dna.reverse_complement(s).alias("rc"), dna.encode_bases(s).alias("code"), dna.bisulfite(s, F.lit(0)).alias("bs"))


@query(f"{_with(v.DUCK_RAW)}, k AS (SELECT unnest(list_transform(range(1, length(sequence) - 5), lambda i: substr(sequence, i, 7))) AS kmer FROM v_raw WHERE length(sequence) >= 7) SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_counts(spark, sf_dir):
    return rr.kmers(v.raw_reads(spark, sf_dir), "id", "sequence", 7).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_with(v.DUCK_RAW)} SELECT id, translate(sequence, 'C', 'T') AS sequence, CAST(length(sequence) - length(replace(sequence, 'C', '')) AS INT) AS converted, CAST(length(sequence) - length(replace(replace(sequence, 'C', ''), 'T', '')) AS INT) AS total FROM v_raw")
def simulate_conversion(spark, sf_dir):
    """Complete conversion of every raw read: the letters that change, among those that read as T afterwards."""
    return rr.converted(v.raw_reads(spark, sf_dir)).select("id", "sequence", "converted", "total")


# ---- variants

_GT = """g AS (SELECT *, CASE WHEN format LIKE 'GT%' THEN list_transform(samples, lambda s: list_transform(string_split(split_part(s, ':', 1), '/'), lambda a: coalesce(TRY_CAST(a AS INT), -1))) END AS gts, string_split(alt, ',') AS alts FROM v_vcf),
s AS (SELECT *, list_transform(range(0, len(alts) + 1), lambda k: len(list_filter(flatten(gts), lambda a: a = k))) AS counts, len(list_filter(flatten(gts), lambda a: a < 0)) AS missing FROM g)"""
_VCF = f"{_with(v.DUCK_VARIANTS)}, {_GT}"


@query(f"{_VCF} SELECT okey, counts[1] AS n_ref, counts[2] AS n_alt, missing AS missing_alleles, len(list_filter(gts, lambda x: list_contains(x, -1))) AS missing_genotypes, round(list_min(list_transform(counts, lambda c: c / nullif(list_sum(counts), 0))), 6) AS maf, length(ref) <> length(alt) AS is_indel FROM s")
def vcf_variant_stats(spark, sf_dir):
    rows = va.with_statistics(v.variants(spark, sf_dir))
    as_long = lambda c: c.cast("long")
    got = F.col("gts").isNotNull()
    counts = lambda i: F.when(got, as_long(F.col("allele_counts")[i]))
    return rows.select("okey", counts(0).alias("n_ref"), counts(1).alias("n_alt"), F.when(got, as_long(F.col("missing_alleles"))).alias("missing_alleles"), F.when(got, as_long(F.col("missing_genotypes"))).alias("missing_genotypes"), F.when(got, F.round("maf", 6)).alias("maf"), "is_indel")


_STEPS = [
    ("q30", "qual >= 30"),
    ("snp", "id <> '.'"),
    ("cov20", "coalesce(TRY_CAST(regexp_extract(info, 'DP=(\\d+)', 1) AS INT) >= 20, false)"),
    ("maf45", "coalesce(list_min(list_transform(counts, lambda c: c / nullif(list_sum(counts), 0))) <= 0.45, false)"),
    ("missing10", "coalesce(missing / nullif(missing + list_sum(counts), 0) <= 0.1, false)"),
    ("alleles2", "len(alts) = 1"),
]
_FAIL = "CASE " + " ".join(f"WHEN NOT ({test}) THEN '{name}'" for name, test in _STEPS) + " END"


@query(f"{_VCF}, f AS (SELECT *, {_FAIL} AS failed FROM s) SELECT okey, failed IS NULL AS passed, CASE WHEN failed IS NULL THEN CASE WHEN filter = '.' THEN 'PASS' ELSE filter END WHEN filter IN ('.', 'PASS') THEN failed ELSE filter || ';' || failed END AS filter FROM f")
def vcf_filter_chain(spark, sf_dir):
    chain = [va.quality_filter(30), va.snp_filter(), va.coverage_filter(20), va.maf_filter(0.45), va.missing_filter(0.1), va.alleles_filter(2)]
    return va.filter_chain(v.variants(spark, sf_dir), chain).select("okey", "passed", "filter")


@query(f"{_VCF}, r AS (SELECT CAST(s_suppkey % 22 + 1 AS STRING) AS chrom, (s_suppkey * 7919) % 900000 AS a, (s_suppkey * 7919) % 900000 + 5000 AS b FROM supplier) SELECT okey FROM s WHERE EXISTS (SELECT 1 FROM r WHERE r.chrom = s.chrom AND s.pos BETWEEN a AND b)")
def vcf_region_filter(spark, sf_dir):
    regions = v.tables(spark, sf_dir, "supplier")["supplier"].selectExpr("CAST(s_suppkey % 22 + 1 AS STRING) AS chrom", "(s_suppkey * 7919) % 900000 AS start", "(s_suppkey * 7919) % 900000 + 5000 AS `end`")
    return va.filter_chain(v.variants(spark, sf_dir), [va.region_filter(regions)], regions).filter("passed").select("okey")


_GENES = "SELECT 'g' || CAST(s_suppkey % 5 AS STRING) AS name, CAST(s_suppkey % 22 + 1 AS STRING) AS chrom, (s_suppkey * 7919) % 900000 AS start, (s_suppkey * 7919) % 900000 + 9000 AS \"end\" FROM {supplier}"


@query(f"{_VCF}, genes AS ({v.plain(_GENES)}), f AS (SELECT *, EXISTS (SELECT 1 FROM genes r WHERE r.name IN ('g1', 'g3') AND r.chrom = s.chrom AND s.pos BETWEEN r.start AND r.\"end\") AS hit FROM s) SELECT okey, hit AS passed, CASE WHEN hit THEN CASE WHEN filter = '.' THEN 'PASS' ELSE filter END WHEN filter IN ('.', 'PASS') THEN 'reg' ELSE filter || ';reg' END AS filter FROM f")
def vcf_gene_filter(spark, sf_dir):
    genes = v._read(spark, sf_dir, _GENES, "supplier")
    names = ["g1", "g3"]
    return va.filter_chain(v.variants(spark, sf_dir), [va.gene_filter(genes, names)], va.gene_regions(genes, names)).select("okey", "passed", "filter")


_ONE = "length(ref) = 1 AND length(alt) = 1 AND ref <> alt"


@query(f"""{_VCF} SELECT count(*) AS variants, 6 AS samples, count(*) FILTER (id <> '.') AS snps, count(*) FILTER (length(ref) <> length(alt)) AS indels, count(*) FILTER ({_ONE} AND ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS transitions, count(*) FILTER ({_ONE} AND ref || alt NOT IN ('AG', 'GA', 'CT', 'TC')) AS transversions,
count(*) FILTER (len(alts) = 1) AS biallelic, count(*) FILTER (len(alts) > 1) AS multiallelic, count(*) FILTER (filter = 'PASS') AS passes, round(sum(CASE WHEN qual >= 0 THEN qual ELSE 0 END) / count(*), 6) AS mean_quality FROM s""")
def vcf_file_stats(spark, sf_dir):
    return va.file_statistics(v.variants(spark, sf_dir))


@query(f"{_VCF}, u AS (SELECT unnest(range(6)) AS sample, unnest(gts) AS gt FROM s WHERE gts IS NOT NULL) SELECT CAST(sample AS INT) AS sample, count(*) FILTER (list_contains(gt, -1)) AS missing_genotypes, count(*) AS genotypes FROM u GROUP BY 1")
def vcf_sample_stats(spark, sf_dir):
    return va.sample_statistics(v.variants(spark, sf_dir))


_TRIOS = "SELECT * FROM VALUES (2, 0, 1, 1), (3, 0, 1, 2), (5, 4, 1, 1) AS t(sample, father, mother, sex)"


@query(f"""{_VCF}, p AS (SELECT * FROM (VALUES (2, 0, 1, 1), (3, 0, 1, 2), (5, 4, 1, 1)) t(sample, father, mother, sex)), k AS (SELECT p.sample, chrom, sex, gts[p.sample + 1] AS c, gts[father + 1] AS f, gts[mother + 1] AS m FROM s, p WHERE gts IS NOT NULL)
SELECT sample, count(*) FILTER (NOT list_contains(c, -1) AND NOT list_contains(f, -1) AND NOT list_contains(m, -1) AND CASE WHEN chrom = 'X' AND sex = 1 THEN NOT (list_contains(m, c[1]) AND list_contains(m, c[2])) ELSE NOT ((list_contains(f, c[1]) AND list_contains(m, c[2])) OR (list_contains(f, c[2]) AND list_contains(m, c[1]))) END) AS mendel_errors FROM k GROUP BY sample""")
def mendel_errors(spark, sf_dir):
    return va.mendel_errors(v.variants(spark, sf_dir), spark.sql(_TRIOS))


@query(f"""{_VCF}, p AS (SELECT * FROM (VALUES (2, 0, 1, 1), (3, 0, 1, 2), (5, 4, 1, 1)) t(sample, father, mother, sex)), k AS (SELECT p.sample, chrom, sex, gts[p.sample + 1] AS c, gts[father + 1] AS f, gts[mother + 1] AS m FROM s, p WHERE gts IS NOT NULL),
d AS (SELECT sample, chrom, sex, list_contains(c, -1) OR list_contains(f, -1) OR list_contains(m, -1) AS missing, len(list_filter(c, lambda a: a > 0)) AS c, len(list_filter(f, lambda a: a > 0)) AS f, len(list_filter(m, lambda a: a > 0)) AS m FROM k),
t AS (SELECT sample, CASE WHEN missing THEN -1 WHEN chrom IN ('Y', 'MT') THEN -2 WHEN chrom = 'X' AND sex = 1 THEN CASE WHEN c = 2 AND m = 0 THEN 9 WHEN c = 0 AND m = 2 THEN 10 ELSE 0 END
  WHEN c = 1 THEN CASE WHEN f = 0 AND m = 0 THEN 1 WHEN f = 2 AND m = 2 THEN 2 ELSE 0 END WHEN c = 0 THEN CASE WHEN f = 2 AND m = 2 THEN 5 WHEN f = 2 THEN 4 WHEN m = 2 THEN 3 ELSE 0 END
  ELSE CASE WHEN f = 0 AND m = 0 THEN 8 WHEN f = 0 THEN 6 WHEN m = 0 THEN 7 ELSE 0 END END AS type FROM d) SELECT sample, CAST(type AS INT) AS type, count(*) AS records FROM t GROUP BY sample, type""")
def mendel_types(spark, sf_dir):
    return va.mendel_types(v.variants(spark, sf_dir), spark.sql(_TRIOS))


@query(f"{_VCF} SELECT okey, array_to_string(list_transform(range(0, (len(alts) + 1) * (len(alts) + 1)), lambda k: len(list_filter(gts, lambda g: NOT list_contains(g, -1) AND g[1] * (len(alts) + 1) + g[2] = k))), ',') AS counts FROM s WHERE gts IS NOT NULL")
def vcf_genotype_counts(spark, sf_dir):
    """How often every pair of alleles stands there."""
    return va.with_statistics(v.variants(spark, sf_dir)).filter("gts IS NOT NULL").select("okey", F.array_join(F.col("genotype_counts").cast("array<string>"), ",").alias("counts"))


_AFFECTED = [True, False, True, True, False, False]
_CASE = str(_AFFECTED).lower()


def _share(test: str) -> str:
    return f"round(coalesce(len(list_filter(seen, lambda z: {test})) * 100 / nullif(len(seen), 0), 0), 6)"


@query(f"""{_VCF}, z AS (SELECT chrom, pos, list_filter(list_zip(gts, {_CASE}), lambda z: NOT list_contains(z[1], -1)) AS seen FROM s WHERE gts IS NOT NULL)
SELECT chrom, pos, {_share("z[2] AND list_sum(z[1]) > 0")} AS cases_dominant, {_share("NOT z[2] AND list_sum(z[1]) = 0")} AS controls_dominant, {_share("z[2] AND list_min(z[1]) > 0")} AS cases_recessive, {_share("NOT z[2] AND list_min(z[1]) = 0")} AS controls_recessive FROM z""")
def inheritance_pct(spark, sf_dir):
    return va.inheritance(v.variants(spark, sf_dir), _AFFECTED)


@query(f"""{_VCF}, z AS (SELECT okey, filter, CASE WHEN gts IS NOT NULL THEN list_filter(list_zip(gts, {_CASE}), lambda z: NOT list_contains(z[1], -1)) END AS seen FROM s),
f AS (SELECT okey, filter, seen IS NOT NULL AND {_share("z[2] AND list_sum(z[1]) > 0")} >= 30 AND {_share("NOT z[2] AND list_sum(z[1]) = 0")} >= 30 AS ok FROM z)
SELECT okey, ok AS passed, CASE WHEN ok THEN CASE WHEN filter = '.' THEN 'PASS' ELSE filter END WHEN filter IN ('.', 'PASS') THEN 'dominant30' ELSE filter || ';dominant30' END AS filter FROM f""")
def vcf_inheritance_filter(spark, sf_dir):
    return va.filter_chain(v.variants(spark, sf_dir), [va.inheritance_filter("dominant", 0.3, _AFFECTED)]).select("okey", "passed", "filter")


@query(f"""{_VCF}, x AS (SELECT okey, chrom, pos, list_transform(gts, lambda g: CASE WHEN list_contains(g, -1) THEN NULL ELSE len(list_filter(g, lambda a: a > 0)) END) AS d FROM s WHERE gts IS NOT NULL),
y AS (SELECT a.chrom, a.pos AS pos1, b.pos AS pos2, unnest(a.d) AS p, unnest(b.d) AS q, a.okey AS k1, b.okey AS k2 FROM x a JOIN x b ON a.chrom = b.chrom AND b.pos > a.pos AND b.pos - a.pos <= 300),
t AS (SELECT chrom, pos1, pos2, k1, k2, count(*) FILTER (p IS NOT NULL AND q IS NOT NULL) AS n, coalesce(sum(p) FILTER (q IS NOT NULL), 0) AS a, coalesce(sum(q) FILTER (p IS NOT NULL), 0) AS b, coalesce(sum(p * p) FILTER (q IS NOT NULL), 0) AS aa, coalesce(sum(q * q) FILTER (p IS NOT NULL), 0) AS bb, coalesce(sum(p * q), 0) AS ab FROM y GROUP BY ALL)
SELECT chrom, pos1, pos2, round(coalesce(CAST((n * ab - a * b) * (n * ab - a * b) AS DOUBLE) / nullif(CAST((n * aa - a * a) * (n * bb - b * b) AS DOUBLE), 0), 0), 6) AS r2 FROM t""")
def ld_pairs(spark, sf_dir):
    return va.linkage(v.variants(spark, sf_dir), 300)


_LOCI = "SELECT a.chrom AS chrom1, a.pos AS pos1, b.chrom AS chrom2, b.pos AS pos2 FROM {a} a JOIN {a} b ON b.okey = a.okey + 1"


def _site_pairs() -> str:
    sure = {"f00": "2 * c00 + c01 + c10", "f01": "2 * c02 + c01 + c12", "f10": "2 * c20 + c10 + c21", "f11": "2 * c22 + c12 + c21"}
    part = "coalesce(f.f00 * f.f11 / nullif(f.f00 * f.f11 + f.f01 * f.f10, 0), 0.5) * c11"
    step = ", ".join(f"'{k}': ({s} + {part if k in ('f00', 'f11') else f'c11 - {part}'}) / (2.0 * n)" for k, s in sure.items())
    cells = ", ".join(f"len(list_filter(z, lambda q: q[1] = {a} AND q[2] = {b})) AS c{a}{b}" for a in range(3) for b in range(3))
    start, rest = ("{" + ", ".join(f"'{k}': {x}::DOUBLE" for k in sure) + "}" for x in (0.25, 0))
    return f"""{_VCF}, d AS (SELECT okey, chrom, pos, list_transform(gts, lambda g: CASE WHEN list_contains(g, -1) THEN -1 ELSE len(list_filter(g, lambda a: a > 0)) END) AS x FROM s WHERE gts IS NOT NULL),
p AS ({_LOCI.replace('{a}', 'd')}), z AS (SELECT p.*, list_filter(list_zip(a.x, b.x), lambda q: q[1] >= 0 AND q[2] >= 0) AS z FROM p JOIN d a ON a.chrom = chrom1 AND a.pos = pos1 JOIN d b ON b.chrom = chrom2 AND b.pos = pos2),
c AS (SELECT chrom1, pos1, chrom2, pos2, len(z) AS n, {cells} FROM z), e AS (SELECT *, list_reduce([{start}] || list_transform(range(30), lambda i: {rest}), lambda f, i: {{{step}}}) AS f FROM c WHERE n > 0),
h AS (SELECT *, f.f10 + f.f11 AS a, f.f01 + f.f11 AS b FROM e)
SELECT chrom1, pos1, chrom2, pos2, CAST(n AS INT) AS n, round(coalesce((f.f11 - a * b) * (f.f11 - a * b) / nullif(a * (1 - a) * b * (1 - b), 0), 0), 6) AS r2 FROM h"""


@query(_site_pairs())
def ld_given_pairs(spark, sf_dir):
    """Haplotype r2 of listed pairs of sites."""
    rows = v.variants(spark, sf_dir)
    sites = rows.filter("split(format, ':')[0] = 'GT'").select("okey", "chrom", "pos")
    return va.haplotype_r2(rows, spark.sql(_LOCI, a=sites))


@query(f"{_VCF} SELECT okey, 'AA=1' || CASE WHEN info LIKE '%DP=%' THEN ';' || regexp_extract(info, '(DP=\\d+)', 1) ELSE '' END AS info, samples[3] || ',' || samples[1] AS picked FROM s")
def vcf_projection(spark, sf_dir):
    rows = va.subset(va.without_info(v.variants(spark, sf_dir), ["H2"]), [2, 0])
    return rows.select("okey", "info", F.array_join("samples", ",").alias("picked"))


# ---- pileup, tests, alignment


_PILED = """e AS (SELECT *, coalesce(o[k + 1], '') AS next_op, coalesce(n[k + 1], 0) AS next_n FROM placed JOIN span USING (read_id)),
b AS (SELECT read_id, ds, lib, tid, flag & 16 > 0 AS rev, mapq, CAST(pos + ref_at + i AS BIGINT) AS p0, ref_at + i = 0 AS head, ref_at + i = reach - 1 AS tail, op, i = size - 1 AS ends, next_op, next_n, read_at, i, seq, qual FROM (SELECT *, unnest(range(size)) AS i FROM e WHERE op IN ('M', '=', 'X', 'D', 'N')))"""
_HEAD = "CASE WHEN head THEN '^' || chr(CAST(least(mapq, 93) + 33 AS INT)) ELSE '' END"
_LETTER = "substr(seq, CAST(read_at + i + 1 AS BIGINT), 1)"
_QUAL = "substr(qual, CAST(CASE WHEN op IN ('M', '=', 'X') THEN read_at + i + 1 ELSE greatest(read_at, 1) END AS BIGINT), 1)"


def _token(own: str, gone: str) -> str:
    return f"""{_HEAD} || CASE WHEN op = 'D' THEN '*' WHEN op = 'N' THEN CASE WHEN rev THEN '<' ELSE '>' END ELSE {own} END
 || CASE WHEN ends AND op IN ('M', '=', 'X') AND next_op = 'I' THEN '+' || CAST(next_n AS STRING) || CASE WHEN rev THEN lower(substr(seq, CAST(read_at + i + 2 AS BIGINT), next_n)) ELSE substr(seq, CAST(read_at + i + 2 AS BIGINT), next_n) END WHEN ends AND op IN ('M', '=', 'X') AND next_op = 'D' THEN '-' || CAST(next_n AS STRING) || CASE WHEN rev THEN lower({gone}) ELSE {gone} END ELSE '' END || CASE WHEN tail THEN '$' ELSE '' END"""


_CASED = f"CASE WHEN rev THEN lower({_LETTER}) ELSE {_LETTER} END"


@query(f"""{_with(v.DUCK_READS)}, good AS (SELECT * FROM v_reads WHERE flag & 1796 = 0 AND tid >= 0 AND mapq >= 10), {_OPS}, {_PILED},
t AS (SELECT tid, p0 AS pos, read_id, {_token(_CASED, "repeat('N', next_n)")} AS tok, {_QUAL} AS q FROM b)
SELECT tid, pos, count(*) AS depth, string_agg(tok, '' ORDER BY read_id) AS bases, string_agg(q, '' ORDER BY read_id) AS qualities FROM t GROUP BY tid, pos""")
def mpileup(spark, sf_dir):
    return pl.pileup_text(v.reads(spark, sf_dir), min_mapq=10)


@query(f"""{_with(v.DUCK_READS, v.DUCK_REGIONS)}, good AS (SELECT * FROM v_reads WHERE flag & 1796 = 0 AND tid >= 0 AND mapq >= 10 AND lib <> 1), {_OPS}, {_PILED},
t AS (SELECT tid, p0 AS pos, read_id, {_token(_CASED, "repeat('N', next_n)")} AS tok, {_QUAL} AS q FROM b WHERE EXISTS (SELECT 1 FROM v_regions g WHERE g.chrom = tid AND g.start <= p0 AND g."end" > p0))
SELECT tid, pos, count(*) AS depth, string_agg(tok, '' ORDER BY read_id) AS bases, string_agg(q, '' ORDER BY read_id) AS qualities FROM t GROUP BY tid, pos""")
def mpileup_regions(spark, sf_dir):
    """Positions inside regions, without one group of reads."""
    return pl.pileup_text(v.reads(spark, sf_dir), min_mapq=10, beds=v.regions(spark, sf_dir), without=("lib", [1]))


@query(f"{_with(v.DUCK_READS)} SELECT tid, p AS pos, count(*) AS depth FROM (SELECT tid, unnest(range(CAST(pos AS BIGINT), CAST(pos + length(seq) AS BIGINT))) AS p FROM v_reads WHERE tid >= 0) GROUP BY tid, p")
def depth_plain(spark, sf_dir):
    """Depth under whole reads, whatever their CIGAR."""
    return al.plain_depth(v.reads(spark, sf_dir))


_CONTIG_TEXT = "SELECT tid, length, substr(repeat('ACGTTGCAAGCATCGACCGG', 140), tid + 1, CAST(length AS INT)) AS sequence FROM {contigs}"
_REF = f"ref AS ({_CONTIG_TEXT.replace('{contigs}', 'v_contigs')})"
_AT_REF = "substr(sequence, p0 + 1, 1)"
_FILES = ("mc", "hmc")
_SIDE = ", ".join(f"count(*) FILTER (ds = '{n}' AND rn <= 12) AS depth_{n}, coalesce(string_agg(tok, '' ORDER BY read_id) FILTER (ds = '{n}' AND rn <= 12), '*') AS bases_{n}, coalesce(string_agg(q, '' ORDER BY read_id) FILTER (ds = '{n}' AND rn <= 12), '*') AS qualities_{n}" for n in _FILES)


@query(f"""{_with(v.DUCK_READS, v.DUCK_CONTIGS)}, good AS (SELECT * FROM v_reads WHERE flag & 1796 = 0 AND tid >= 0 AND mapq >= 10), {_OPS}, {_PILED}, {_REF},
t0 AS (SELECT b.*, r.sequence, {_QUAL} AS q FROM b LEFT JOIN ref r ON r.tid = b.tid),
t AS (SELECT tid, p0 AS pos, read_id, ds, q, coalesce(nullif({_AT_REF}, ''), 'N') AS ref, {_token(f"CASE WHEN {_LETTER} = {_AT_REF} THEN CASE WHEN rev THEN ',' ELSE '.' END ELSE {_CASED} END", "rpad(substr(sequence, p0 + 2, next_n), next_n, 'N')")} AS tok FROM t0 WHERE ascii(q) - 33 >= 13),
u AS (SELECT *, row_number() OVER (PARTITION BY tid, pos, ds ORDER BY read_id) AS rn FROM t)
SELECT tid, pos, max(ref) AS ref, {_SIDE} FROM u GROUP BY tid, pos""")
def mpileup_files(spark, sf_dir):
    """Two files side by side with the reference's letters, a bound of quality and a depth of twelve for each."""
    contigs = spark.sql(_CONTIG_TEXT, contigs=v.contigs(spark, sf_dir))
    out = pl.pileup_files(v.reads(spark, sf_dir), "ds", list(_FILES), contigs, min_mapq=10, min_quality=13, max_depth=12)
    return out.withColumn("ref", F.when(F.col("ref") == "", "N").otherwise(F.col("ref")))


_E = "pow(10.0, -(ascii(q) - 33) / 10.0)"
def _likely(sample: str = "lib") -> str:
    return f"""{_with(v.DUCK_READS, v.DUCK_CONTIGS)}, good AS (SELECT * FROM v_reads WHERE flag & 1796 = 0 AND tid >= 0 AND mapq >= 10), {_OPS}, {_PILED}, {_REF},
x0 AS (SELECT b.tid, p0 AS pos, {sample} AS lib, {_AT_REF} AS ref, {_LETTER} AS letter, {_QUAL} AS q FROM b JOIN ref r ON r.tid = b.tid WHERE op IN ('M', '=', 'X')),
x AS (SELECT *, {_E} AS e, ascii(q) - 33 AS w FROM x0 WHERE ascii(q) - 33 >= 13 AND letter IN ('A', 'C', 'G', 'T') AND ref IN ('A', 'C', 'G', 'T')),
a0 AS (SELECT tid, pos, letter, sum(w) AS w FROM x WHERE letter <> ref GROUP BY tid, pos, letter),
a AS (SELECT tid, pos, arg_max(letter, struct_pack(w := w, o := -ascii(letter))) AS alt FROM a0 GROUP BY tid, pos),
l AS (SELECT x.tid, x.pos, lib, max(ref) AS ref, max(alt) AS alt, count(*) AS n, sum(log10(CASE WHEN letter = ref THEN 1 - e ELSE e / 3 END)) AS l0, sum(log10(CASE WHEN letter IN (ref, alt) THEN (1 - e + e / 3) / 2 ELSE e / 3 END)) AS l1, sum(log10(CASE WHEN letter = alt THEN 1 - e ELSE e / 3 END)) AS l2 FROM x JOIN a ON a.tid = x.tid AND a.pos = x.pos GROUP BY x.tid, x.pos, lib),
g AS (SELECT tid, pos, lib, ref, alt, n, CAST(round(-10 * (l0 - greatest(l0, l1, l2))) AS INT) AS pl0, CAST(round(-10 * (l1 - greatest(l0, l1, l2))) AS INT) AS pl1, CAST(round(-10 * (l2 - greatest(l0, l1, l2))) AS INT) AS pl2 FROM l)"""


_LIKELY = _likely()
#: Every third read is of another sample.
_THIRDS = _likely("CAST(b.read_id % 3 AS INT)")


def _likelihoods(spark: SparkSession, sf_dir: str, thirds: bool = False) -> DataFrame:
    contigs = spark.sql(_CONTIG_TEXT, contigs=v.contigs(spark, sf_dir))
    reads = v.reads(spark, sf_dir)
    if thirds:
        reads = reads.withColumn("lib", (F.col("read_id") % 3).cast("int"))
    return pl.genotype_likelihoods(reads, contigs, "lib", min_mapq=10, min_quality=13)


def _with_contigs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return v.reads(spark, sf_dir), spark.sql(_CONTIG_TEXT, contigs=v.contigs(spark, sf_dir))


@query()
def baq_qualities(spark, sf_dir):
    """Every read with its base alignment qualities, the plain and the extended ones (tests/test_realign.py has the model by hand)."""
    reads, contigs = _with_contigs(spark, sf_dir)
    plain = ra.with_baq(reads.select("read_id", "flag", "tid", "pos", "cigar", "seq", "qual"), contigs, into="baq")
    return ra.with_baq(plain, contigs, extended=True, into="extended").select("read_id", "baq", "extended")


@query(f"""{_with(v.DUCK_READS, v.DUCK_CONTIGS)}, good AS (SELECT * FROM v_reads WHERE flag & 4 = 0 AND tid >= 0), {_OPS}, {_REF},
l AS (SELECT read_id, substr(seq, CAST(read_at + i + 1 AS BIGINT), 1) AS b, substr(sequence, CAST(pos + ref_at + i + 1 AS BIGINT), 1) AS r, ascii(substr(qual, CAST(read_at + i + 1 AS BIGINT), 1)) - 33 AS q FROM (SELECT *, unnest(range(size)) AS i FROM placed WHERE op IN ('M', '=', 'X')) JOIN ref USING (tid)),
s AS (SELECT read_id, count(*) + count(*) FILTER (r <> 'N' AND b <> 'N' AND q >= 13) AS n, count(*) FILTER (r <> 'N' AND b <> 'N' AND q >= 13 AND b <> r) AS mm, coalesce(sum(least(q, 33)) FILTER (r <> 'N' AND b <> 'N' AND q >= 13 AND b <> r), 0) AS sq FROM l GROUP BY read_id),
cl AS (SELECT read_id, sum(ascii(substr(qual, CAST(read_at + i + 1 AS BIGINT), 1)) - 33) AS c FROM (SELECT *, unnest(range(size)) AS i FROM placed WHERE op = 'S') GROUP BY read_id),
t AS (SELECT s.read_id, sq - 4.343::DOUBLE * (mm * ln(n) - lgamma(mm + 1)) + coalesce(c, 0) / 5 AS t FROM s LEFT JOIN cl USING (read_id))
SELECT read_id, CAST(CASE WHEN t > 40 THEN -1 ELSE floor(sqrt((40 - greatest(t, 0)) / 40) * 40 + 0.499::DOUBLE) END AS INT) AS cap FROM t""")
def capped_mapq(spark, sf_dir):
    """What the mismatches of every mapped read allow as its mapping quality."""
    return ra.capped_mapq(*_with_contigs(spark, sf_dir))


@query(f"{_LIKELY} SELECT * FROM g")
def genotype_likelihoods(spark, sf_dir):
    return _likelihoods(spark, sf_dir)


_SEEN = f"""{_with(v.DUCK_READS, v.DUCK_CONTIGS)}, good AS (SELECT * FROM v_reads WHERE flag & 1796 = 0 AND tid >= 0 AND mapq >= 10), {_OPS}, {_PILED}, {_REF},
x0 AS (SELECT b.tid, p0 AS pos, lib, {_AT_REF} AS ref, strpos('ACGTN', {_LETTER}) - 1 AS l, CAST(rev AS INT) AS r, ascii({_QUAL}) - 33 AS q, least(mapq, 60) AS m, read_at + i AS offs, length(seq) AS size, CASE WHEN regexp_matches(cigar, '^\\d+S') THEN CAST(regexp_extract(cigar, '^(\\d+)S', 1) AS INT) ELSE 0 END AS clip
 FROM (SELECT b.*, g.cigar FROM b JOIN good g USING (read_id)) b JOIN ref r ON r.tid = b.tid WHERE op IN ('M', '=', 'X')),
x AS (SELECT *, strpos('ACGT', ref) - 1 AS k, greatest(4, least(q, m, 63)) AS eff FROM x0 WHERE ref IN ('A', 'C', 'G', 'T'))"""
_TERM = "(lgamma(n + 1) - lgamma({j} + 1) - lgamma(n - {j} + 1) + {j} * ln(e) + (n - {j}) * ln(1 - e))"


def _log_tail(k: str) -> str:
    """The logarithm of the chance of k or more wrong letters among n, in proportion to its first term."""
    first = _TERM.format(j=k)
    return f"({first} + ln(list_sum(list_transform(range({k}, n + 1), lambda j: exp({_TERM.format(j='j')} - {first})))))"


_HET = "CASE WHEN {k} = 0 THEN 0 ELSE lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) END - ln(2) * ({n})"
_PAIR = f"greatest(0, CASE WHEN a = b THEN CASE WHEN list_sum(cs) > cs[a + 1] THEN list_sum(bs) - bs[a + 1] ELSE 0 END ELSE list_sum(bs) - bs[a + 1] - bs[b + 1] - 4.343::DOUBLE * ({_HET.format(k='cs[b + 1]', n='cs[a + 1] + cs[b + 1]')}) END)"


@query(f"""{_SEEN}, all_u AS (SELECT *, count(*) OVER (PARTITION BY tid, pos, lib) AS total, row_number() OVER (PARTITION BY tid, pos, lib ORDER BY eff, r, l) AS place FROM x WHERE q >= 13),
u AS (SELECT *, least(total, 255) AS n, pow(10::DOUBLE, -eff / 10) AS e,
 row_number() OVER (PARTITION BY tid, pos, lib, l, r ORDER BY place DESC) - 1 AS w, row_number() OVER (PARTITION BY tid, pos, lib, l ORDER BY place DESC) - 1 AS c
 FROM all_u WHERE total <= 255 OR (place * 255) // total > ((place - 1) * 255) // total),
d AS (SELECT *, (pow(1 - 0.17::FLOAT::DOUBLE, w) * 0.97::DOUBLE + 0.03::DOUBLE) * (-10 / ln(10)) * ({_log_tail('(c + 1)')} - {_log_tail('c')}) AS bad FROM u WHERE c < n),
s AS (SELECT tid, pos, lib, max(ref) AS ref, max(k) AS k, max(total) AS depth, [{', '.join(f'coalesce(sum(bad) FILTER (l = {i}), 0)' for i in range(5))}] AS bs, [{', '.join(f'count(*) FILTER (l = {i})' for i in range(5))}] AS cs FROM d GROUP BY tid, pos, lib),
t AS (SELECT tid, pos, max(k) AS k, [{', '.join(f'coalesce(sum(eff) FILTER (l = {i}), 0)' for i in range(4))}] AS qs FROM all_u GROUP BY tid, pos),
o AS (SELECT tid, pos, k, qs, list_reverse_sort(list_transform(list_filter(range(4), lambda i: i <> k), lambda i: [qs[i + 1], i])) AS o FROM t),
a AS (SELECT tid, pos, [k] || list_transform(o[1:least(len(list_filter(o, lambda y: y[1] > 0)) + 1, 3)], lambda y: CAST(y[2] AS BIGINT)) AS al, qs FROM o WHERE o[1][1] > 0),
g AS (SELECT s.*, al, qs, unnest(range(len(al))) AS i FROM s JOIN a USING (tid, pos)), h AS (SELECT *, unnest(range(i + 1)) AS j FROM g), v AS (SELECT *, al[j + 1] AS a, al[i + 1] AS b FROM h),
p AS (SELECT *, {_PAIR} AS p FROM v)
SELECT tid, pos, lib, max(ref) AS ref, max(array_to_string(list_transform(al, lambda y, z: CASE WHEN z = len(al) AND z > 1 AND qs[y + 1] = 0 THEN 'X' ELSE substr('ACGT', y + 1, 1) END), ',')) AS alleles, max(depth) AS depth,
 array_to_string(list_transform(list(p ORDER BY i, j), lambda y: CAST(least(255, floor(y - list_min(list(p)) + 0.499::DOUBLE)) AS INT)), ',') AS pl FROM p GROUP BY tid, pos, lib""")
def genotype_likelihoods_dependent(spark, sf_dir):
    """Likelihoods of all genotypes where errors of one letter and strand depend on each other."""
    reads, contigs = _with_contigs(spark, sf_dir)
    out = ca.dependent_likelihoods(reads, contigs, "lib", min_mapq=10)
    return out.withColumn("pl", F.array_join(F.col("pl").cast("array<string>"), ","))


_SIDES = ", ".join(f"count(*) FILTER (q >= 13 AND {c} AND r = {i}) AS {s}_{n}" for s, c in (("ref", "l = k"), ("alt", "l <> k")) for i, n in enumerate(("forward", "reverse")))
_POWERS = ", ".join(f"CAST(coalesce(sum({x}) FILTER (q >= 13 AND {c}), 0) AS BIGINT) AS {s}_{n}, CAST(coalesce(sum({x} * {x}) FILTER (q >= 13 AND {c}), 0) AS BIGINT) AS {s}_{n}_squares" for n, x in (("base", "q"), ("mapq", "m"), ("edge", "edge")) for s, c in (("ref", "l = k"), ("alt", "l <> k")))


@query(f"""{_SEEN}, y AS (SELECT *, CAST(least(offs, size - 1 - offs, 25) AS BIGINT) AS edge, offs - clip AS at FROM x),
an AS (SELECT tid, pos, max(ref) AS ref, count(*) FILTER (q >= 13) AS depth, count(*) AS raw_depth, {_SIDES}, {_POWERS} FROM y GROUP BY tid, pos),
z AS (SELECT *, row_number() OVER () AS row FROM y WHERE l <> k),
ds AS (SELECT one.tid, one.pos, one.lib, sum(abs(one.at - two.at)) / count(*) AS mvd FROM z one JOIN z two ON one.tid = two.tid AND one.pos = two.pos AND one.lib = two.lib AND one.row < two.row GROUP BY 1, 2, 3),
dp AS (SELECT tid, pos, lib, count(*) AS dp, CAST(sum(size) AS BIGINT) // count(*) AS len FROM z GROUP BY 1, 2, 3),
vb AS (SELECT tid, pos, dp, len / 2.9::DOUBLE AS mu, floor(mvd) AS mvd, len, pow(len / 1.9::DOUBLE / (least(dp, 5) + 1), 2) AS s2 FROM ds JOIN dp USING (tid, pos, lib)),
pr AS (SELECT tid, pos, CASE WHEN dp > 3 THEN least(dp, 5) ELSE dp END AS w, CASE WHEN dp = 2 THEN CASE WHEN mvd = 0 THEN 1 / len ELSE (len - mvd) * 2 / len / len END
 WHEN dp = 3 THEN CASE WHEN mvd > 2 * mu THEN 0 ELSE sin(mvd * 3.14::DOUBLE / 2 / mu) / (4 * mu / 3.14::DOUBLE) END
 ELSE exp(-(mvd - mu) * (mvd - mu) / CASE WHEN mvd < mu THEN 2 ELSE 3.125::DOUBLE END / s2) / (1.125::DOUBLE * sqrt(2 * 3.14::DOUBLE * s2)) END AS p FROM vb)
SELECT an.*, round(coalesce(v.vdb, 1), 6) AS vdb FROM an LEFT JOIN (SELECT tid, pos, sum(p * w) / sum(w) AS vdb FROM pr GROUP BY tid, pos) v USING (tid, pos)""")
def site_annotations(spark, sf_dir):
    """The sixteen annotations of every site and how far apart variants lie in their reads."""
    reads, contigs = _with_contigs(spark, sf_dir)
    return ca.site_annotations(reads, contigs, "lib", min_mapq=10).withColumn("vdb", F.round("vdb", 6))


@query()
def indel_likelihoods(spark, sf_dir):
    """Likelihoods of insertions and deletions at every gap of the reads (tests/test_indels.py works sites out by hand)."""
    reads = kept(v.genome_reads(spark, sf_dir).filter("mapq >= 10"))  # else its letters are made anew wherever their number is asked for
    out = ind.indel_likelihoods(reads, v.genome_contigs(spark, sf_dir), "lib", min_mapq=10)
    return out.withColumn("pl", F.array_join(F.col("pl").cast("array<string>"), ","))


@query()
def phased_blocks(spark, sf_dir):
    """Heterozygous sites with their letters on either copy (tests/test_phasing.py tries all assignments)."""
    sites, _ = ph.phase(v.genome_reads(spark, sf_dir).filter("mapq >= 1"), least_lod=10)
    return sites


@query()
def target_cut(spark, sf_dir):
    """Regions that are covered on purpose, with consensus letters after extended base alignment quality
    (tests/test_target_cut.py walks from position to position)."""
    # stored: else a read's letters are made anew wherever their number is asked for
    reads, contigs = kept(v.genome_reads(spark, sf_dir).filter("mapq >= 25")), v.genome_contigs(spark, sf_dir)
    return tc.target_cut(ca.consensus(reads, contigs=contigs, baq="extended"), contigs, enter=-60)


@query(f"{_LIKELY} SELECT tid, pos, lib, CAST(CASE WHEN pl0 = 0 THEN 0 WHEN pl1 = 0 THEN 1 ELSE 2 END AS INT) AS gt, CAST(list_sort([pl0, pl1, pl2])[2] AS INT) AS gq FROM g")
def genotype_calls(spark, sf_dir):
    return pl.call_genotypes(_likelihoods(spark, sf_dir), "lib")


@query(f"""{_with(v.DUCK_READS)}, c AS (SELECT tid, count(*) FILTER (flag & 16 = 0 AND mapq >= 25) AS a, count(*) FILTER (flag & 16 > 0 AND mapq >= 25) AS b, count(*) FILTER (flag & 16 = 0 AND mapq < 25) AS c, count(*) FILTER (flag & 16 > 0 AND mapq < 25) AS d FROM v_reads GROUP BY tid),
h AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS k, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM c),
p AS (SELECT *, exp(k - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)) AS p, exp(k - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1)) AS seen FROM h)
SELECT tid, a, b, c, d, round(least(1, sum(CASE WHEN p <= seen * (1 + 1e-7) THEN p ELSE 0 END)), 6) AS p_value FROM p GROUP BY tid, a, b, c, d""")
def strand_bias(spark, sf_dir):
    reads = v.reads(spark, sf_dir)
    forward, high = dna.lacks(F.col("flag"), dna.REVERSE), F.col("mapq") >= 25
    counts = reads.groupBy("tid").agg(*[F.count_if(t).alias(k) for k, t in (("a", forward & high), ("b", ~forward & high), ("c", forward & ~high), ("d", ~forward & ~high))])
    return counts.select("*", F.round(sc.fisher_exact("a", "b", "c", "d"), 6).alias("p_value"))


@query(f"""{_VCF}, k AS (SELECT okey, len(list_filter(gts, lambda g: list_sum(g) = 0 AND NOT list_contains(g, -1))) AS n0, len(list_filter(gts, lambda g: list_sum(g) = 1 AND NOT list_contains(g, -1))) AS n1, len(list_filter(gts, lambda g: list_sum(g) = 2 AND NOT list_contains(g, -1))) AS n2 FROM s WHERE gts IS NOT NULL AND len(alts) = 1),
q AS (SELECT *, n0 + n1 + n2 AS n, (2 * n0 + n1) / nullif(CAST(2 * (n0 + n1 + n2) AS DOUBLE), 0) AS p FROM k)
SELECT okey, n0, n1, n2, round(coalesce((n0 - n * p * p) * (n0 - n * p * p) / nullif(n * p * p, 0), 0) + coalesce((n1 - 2 * n * p * (1 - p)) * (n1 - 2 * n * p * (1 - p)) / nullif(2 * n * p * (1 - p), 0), 0) + coalesce((n2 - n * (1 - p) * (1 - p)) * (n2 - n * (1 - p) * (1 - p)) / nullif(n * (1 - p) * (1 - p), 0), 0), 6) AS chi2 FROM q""")
def hardy_weinberg(spark, sf_dir):
    rows = va.with_genotypes(v.variants(spark, sf_dir)).filter("gts IS NOT NULL AND size(alts) = 1")
    return sc.hardy_weinberg(rows).select("okey", "n0", "n1", "n2", F.round("chi2", 6).alias("chi2"))


@query()
def local_alignment(spark, sf_dir):
    """Every raw read against one reference (tests/test_operators.py aligns by hand)."""
    reads = v.raw_reads(spark, sf_dir)
    return reads.select("id", sc.smith_waterman("sequence", F.lit("ACGTTGCATGCATCGACCGGTTACGATCAGCTA")).alias("a")).select("id", "a.score", "a.start1", "a.end1", "a.start2", "a.end2")


_DOSES = f"""{_VCF}, k AS (SELECT okey, len(list_filter(gts, lambda g: list_sum(g) = 0 AND NOT list_contains(g, -1))) AS n0, len(list_filter(gts, lambda g: list_sum(g) = 1 AND NOT list_contains(g, -1))) AS n1, len(list_filter(gts, lambda g: list_sum(g) = 2 AND NOT list_contains(g, -1))) AS n2 FROM s WHERE gts IS NOT NULL AND len(alts) = 1)"""


def _posterior(seen: int, prior: list[str], wanted: list[int]) -> str:
    """Share of the wanted genotypes (alternate alleles times weight) given the one that was read."""
    post = [f"({p}) * {0.99 if g == seen else 0.005}" for g, p in enumerate(prior)]
    return f"({' + '.join(f'{w} * ({post[g]})' for g, w in enumerate(wanted))}) / ({' + '.join(post)})"


_HWE = ["(1 - f) * (1 - f)", "2 * f * (1 - f)", "f * f"]
_NEXT = " + ".join(f"n{k} * {_posterior(k, _HWE, [0, 1, 2])}" for k in range(3))
_EM = f"e AS (SELECT okey, n0, n1, n2, CASE WHEN n0 + n1 + n2 > 0 THEN list_reduce([0.5::DOUBLE] || list_transform(range(50), lambda i: 0::DOUBLE), lambda f, z: ({_NEXT}) / (2.0 * (n0 + n1 + n2))) END AS freq FROM k)"


@query(f"{_DOSES}, {_EM} SELECT okey, round(freq, 6) AS freq FROM e")
def allele_frequency_em(spark, sf_dir):
    rows = va.with_genotypes(v.variants(spark, sf_dir)).filter("gts IS NOT NULL AND size(alts) = 1")
    return sc.allele_frequency(rows).select("okey", F.round("freq", 6).alias("freq"))


_G = ["g.a", "g.b", "g.c"]
_FREE = ", ".join(f"'{c}': ({' + '.join(f'n{k} * {_posterior(k, _G, [int(i == w) for i in range(3)])}' for k in range(3))}) / (n0 + n1 + n2)" for w, c in enumerate("abc"))


def _likelihood(prior: list[str]) -> str:
    return " + ".join(f"n{k} * ln({' + '.join(f'({p}) * {0.99 if g == k else 0.005}' for g, p in enumerate(prior))})" for k in range(3))


@query(f"""{_DOSES}, {_EM}, w AS (SELECT *, freq AS f, list_reduce([{{'a': 1/3::DOUBLE, 'b': 1/3::DOUBLE, 'c': 1/3::DOUBLE}}] || list_transform(range(50), lambda i: {{'a': 0::DOUBLE, 'b': 0::DOUBLE, 'c': 0::DOUBLE}}), lambda g, z: {{{_FREE}}}) AS g FROM e WHERE freq IS NOT NULL)
SELECT okey, round(freq, 6) AS freq, round(g.a, 6) AS g0, round(g.b, 6) AS g1, round(g.c, 6) AS g2, round(greatest(2 * ({_likelihood(_G)} - ({_likelihood(_HWE)})), 0), 5) AS hwe_lrt FROM w""")
def genotype_frequencies_lrt(spark, sf_dir):
    rows = va.with_genotypes(v.variants(spark, sf_dir)).filter("gts IS NOT NULL AND size(alts) = 1")
    return sc.genotype_test(rows).filter("freq IS NOT NULL").select("okey", *[F.round(c, 6).alias(c) for c in ("freq", "g0", "g1", "g2")], F.round("hwe_lrt", 5).alias("hwe_lrt"))


_CONTIG_PIECES = "SELECT CAST(item_id AS STRING) AS chrom, CAST(0 AS BIGINT) AS start, translate(lower(text), 'etaoinshrdlucmfwypvbgkjqxz', 'ACGTACGTACGTACGTNCGTACGTAC') AS sequence FROM {benchmark}"
_SEED_LETTERS = 12


_DUCK_SEEDS = f"r0 AS (SELECT CAST(doc_id AS STRING) || '_' || CAST(k AS STRING) AS id, s[k + 1] AS sequence FROM (SELECT doc_id, s, unnest(range(len(s))) AS k FROM (SELECT doc_id, {v.cut(v._SEQUENCE, _SEED_LETTERS)} AS s FROM documents)))"
_DUCK_CONTIGS = f"c AS ({_CONTIG_PIECES.replace('{benchmark}', 'benchmark')})"
_BOTH_STRANDS = "r AS (SELECT id, sequence, 0 AS strand FROM r0 UNION ALL SELECT id, reverse(translate(sequence, 'ACGT', 'TGCA')), 1 FROM r0)"


def _seed_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All texts in short reads, and the benchmark's as contigs."""
    t = v.tables(spark, sf_dir, "benchmark", "documents")
    whole = t["documents"].selectExpr("doc_id", f"posexplode({v.cut(v._SEQUENCE, _SEED_LETTERS)}) AS (k, sequence)")
    return whole.selectExpr("CAST(doc_id AS STRING) || '_' || CAST(k AS STRING) AS id", "sequence"), spark.sql(_CONTIG_PIECES, benchmark=t["benchmark"])


@query(f"WITH {_DUCK_CONTIGS}, {_DUCK_SEEDS}, {_BOTH_STRANDS}, p AS (SELECT chrom, start, unnest(range(greatest(length(sequence) - {_SEED_LETTERS - 1}, 0))) AS p0, sequence FROM c), k AS (SELECT chrom, start + p0 AS pos, substr(sequence, p0 + 1, {_SEED_LETTERS}) AS w FROM p) SELECT DISTINCT id, chrom, CAST(pos AS BIGINT) AS pos, CAST(strand AS INT) AS strand FROM k JOIN r ON w = r.sequence")
def map_exact_reads(spark, sf_dir):
    reads, contigs = _seed_reads(spark, sf_dir)
    return rr.map_exact(reads, contigs, _SEED_LETTERS)


_KMERS = f"k AS (SELECT chrom, start + p0 AS pos, substr(sequence, p0 + 1, {_SEED_LETTERS}) AS w FROM (SELECT chrom, start, unnest(range(greatest(length(sequence) - {_SEED_LETTERS - 1}, 0))) AS p0, sequence FROM c))"
_HALF_SEED = _SEED_LETTERS // 2


def _differing(a: str, b: str) -> str:
    return f"len(list_filter(list_zip(string_split({a}, ''), string_split({b}, '')), lambda z: z[1] <> z[2]))"


@query(f"""WITH {_DUCK_CONTIGS}, {_DUCK_SEEDS}, {_BOTH_STRANDS}, {_KMERS}, m AS (SELECT id, chrom, pos, strand, sequence, w FROM k JOIN (SELECT * FROM r WHERE length(sequence) = {_SEED_LETTERS}) ON substr(w, 1, {_HALF_SEED}) = substr(sequence, 1, {_HALF_SEED})
UNION SELECT id, chrom, pos, strand, sequence, w FROM k JOIN (SELECT * FROM r WHERE length(sequence) = {_SEED_LETTERS}) ON substr(w, {_HALF_SEED + 1}) = substr(sequence, {_HALF_SEED + 1})),
h AS (SELECT id, chrom, CAST(pos AS BIGINT) AS pos, CAST(strand AS INT) AS strand, CAST({_differing('sequence', 'w')} AS INT) AS mismatches FROM m) SELECT * FROM h WHERE mismatches <= 1""")
def map_one_mismatch(spark, sf_dir):
    """Every place of every read with one differing letter at most."""
    reads, contigs = _seed_reads(spark, sf_dir)
    return rr.map_mismatches(reads, contigs, 1, _HALF_SEED)


@query(f"""WITH {_DUCK_CONTIGS}, {_DUCK_SEEDS}, {_KMERS} SELECT DISTINCT id, chrom, CAST(pos AS BIGINT) AS pos, CAST(0 AS INT) AS strand FROM k JOIN r0 ON translate(w, 'C', 'T') = translate(sequence, 'C', 'T') WHERE length(sequence) = {_SEED_LETTERS}
UNION SELECT DISTINCT id, chrom, CAST(pos AS BIGINT), CAST(1 AS INT) FROM k JOIN r0 ON translate(w, 'G', 'A') = translate(reverse(translate(sequence, 'ACGT', 'TGCA')), 'G', 'A') WHERE length(sequence) = {_SEED_LETTERS}""")
def map_bisulfite_reads(spark, sf_dir):
    """Places of reads whose unmethylated letters may have been converted."""
    reads, contigs = _seed_reads(spark, sf_dir)
    return rr.map_mismatches(reads, contigs, 0, _SEED_LETTERS, bisulfite=True).select("id", "chrom", "pos", "strand")


@query(f"""WITH {_DUCK_CONTIGS}, {_DUCK_SEEDS}, {_BOTH_STRANDS}, h AS (SELECT chrom, start + p0 AS at, start, sequence AS whole, substr(sequence, p0 + 1, {_HALF_SEED}) AS w FROM (SELECT chrom, start, sequence, unnest(range(greatest(length(sequence) - {_HALF_SEED - 1}, 0))) AS p0 FROM c)),
full_reads AS (SELECT * FROM r WHERE length(sequence) = {_SEED_LETTERS}),
m AS (SELECT id, chrom, start, whole, strand, sequence, h.at AS near FROM h JOIN full_reads ON w = substr(sequence, 1, {_HALF_SEED}) UNION ALL SELECT id, chrom, start, whole, strand, sequence, h.at - {_HALF_SEED} FROM h JOIN full_reads ON w = substr(sequence, {_HALF_SEED + 1})),
q AS (SELECT DISTINCT id, chrom, start, whole, strand, sequence, near + s AS pos FROM m, (VALUES (-1), (0), (1)) t(s) WHERE near + s >= start),
d AS (SELECT id, chrom, pos, strand, least({", ".join(f"levenshtein(sequence, substr(whole, CAST(pos - start + 1 AS BIGINT), {_SEED_LETTERS + x}))" for x in (-1, 0, 1))}) AS edits FROM q),
e AS (SELECT *, first_value(pos) OVER (PARTITION BY id, chrom, strand ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS one, min(edits * 10000000 + pos) OVER (PARTITION BY id, chrom, strand ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS best FROM d WHERE edits <= 1)
SELECT id, chrom, CAST(pos AS BIGINT) AS pos, CAST(strand AS INT) AS strand, CAST(edits AS INT) AS mismatches FROM e WHERE best = edits * 10000000 + pos""")
def map_one_edit(spark, sf_dir):
    """Every place of every read with one letter changed, inserted or deleted at most."""
    reads, contigs = _seed_reads(spark, sf_dir)
    whole = reads.filter(F.length("sequence") == _SEED_LETTERS)
    return rr.map_edits(whole, contigs, 1, _HALF_SEED).drop("cigar")


@query("""SELECT c_custkey, lower(c_name) AS lowered, len(list_filter(regexp_split_to_array(c_name, '[#0]'), lambda x: x <> '')) AS pieces, coalesce(regexp_matches(substr(c_name, 10), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$'), false) AS numeric_tail,
 substr(c_name, 1, 2) || substr(c_name, 4) AS without_third, c_mktsegment LIKE 'B%' AS starts_b, regexp_extract(c_name || ' x', '^([^ \t]*)', 1) AS first_word FROM customer""")
def string_functions(spark, sf_dir):
    name = F.col("c_name")
    rows = v.tables(spark, sf_dir, "customer")["customer"]
    return rows.select(
        "c_custkey",
        F.lower(name).alias("lowered"),
        F.size(text.tokens(name, "#0")).cast("long").alias("pieces"),
        text.is_numeric(F.substring(name, 10, 100)).alias("numeric_tail"),
        text.remove_at(name, 2).alias("without_third"),
        F.col("c_mktsegment").startswith("B").alias("starts_b"),
        text.to_first_blank(F.concat(name, F.lit(" x"))).alias("first_word"),
    )


@query("""WITH e AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, value FROM events) SELECT event_type, h, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM e GROUP BY event_type, h""")
def coverage_window(spark, sf_dir):
    from pyspark.sql import Window

    rows = v.tables(spark, sf_dir, "events")["events"]
    hours = rows.groupBy("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return hours.withColumn("running", F.sum("n").over(Window.partitionBy("event_type").orderBy("h").rowsBetween(-23, 0)))


@query(f"{_LIKELY} SELECT CAST(least(list_sort([pl0, pl1, pl2])[2], 255) AS INT) AS difference, count(*) AS sites FROM g GROUP BY 1")
def likelihood_differences(spark, sf_dir):
    return pl.difference_histogram(_likelihoods(spark, sf_dir))


@query(f"""{_with(v.DUCK_READS)}, good AS (SELECT * FROM v_reads WHERE flag & 1796 = 0 AND tid >= 0 AND mapq >= 5), {_OPS}, {_PILED}
SELECT tid, p0 AS pos, ds, count(*) AS depth FROM b WHERE op IN ('M', '=', 'X') AND ascii({_QUAL}) - 33 >= 20 GROUP BY tid, p0, ds""")
def depth_by_file(spark, sf_dir):
    return pl.depth_of_files(v.reads(spark, sf_dir), "ds", min_mapq=5, min_quality=20)


_FITS = [(f, m, a + b) for f in range(3) for m in range(3) for a in ((0,), (0, 1), (1,))[f] for b in ((0,), (0, 1), (1,))[m]]


_TRIO = ", ".join(f"max(pl{g}) FILTER (lib = {s}) AS {r}{g}" for s, r in enumerate("fmc") for g in range(3))


@query(f"""{_THIRDS}, t AS (SELECT tid, pos, {_TRIO} FROM g GROUP BY tid, pos HAVING count(DISTINCT lib) = 3)
SELECT tid, pos, least({', '.join(f'f{f} + m{m} + c{c}' for f, m, c in _FITS)}) AS difference, least(f0 + m0, f1 + m1, f2 + m2) AS same FROM t""")
def trio_differences(spark, sf_dir):
    """The samples as father, mother and child."""
    return pl.trio_differences(_likelihoods(spark, sf_dir, True), "lib", 0, 1, 2)


_GENOTYPES = [(i, j) for i in range(4) for j in range(i, 4)]
_TEN = ", ".join(f"CASE WHEN p{i} < 0 OR p{j} < 0 THEN 255 ELSE pl[CAST(greatest(p{i}, p{j}) * (greatest(p{i}, p{j}) + 1) // 2 + least(p{i}, p{j}) + 1 AS BIGINT)] END" for i, j in _GENOTYPES)
_PLACES = ", ".join(f"coalesce(nullif(list_position(al, '{b}'), 0), list_position(al, 'X'), 0) - 1 AS p{i}" for i, b in enumerate("ACGT"))


@query(f"""WITH d AS ({ORACLE_SQL["genotype_likelihoods_dependent"]}),
e AS (SELECT tid, pos, lib, string_split(alleles, ',') AS al, list_transform(string_split(pl, ','), lambda x: CAST(x AS INT)) AS pl FROM d), f AS (SELECT *, {_PLACES} FROM e)
SELECT tid, pos, lib, array_to_string([{_TEN}], ',') AS ten, array_to_string(al[1:2], ',') AS two, array_to_string(pl[1:3], ',') AS two_pl, CAST(list_sort(pl)[2] - list_sort(pl)[1] AS INT) AS apart,
 array_to_string(list_transform(pl, lambda x: least(255, greatest(0, CAST(trunc(x * 1.25::DOUBLE + 0.499::DOUBLE) AS INT)))), ',') AS scaled FROM f""")
def genotype_conversions(spark, sf_dir):
    """Likelihoods of the ten pairs of letters, of the first two alleles alone, and from logarithms."""
    reads, contigs = _with_contigs(spark, sf_dir)
    rows = ca.dependent_likelihoods(reads, contigs, "lib", min_mapq=10).withColumn("al", F.split("alleles", ","))
    two, two_pl = ge.fewer_alleles(F.col("al"), F.col("pl"), 2)
    text_of = lambda c: F.array_join(c.cast("array<string>"), ",")
    gl = F.transform("pl", lambda x: x * -0.125)
    return rows.select("tid", "pos", "lib", text_of(ge.ten_genotypes(F.col("al"), F.col("pl"))).alias("ten"), text_of(two).alias("two"), text_of(two_pl).alias("two_pl"), ge.best_apart(F.col("pl")).alias("apart"), text_of(ge.pl_of_gl(gl)).alias("scaled"))


_SECOND = "least(" + ", ".join(f"list_sort([{r}0, {r}1, {r}2])[2] - list_sort([{r}0, {r}1, {r}2])[1]" for r in "ab") + ")"


@query(f"""{_THIRDS}, t AS (SELECT tid, pos, {", ".join(f"max(pl{g}) FILTER (lib = {s}) AS {r}{g}" for s, r in enumerate("ab") for g in range(3))} FROM g WHERE lib < 2 GROUP BY tid, pos HAVING count(DISTINCT lib) = 2)
SELECT tid, pos, CAST(CASE WHEN a0 = 0 AND b0 = 0 THEN 0 ELSE least(a0 + b0, a1 + b1, a2 + b2) - least(a0, a1, a2) - least(b0, b1, b2) END AS INT) AS difference, CAST({_SECOND} AS INT) AS apart FROM t""")
def pair_differences(spark, sf_dir):
    """Two samples: how much less likely it is that they share a genotype."""
    return ge.pair_differences(_likelihoods(spark, sf_dir, True), "lib", 0, 1)


@query()
def site_biases(spark, sf_dir):
    """Strand, quality and end biases of every site (tests/test_genotypes.py integrates the t distribution)."""
    reads, contigs = _with_contigs(spark, sf_dir)
    out = ge.site_biases(ca.site_annotations(reads, contigs, "lib", min_mapq=10))
    return out.select("tid", "pos", "mapq", *[F.round(c, 6).alias(c) for c in ("p_strand", "p_base", "p_mapq", "p_edge")])


_SHARES = ", ".join("avg(phi[{0}] * z[{0}] / list_dot_product(phi, z))".format(k) for k in range(1, 8))
_SPECTRUM = f"""{_THIRDS}, w AS (SELECT tid, pos, {", ".join(f"[{', '.join(f'pow(10::DOUBLE, -coalesce(max(pl{g}) FILTER (lib = {s}), 0) / 10)' for g in range(3))}]" + f" AS l{s}" for s in range(3))} FROM g GROUP BY tid, pos),
y AS (SELECT tid, pos, list_reduce([[1]::DOUBLE[], l0, l1, l2], lambda z, l: list_transform(range(0, len(z) + 2), lambda j: coalesce(z[j + 1], 0) * l[1] + 2 * CASE WHEN j >= 1 THEN coalesce(z[j], 0) ELSE 0 END * l[2] + CASE WHEN j >= 2 THEN coalesce(z[j - 1], 0) ELSE 0 END * l[3])) AS y FROM w),
zs AS (SELECT tid, pos, list_transform(y, lambda v, i: v / [1, 6, 15, 20, 15, 6, 1][i]) AS z FROM y),
f0 AS (SELECT [1 - 0.001::DOUBLE * 2.45::DOUBLE, {", ".join(f"0.001::DOUBLE / {k}" for k in range(1, 7))}] AS phi),
{", ".join(f"f{r + 1} AS MATERIALIZED (SELECT [{_SHARES}] AS phi FROM zs, f{r})" for r in range(3))}"""


@query(f"{_SPECTRUM} SELECT CAST(k AS INT) AS alleles, round(phi[k + 1], 6) AS share FROM f3, range(7) t(k)")
def afs_spectrum(spark, sf_dir):
    """Shares of sites by alternate alleles after three rounds over all sites."""
    return sp.afs_spectrum(_likelihoods(spark, sf_dir, True), "lib", [0, 1, 2]).withColumn("share", F.round("share", 6))


@query(f"""{_SPECTRUM}, p AS (SELECT tid, pos, z, list_transform(z, lambda x, i: x * phi[i] / list_dot_product(phi, z)) AS p, list_transform(z, lambda x, i: x * (phi[i] + phi[8 - i]) / 2) AS q FROM zs, f3)
SELECT tid, pos, CAST(list_position(z, list_max(z)) - 1 AS INT) AS alleles, round(1 - p[1], 6) AS variant, round(1 - (q[1] + q[7]) / list_sum(q), 6) AS folded, round(list_dot_product(p, [0, 1, 2, 3, 4, 5, 6]::DOUBLE[]) / 6, 6) AS frequency,
 len(list_filter(range(1, 8), lambda i: list_sum(p[1:i]) <= 0.025)) / 6 AS low, 1 - len(list_filter(range(1, 8), lambda i: list_sum(p[i:7]) <= 0.025)) / 6 AS high FROM p""")
def spectrum_calls(spark, sf_dir):
    """Every site's alternate alleles under the spectrum of all sites."""
    out = sp.spectrum_calls(_likelihoods(spark, sf_dir, True), "lib", [0, 1, 2])
    return out.select("tid", "pos", "alleles", *[F.round(c, 6).alias(c) for c in ("variant", "folded", "frequency")], "low", "high")


@query()
def afs_contrast(spark, sf_dir):
    """Two groups of samples compared at every variant, with permutations (tests/test_spectrum.py has the sums by hand)."""
    reads, contigs = _with_contigs(spark, sf_dir)
    third = F.concat(F.lit("s"), (F.col("read_id") % 3).cast("string"))
    counts = kept(pl.letter_counts(reads.withColumn("third", third), contigs, ("ds", "third"), min_mapq=10))  # one pileup for both ways to name samples
    mixed = pl.likelihoods_of(counts, "ds").unionByName(pl.likelihoods_of(counts, "third").withColumnRenamed("third", "ds"))
    out = sp.afs_contrast(mixed, "ds", ["s0", "s1"], ["s2", "mc", "hmc"], permutations=9)
    return out.select("tid", "pos", *[F.round(c, 6).alias(c) for c in ("p_contrast", "equal", "lower", "higher", "p_ratio")], "as_uneven")


_GROWN = "list_transform(range(0, len(z) + 2), lambda j: coalesce(z[j + 1], 0) * l[1] + 2 * CASE WHEN j >= 1 THEN coalesce(z[j], 0) ELSE 0 END * l[2] + CASE WHEN j >= 2 THEN coalesce(z[j - 1], 0) ELSE 0 END * l[3])"


@query(f"""{_THIRDS}, a1 AS (SELECT tid, pos, list([pow(10.0, -pl0 / 10.0), pow(10.0, -pl1 / 10.0), pow(10.0, -pl2 / 10.0)]::DOUBLE[] ORDER BY lib) AS ls FROM g GROUP BY tid, pos),
a2 AS (SELECT tid, pos, len(ls) AS m, list_reduce([[1.0]::DOUBLE[]] || ls, lambda z, l: {_GROWN}) AS z, [[1, 2, 1], [1, 4, 6, 4, 1], [1, 6, 15, 20, 15, 6, 1]][len(ls)] AS ways, [1.5, 25 / 12.0, 2.45][len(ls)] AS harmonic FROM a1),
a3 AS (SELECT tid, pos, m, list_transform(range(len(z)), lambda j: z[j + 1] / ways[j + 1] * CASE WHEN j = 0 THEN 1 - 0.001 * harmonic ELSE 0.001 / j END) AS p FROM a2)
SELECT tid, pos, CAST(m AS INT) AS samples, CAST(list_position(p, list_max(p)) - 1 AS INT) AS alleles, round(1 - p[1] / list_sum(p), 6) AS variant FROM a3""")
def allele_count_posteriors(spark, sf_dir):
    return pl.allele_counts(_likelihoods(spark, sf_dir, True), "lib")


# ---- reference

@query(f"""{_with(v.DUCK_READS, v.DUCK_CONTIGS)}, good AS (SELECT * FROM v_reads WHERE flag & 4 = 0 AND tid >= 0), {_OPS}, ref AS ({_CONTIG_TEXT.replace('{contigs}', 'v_contigs')}),
b AS (SELECT read_id, tid, CAST(pos + ref_at + i AS BIGINT) AS p0, op, substr(seq, CAST(read_at + i + 1 AS BIGINT), 1) AS base FROM (SELECT *, unnest(range(size)) AS i FROM placed WHERE op IN ('M', '=', 'X', 'D')))
SELECT g.read_id, CAST(coalesce(m.bad, 0) + coalesce(list_sum(list_transform(regexp_extract_all(g.cigar, '(\\d+)I', 1), lambda x: CAST(x AS INT))), 0) AS INT) AS nm FROM good g LEFT JOIN
(SELECT b.read_id, count(*) FILTER (op = 'D' OR base <> substr(r.sequence, p0 + 1, 1) OR base = 'N') AS bad FROM b JOIN ref r ON r.tid = b.tid GROUP BY b.read_id) m ON m.read_id = g.read_id""")
def edit_distances(spark, sf_dir):
    reads = v.reads(spark, sf_dir)
    contigs = spark.sql(_CONTIG_TEXT, contigs=v.contigs(spark, sf_dir))
    return rf.mismatch_tags(reads, contigs, 512, 128).select("read_id", "nm")


@query(f"{_with(v.DUCK_READS)}, good AS (SELECT * FROM v_reads), {_OPS} SELECT r.read_id FROM v_reads r JOIN span USING (read_id) WHERE tid = 3 AND pos < 900 AND pos + reach > 500")
def region_fetch(spark, sf_dir):
    return rf.fetch(v.reads(spark, sf_dir), 3, 500, 900).select("read_id")


@query(f"{_with(v.DUCK_READS)}, g AS (SELECT * FROM (VALUES (0, 'blood'), (1, 'liver')) t(grp, sample)) SELECT coalesce(sample, CAST(lib AS STRING)) AS sample, count(*) AS reads, CAST(sum(mapq) AS BIGINT) AS sum_mapq FROM v_reads LEFT JOIN g ON lib = grp GROUP BY 1")
def reads_by_sample(spark, sf_dir):
    groups = spark.sql("SELECT * FROM VALUES (0, 'blood'), (1, 'liver') AS t(`group`, sample)")
    return rf.with_sample(v.reads(spark, sf_dir), groups).groupBy("sample").agg(F.count(F.lit(1)).alias("reads"), F.sum("mapq").alias("sum_mapq"))


# ---- reports


def _unpivoted(sql: str, columns: str) -> str:
    """A row as name and value."""
    return f"WITH one AS (SELECT {columns} FROM ({sql})), two AS (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM one) SELECT name, value FROM (UNPIVOT two ON COLUMNS(*) INTO NAME name VALUE value)"


@query(_unpivoted(ORACLE_SQL["bam_stats_global"], "* EXCLUDE (single_end), round(sum_isize / reads, 6) AS mean_isize, round((n_g + n_c) * 100 / (n_a + n_c + n_g + n_t), 6) AS gc_percent"))
def alignment_report(spark, sf_dir):
    """Every row of the report."""
    return rp.alignment_report(v.reads(spark, sf_dir))


@query(_unpivoted(ORACLE_SQL["vcf_file_stats"], "*, round(transitions / nullif(transversions, 0), 6) AS ti_tv"))
def variant_report(spark, sf_dir):
    """Every row of the report."""
    return rp.variant_report(v.variants(spark, sf_dir))


@query(f"{_VCF} SELECT okey FROM s WHERE length(ref) = length(alt) AND regexp_matches(ref, '^[ACGT]+$') AND regexp_matches(alt, '^[ACGT,]+$') AND coalesce(len(gts) - len(list_filter(gts, lambda g: list_contains(g, -1))) >= 0.9 * len(gts), false)")
def view_sites(spark, sf_dir):
    return rp.view_sites(v.variants(spark, sf_dir), indels=False, plain_letters=True, variants_only=True, min_present=0.9).select("okey")


@query(f"{_with(v.DUCK_READS)}, g AS (SELECT tid, count(*) FILTER (flag & 16 = 0) AS n1, count(*) FILTER (flag & 16 > 0) AS n2, avg(mapq) FILTER (flag & 16 = 0) AS m1, avg(mapq) FILTER (flag & 16 > 0) AS m2, var_samp(mapq) FILTER (flag & 16 = 0) AS v1, var_samp(mapq) FILTER (flag & 16 > 0) AS v2 FROM v_reads GROUP BY tid) SELECT tid, n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t FROM g")
def quality_bias(spark, sf_dir):
    out = rp.two_samples(v.reads(spark, sf_dir), ["tid"], "mapq", dna.has(F.col("flag"), dna.REVERSE))
    return out.select("tid", "n1", "n2", *[F.round(c, 6).alias(c) for c in ("mean1", "mean2", "t")])
