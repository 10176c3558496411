from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cytoplan.functions import dna
from cytoplan.functions.text import info_map
from cytoplan.operators import alignments as al
from cytoplan.operators import meth_map as mm
from cytoplan.operators import raw_reads as rr
from cytoplan.operators import reference as rf
from cytoplan.operators import regions as rg
from cytoplan.operators import scoring as sc
from cytoplan.operators import variants as va
from cytoplan.operators.ordering import numbered
from cytoplan.streaming.sites import streaming_chunks, streaming_sites

VCF = "chrom string, pos long, id string, ref string, alt string, qual double, filter string, info string, format string, samples array<string>"


def variant(spark, ref, alt, fmt, *samples):
    return spark.createDataFrame([("1", 1, ".", ref, alt, -1.0, ".", ".", fmt, list(samples))], VCF)


def test_allele_counts(spark):
    row = va.with_statistics(variant(spark, "G", "T", "GC:GT", "1:0/0", "2:1/0", "3:0/1", "4:0/0", "5:1/1", "6:./1")).first()
    assert (row.allele_counts, row.genotype_counts, row.missing_alleles, row.missing_genotypes) == ([6, 5], [2, 1, 1, 1], 1, 1)
    row = va.with_statistics(variant(spark, "G", ".", "GT", "0/0", "0/0", "0/0", "0/0", "./.", "./.")).first()
    assert (row.allele_counts[0], row.missing_alleles, row.missing_genotypes) == (8, 4, 2)


def test_filter_order(spark):
    rows = variant(spark, "G", "T", "GT", "0/1")
    got = va.filter_chain(rows, [va.quality_filter(10), va.snp_filter()]).first()
    assert not got.passed and got["filter"] == "q10"  # the larger priority is asked first
    assert [r.id for r in va.filter_headers(spark, [va.snp_filter(), va.quality_filter(10)]).collect()] == ["q10", "snp"]


@pytest.mark.parametrize(
    ("chrom", "child", "father", "mother", "male", "bad"),
    [("1", "0/1", "0/0", "1/1", True, False), ("1", "0/0", "0/0", "1/1", True, True), ("X", "1/1", "0/0", "1/1", True, False), ("X", "0/0", "0/0", "1/1", True, True), ("chrX", "0/1", "0/0", "1/1", False, False), ("Y", "1/1", "0/0", "0/0", True, None), ("1", "./1", "0/0", "1/1", True, None)],
)
def test_mendel(spark, chrom, child, father, mother, male, bad):
    gts = [[-1 if a == "." else int(a) for a in g.split("/")] for g in (child, father, mother)]
    rows = spark.createDataFrame([(chrom, *gts)], "k string, c array<int>, f array<int>, m array<int>")
    assert rows.select(va.mendel_error(F.col("k"), F.col("c"), F.col("f"), F.col("m"), F.lit(male)).alias("x")).first().x is bad


def test_family_errors(spark):
    rows = [("f", "1", None, None, 1), ("f", "2", None, None, 2), ("f", "3", "1", "2", 1), ("f", "4", "2", "9", 1), ("f", "3", "1", "2", 1)]
    got = {(r.individual, r.error) for r in va.family_errors(spark.createDataFrame(rows, "family string, individual string, father string, mother string, sex int")).collect()}
    assert got == {("3", "duplicate"), ("4", "father of wrong sex"), ("4", "unknown mother")}


def local_by_hand(a, b, match, mismatch, gap_open, gap_extend):
    none = -1e18
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e, f = ([[none] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(2))
    best = 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i][j - 1] - gap_open, e[i][j - 1] - gap_extend)
            f[i][j] = max(h[i - 1][j] - gap_open, f[i - 1][j] - gap_extend)
            h[i][j] = max(0.0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_local_alignment(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("ACGT", k=rng.randrange(1, 40))), "".join(rng.choices("ACGT", k=rng.randrange(1, 40)))) for _ in range(40)]
    pairs += [("ACGTACGTTT", "ACGTACGTTT"), ("AAAACCCCGGGG", "AAAAGGGG"), ("", "AC")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sc.smith_waterman("a", "b", gap_open=6, gap_extend=1).alias("r")).collect()
    for r in got:
        assert r.r.score == pytest.approx(local_by_hand(r.a, r.b, 5, -4, 6, 1))
        if r.r.score:
            assert r.a[r.r.start1] == r.b[r.r.start2] and r.a[r.r.end1 - 1] == r.b[r.r.end2 - 1]


def test_conversion(spark):
    rows = spark.createDataFrame([("a", "CCTG"), ("b", "")], "id string, sequence string")
    got = {r.id: (r.sequence, r.converted, r.total) for r in rr.converted(rows).collect()}
    assert got == {"a": ("TTTG", 2, 3), "b": ("", 0, 0)}


def test_mapping_by_hand(spark):
    rng = random.Random(8)
    contigs = [("c1", 0, "".join(rng.choices("ACGT", k=9000))), ("c2", 5, "".join(rng.choices("AC", k=300)))]
    turn = str.maketrans("ACGT", "TGCA")
    reads = []
    for i in range(60):
        _, _, text = contigs[i % 2]
        at = 4080 + i % 20 if i % 2 == 0 else rng.randrange(len(text) - 24)  # some across the border of two pieces
        seq = list(text[at : at + 24])
        for _ in range(i % 3):
            seq[rng.randrange(24)] = rng.choice("ACGT")
        seq = "".join(seq)
        reads.append((str(i), seq if i % 4 < 2 else seq[::-1].translate(turn)))
    frame_of = lambda rows: spark.createDataFrame(rows, "id string, sequence string")
    pieces = spark.createDataFrame(contigs, "chrom string, start long, sequence string")
    for errors in (0, 1, 2):
        want = set()
        for name, seq in reads:
            for strand, text in ((0, seq), (1, seq[::-1].translate(turn))):
                for chrom, start, whole in contigs:
                    for at in range(len(whole) - 23):
                        n = sum(x != y for x, y in zip(text, whole[at : at + 24], strict=True))
                        if n <= errors:
                            want.add((name, chrom, start + at, strand, n))
        got = {tuple(r) for r in rr.map_mismatches(frame_of(reads), pieces, errors, 6).select("id", "chrom", "pos", "strand", "mismatches").collect()}
        assert got == want and want
    hits = rr.hit_tags(rr.map_mismatches(frame_of(reads), pieces, 1, 6)).collect()
    assert all(r.nh == sum(x.id == r.id for x in hits) and r.nm == r.mismatches and r["as"] == 254 for r in hits)
    near = rr.candidate_locations(frame_of(reads[:2]), pieces, k=12, step=4, gap=5).collect()
    assert any(r.id == "0" and r.chrom == "c1" and r.seeds >= 4 for r in near)


def test_natural_key_of_long_numbers(spark):
    names = ["r9", "r10", "r010", "s1", "r" + "9" * 30, "r1" + "0" * 30, "r10x2", "r10x10"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(dna.natural_key(F.col("n")), "n").collect()
    assert [r.n for r in rows] == ["r9", "r010", "r10", "r10x2", "r10x10", "r" + "9" * 30, "r1" + "0" * 30, "s1"]


def test_info_of_repeated_keys(spark):
    row = spark.createDataFrame([("DP=1;H2;DP=30;A=2",)], "info string").select(info_map(F.col("info")).alias("m")).first()
    assert row.m == {"DP": "30", "A": "2", "H2": ""}


def test_overlaps_of_equal_and_long_rows(spark):
    rng = random.Random(5)
    rows = [(i // 2, 1, s, s + rng.choice([0, 5, 40, 90])) for i in range(200) for s in (rng.randrange(400),)]
    rows += rows[:20]
    beds = [(1, s, s + rng.choice([0, 1, 3, 120])) for s in rng.sample(range(2000), 12)]
    got = rg.overlapping(spark.createDataFrame(rows, "id int, chrom int, a long, b long"), spark.createDataFrame(beds, "chrom int, start long, end long"), "chrom", "a", "b", 16).collect()
    want = [r for r in rows if any(s < e and e > r[2] and s < r[3] for _, s, e in beds)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_islands_over_spans(spark):
    rng = random.Random(6)
    rows = [(g, s, s + rng.choice([1, 10, 300])) for g in range(2) for s in rng.sample(range(5000), 120)]
    want = []
    for g in range(2):
        held = None
        for _, s, e in sorted(r for r in rows if r[0] == g):
            if held and s - held[2] <= 7:
                held = (g, held[1], max(held[2], e), held[3] + 1)
            else:
                want += [held] if held else []
                held = (g, s, e, 1)
        want.append(held)
    got = rg.merge_close(spark.createDataFrame(rows, "g int, start long, end long"), ["g"], "start", "end", 7, 64).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_region_tables(spark):
    regions = spark.createDataFrame([("1", 5, 9), ("2", 1, 3)], "chrom string, start long, end long")
    more = spark.createDataFrame([("1", 5, 9), ("3", 4, 6), ("Z", 1, 2)], "chrom string, start long, end long")
    contigs = spark.createDataFrame([("1",), ("2",), ("3",)], "chrom string")
    held = rg.insert_regions(regions, more, contigs)
    assert sorted(map(tuple, held.collect())) == [("1", 5, 9), ("2", 1, 3), ("3", 4, 6)]
    assert sorted(map(tuple, rg.remove_regions(held, more).collect())) == [("2", 1, 3)]
    assert {r.chrom: r.regions for r in rg.count_regions(held).collect()} == {"1": 1, "2": 1, "3": 1}
    order = spark.createDataFrame([("3", 0), ("1", 1)], "chrom string, ordinal int")
    assert [r.chrom for r in rg.ordered_regions(held, order).collect()] == ["3", "1", "2"]
    few, many = spark.createDataFrame([(1,), (1,), (4,)], "k int"), spark.createDataFrame([(1,), (2,), (1,), (3,)], "k int")
    assert [r.k for r in rg.intersect_smaller(many, few, ["k"]).collect()] == [1, 1]
    rows = spark.createDataFrame([("a", 3), ("b", 2), ("a", 1)], "k string, at int")
    assert sorted(map(tuple, rg.unique_first(rows, ["k"], "at").collect())) == [("a", 1), ("b", 2)]


def test_fisher_of_large_tables(spark):
    rows = [(8, 2, 1, 5), (0, 0, 0, 0), (3_000_000, 2_999_000, 3_000_500, 3_001_000), (10, 0, 0, 10)]
    got = [r.p for r in spark.createDataFrame(rows, "a long, b long, c long, d long").select(sc.fisher_exact("a", "b", "c", "d").alias("p")).collect()]
    assert got[0] == pytest.approx(0.0349650349) and got[1] == 1 and got[3] == pytest.approx(2 / 184756)
    assert 0 < got[2] < 1


def test_long_reads_against_the_reference(spark):
    """Reads longer than a piece of the contig."""
    rng = random.Random(4)
    text = "".join(rng.choices("ACGT", k=700))
    seq = list(text[100:500])
    seq[50], seq[350] = ("A" if seq[k] != "A" else "C" for k in (50, 350))
    reads = spark.createDataFrame([(1, 0, 100, 0, "400M", "".join(seq)), (2, 0, 40, 0, "20M300N20M", text[40:60] + text[360:380])], "read_id int, tid int, pos int, flag int, cigar string, seq string")
    contigs = spark.createDataFrame([(0, text)], "tid int, sequence string")
    got = {r.read_id: (r.nm, r.md) for r in rf.mismatch_tags(reads, contigs, 64, 16).collect()}
    assert got == {1: (2, f"50{text[150]}299{text[450]}49"), 2: (0, "40")}


def test_numbering_over_spans(spark):
    rows = [(g, v) for g in range(2) for v in random.Random(g).sample(range(1_000_000), 300)]
    got = numbered(spark.createDataFrame(rows, "g int, v long"), ["g"], "v", "n", 1000).collect()
    for g in range(2):
        assert [r.v for r in sorted((r for r in got if r.g == g), key=lambda r: r.n)] == sorted(v for h, v in rows if h == g)


READS = "ds string, tid int, pos int, flag int, mapq int, cigar string, seq string, xm string, n_tags int"


def random_reads(n, seed):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        ops, left = [], rng.randrange(6, 15)
        length = left
        while left:
            k, op = rng.randrange(1, left + 1), rng.choice("MMM=XISD")
            ops.append(f"{k}{op}")
            left -= 0 if op == "D" else k
        rows.append((rng.choice(["mc", "hmc"]), rng.randrange(2), rng.randrange(12), 16 * rng.randrange(2), rng.choice([10, 40]), "".join(ops), "".join(rng.choices("ACGT", k=length)), "".join(rng.choices("..zZxXhH", k=length)), 7))
    return rows


def counts_by_hand(rows):
    import re

    sites, seen = set(), []
    for ds, tid, pos, flag, mapq, cigar, seq, xm, _ in rows:
        if mapq < 20:
            continue
        strand, r, q, n = int(flag & 16 > 0), 0, 0, len(seq)
        for k, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
            for _ in range(int(k)):
                if op in "M=X":
                    seen.append((ds, tid, strand, pos + r, r, n, seq[q], xm[q]))
                    if xm[q] != "." and r < n:
                        sites.add((tid, strand, pos + r))
                elif op in "DN":
                    seen.append((ds, tid, strand, pos + r, r, n, "D", "."))
                r += op in "MDN=X"
                q += op in "MIS=X"
        seen += [(ds, tid, strand, pos + x, x, n, "R", ".") for x in range(r, n)]
    out = {s: [0] * 6 for s in sites}
    for ds, tid, strand, p, off, n, base, call in seen:
        if (tid, strand, p) in sites and off <= n - 2:
            k = 0 if call not in ".ZXHMU" else 2 if call != "." else 1 if base != ("C", "G")[strand] else None
            if k is not None:
                out[tid, strand, p][k + 3 * (ds == "hmc")] += 1
    return out


def test_maps_by_hand(spark):
    rows = random_reads(300, 1)
    sites = mm.site_counts(mm.filter_reads(spark.createDataFrame(rows, READS)))
    want = counts_by_hand(rows)
    assert {(r.chr, r.strand, r.pos): [r[c] for c in mm.COUNTERS] for r in sites.collect()} == want
    mixed = {(r.chr, r.pos): [r[c] for c in mm.COUNTERS] for r in mm.mixed_map(sites, 5).collect()}
    sums = {}
    for (tid, _, p), c in want.items():
        sums[tid, p] = [a + b for a, b in zip(sums.get((tid, p), [0] * 6), c, strict=True)]
    assert mixed == {k: c for k, c in sums.items() if c[0] + c[2] >= 5 or c[3] + c[5] >= 5}


def test_streaming_equals_batch(spark, tmp_path):
    rows = random_reads(200, 2)
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], READS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = streaming_sites(stream).writeStream.outputMode("complete").format("memory").queryName("sites").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.chr, r.strand, r.pos): [r[c] for c in mm.COUNTERS] for r in spark.sql("SELECT * FROM sites").collect()}
    assert got == counts_by_hand(rows)


def test_streaming_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{k}:00", k % 2, 10 * k) for k in range(9)]
    spark.createDataFrame(rows, "at string, tid int, mapq int").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema("at timestamp, tid int, mapq int").parquet(str(tmp_path / "in" / "*"))
    q = streaming_chunks(stream, "at", "1 minute", "5 minutes").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.tid, r.reads, r.sum_mapq) for r in spark.sql("SELECT * FROM windows").collect()}
    assert got == {(0, 3, 60), (1, 2, 40)}


def md_by_hand(ref, pos, cigar, seq):
    import re

    md, run, nm, q, r, gap = "", 0, 0, 0, pos, False
    for k, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        for i in range(int(k)):
            if op in "M=X":
                if seq[q] == ref[r]:
                    run += 1
                else:
                    md, run, nm = md + f"{run}{ref[r]}", 0, nm + 1
                gap = False
            elif op == "D":
                md, run, nm, gap = (md + ref[r], 0, nm + 1, True) if gap else (md + f"{run}^{ref[r]}", 0, nm + 1, True)
            elif op == "I":
                nm += 1
            q += op in "MIS=X"
            r += op in "MDN=X"
    return nm, md + str(run)


def test_mismatch_tags(spark):
    rng = random.Random(4)
    ref = "".join(rng.choices("ACGT", k=300))
    rows = []
    for i in range(60):
        cigar = rng.choice(["20M", "5S10M2D8M", "6M3I9M", "4M1D1M1D10M", "8=1X8="])
        import re

        need = sum(int(k) for k, o in re.findall(r"(\d+)(.)", cigar) if o in "MIS=X")
        pos = rng.randrange(0, 250)
        seq = "".join(c if rng.random() < 0.8 else rng.choice("ACGT") for c in (ref[pos : pos + need] + "A" * need)[:need])
        rows.append((i, 0, pos, 0, cigar, seq))
    from cytoplan.operators.reference import mismatch_tags

    reads = spark.createDataFrame(rows, "read_id int, tid int, pos int, flag int, cigar string, seq string")
    got = {r.read_id: (r.nm, r.md) for r in mismatch_tags(reads, spark.createDataFrame([(0, ref)], "tid int, sequence string"), 64, 40).collect()}
    assert got == {i: md_by_hand(ref, pos, cigar, seq) for i, _, pos, _, cigar, seq in rows}


def test_mendel_errors_of_very_many_trios(spark):
    variants = spark.createDataFrame([("1", "A", "GT", ["0/0", "0/0", "1/1"])], "chrom string, alt string, format string, samples array<string>")
    pedigree = spark.range(2, 100_004).selectExpr("CAST(id AS INT) AS sample", "0 AS father", "1 AS mother", "1 AS sex")
    got = va.mendel_errors(variants, pedigree)
    assert got.count() == 100_002 and [tuple(r) for r in got.filter("mendel_errors > 0").collect()] == [(2, 1)]


def test_reads_longer_than_a_piece_are_mapped(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("ACGT") for _ in range(30_000))
    wrong = text[6_000:16_000][:7_000] + ("A" if text[13_000] != "A" else "C") + text[13_001:16_000]
    reads = spark.createDataFrame([("long", text[5_000:15_000]), ("wrong", wrong), ("back", text[100:9_100].translate(str.maketrans("ACGT", "TGCA"))[::-1]), ("over", text[25_000:] + "ACGTACGTAC")], "id string, sequence string")
    contigs = spark.createDataFrame([("c", 40, text)], "chrom string, start long, sequence string")
    exact = sorted(tuple(r) for r in rr.map_exact(reads, contigs).collect())
    assert exact == [("back", "c", 140, 1), ("long", "c", 5_040, 0)]
    near = sorted(tuple(r) for r in rr.map_mismatches(reads, contigs, 1).collect())
    assert near == [("back", "c", 140, 1, 0), ("long", "c", 5_040, 0, 0), ("wrong", "c", 6_040, 0, 1)]


def test_ranks_of_alike_names_and_unmapped_reads(spark):
    """Ranges hold about as many rows, however alike names are; the ranks are those of a sort."""
    rows = spark.range(60_000).select(F.col("id").alias("read_id"), F.concat(F.lit("HWI-ST1234:56:C0A:1:1101:"), (F.pmod(F.xxhash64("id"), F.lit(25_000))).cast("string")).alias("qname"), F.lit(64).alias("flag"), F.lit(-1).alias("tid"), F.lit(-1).alias("pos"))
    got = {r.read_id: r["rank"] for r in al.name_ranks(rows).select("read_id", "rank").collect()}
    held = [(int(r.qname.rsplit(":", 1)[1]), r.read_id) for r in rows.collect()]
    assert [i for _, i in sorted(held)] == sorted(got, key=got.get) and sorted(got.values()) == list(range(60_000))
    places = {r.read_id: r["rank"] for r in al.coordinate_ranks(rows).select("read_id", "rank").collect()}
    assert places == {i: i for i in range(60_000)}
    spread = rows.repartitionByRange(8, "tid", "pos", "read_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) < 2 * 60_000 / 8


def test_islands_over_spans_without_a_window_over_all(spark):
    rows = [(0, 10 * i, 10 * i + 9) for i in range(3000)] + [(0, 40_000 + 50 * i, 40_010 + 50 * i) for i in range(500)] + [(1, 5, 100_000)] + [(1, 7 * i, 7 * i + 1) for i in range(900)]
    got = rg.merge_close(spark.createDataFrame(rows, "g int, start long, end long"), ["g"], "start", "end", 5, 64)
    found = sorted(tuple(r) for r in got.collect())
    want, seen = [], None
    for g, a, b in sorted(rows):
        if seen and seen[0] == g and a - seen[2] <= 5:
            seen[2], seen[3] = max(seen[2], b), seen[3] + 1
        else:
            seen = [g, a, b, 1]
            want.append(seen)
    assert found == sorted(map(tuple, want))


def test_statistics_are_stored_by_chromosome(spark, tmp_path):
    from cytoplan.operators import reports as rp
    from cytoplan.plans import views

    reads = views.reads(spark, "/root/testdata/sf0.001")
    rp.store_statistics(reads, str(tmp_path), 500)
    stored = spark.read.parquet(f"{tmp_path}/global_stats")
    assert sorted(map(str, stored.collect())) == sorted(map(str, rp.alignment_report(reads).collect()))
    chunks = spark.read.parquet(f"{tmp_path}/chunk")
    want = {(r.chromosome, r.chunk_id): r.features_count for r in al.chunks(reads, 500).collect()}
    assert {(r.chromosome, r.chunk_id): r.features_count for r in chunks.collect()} == want
