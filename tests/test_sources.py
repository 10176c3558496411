from __future__ import annotations

import gzip
import json
import random
import struct
import zlib

import pytest

from cytoplan.operators import regions as rg
from cytoplan.operators.meth_map import filter_reads, site_counts
from cytoplan.sinks import text_formats as out
from cytoplan.sources import text_formats as tf
from cytoplan.sources.bam import SCHEMA, BamSource, contigs_of
from cytoplan.sources.fastq import FastqSource, at_positions, with_ordinals

SAM = "\n".join(
    [
        "@HD\tVN:1.6",
        "@SQ\tSN:chr1\tLN:1000",
        "@SQ\tSN:chr2\tLN:500",
        "r1\t0\tchr1\t11\t60\t4M2D4M\t*\t0\t0\tACGTACGT\tIIIIIIII\tNM:i:1\tXM:Z:z..Z.x.h",
        "r2\t16\tchr2\t1\t30\t2S6M\t=\t1\t0\tNNACGTAC\tABCDEFGH\tXM:Z:..Z...h.",
        "r3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII",
    ]
)


def write(path, text):
    path.write_text(text)
    return str(path)


def test_sam(spark, tmp_path):
    path = write(tmp_path / "a.sam", SAM + "\n")
    rows = tf.read_sam(spark, path).orderBy("qname").collect()
    assert [(r.qname, r.flag, r.pos, r.n_tags) for r in rows] == [("r1", 0, 10, 2), ("r2", 16, 0, 1), ("r3", 4, -1, 0)]
    assert rows[0].tags == {"NM": "1", "XM": "z..Z.x.h"}
    assert {(r.name, r.length, r.tid) for r in tf.sam_contigs(spark, path).collect()} == {("chr1", 1000, 0), ("chr2", 500, 1)}
    lines = [r.value for r in out.sam_lines(tf.read_sam(spark, path)).collect()]
    assert sorted(lines) == sorted(x for x in SAM.split("\n") if x[0] != "@")


def test_sam_headers(spark, tmp_path):
    one = write(tmp_path / "a.sam", "@HD\tVN:1.6\n@SQ\tSN:b\tLN:5\n@SQ\tSN:a\tLN:7\n@RG\tID:g1\tSM:s1\tLB:l\n@CO\tfree text\n")
    two = write(tmp_path / "b.sam", "@HD\tVN:1.5\n@SQ\tSN:a\tLN:7\n@SQ\tSN:c\tLN:9\n@RG\tID:g2\tSM:s2\n")
    assert [(r.name, r.tid) for r in tf.sam_contigs(spark, one).orderBy("tid").collect()] == [("b", 0), ("a", 1)]
    headers = [tf.sam_header(spark, p) for p in (one, two)]
    assert [tuple(r) for r in tf.read_groups(headers[0]).collect()] == [("g1", "s1", "l")]
    merged = [r.value for r in tf.merge_headers(headers).collect()]
    assert merged == ["@HD\tVN:1.6", "@SQ\tSN:b\tLN:5", "@SQ\tSN:a\tLN:7", "@SQ\tSN:c\tLN:9", "@RG\tID:g1\tSM:s1\tLB:l", "@RG\tID:g2\tSM:s2", "@CO\tfree text"]
    names = spark.createDataFrame([("a", "chrA")], "name string, new_name string")
    assert "@SQ\tSN:chrA\tLN:7" in {r.value for r in tf.reheadered(headers[0], names).collect()}
    assert not {r.kind for r in tf.without_groups(headers[0], ["g1"]).collect()} & {"RG"}


def test_repeated_tags(spark, tmp_path):
    path = write(tmp_path / "a.sam", "r\t0\tc\t1\t9\t2M\t*\t0\t0\tAC\tII\tXA:Z:one\tNM:i:4\tXA:i:7\n")
    row = tf.read_sam(spark, path).first()
    assert row.tags == {"NM": "4", "XA": "7"} and row.tag_types == {"NM": "i", "XA": "i"} and row.n_tags == 3


@pytest.mark.parametrize("split", [1 << 26, 900])
def test_bam_round_trip(spark, tmp_path, split):
    """What is written is read again, tags with their types, from several files."""
    spark.dataSource.register(BamSource)
    tags = {"NM": ("i", "3"), "XB": ("i", "-70000"), "XU": ("i", "4000000000"), "XM": ("Z", "z.Z"), "XA": ("A", "q"), "XF": ("f", "0.5"), "XI": ("B", "s,1,-2,300")}
    rows = []
    for i in range(300):
        held = dict(list(tags.items())[: i % 8])
        rows.append((f"r{i}", 16 * (i % 2), i % 2, 10 * i, 30, f"{5 + i % 3}M2D3M" if i % 5 else "*", -1, -1, i - 100, "ACGTNACGTA"[: 5 + i % 6], "IIHGFEDCBA"[: 5 + i % 6], {k: v for k, (_, v) in held.items()}, len(held), {k: t for k, (t, _) in held.items()}))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    contigs = json.dumps([["chr1", 100000], ["chr2", 5000]])
    for _ in range(2):
        frame.write.format("bam").option("contigs", contigs).mode("overwrite").save(str(tmp_path / "out"))
    back = spark.read.format("bam").option("splitBytes", split).load(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    part = str(next((tmp_path / "out").glob("*.bam")))
    assert [tuple(r) for r in contigs_of(spark, part).collect()] == [(0, "chr1", 100000), (1, "chr2", 5000)]
    assert not list((tmp_path / "out").glob("_temp*"))


@pytest.mark.parametrize("split", [1 << 26, 300_000])
def test_bam_record_longer_than_ranges(spark, tmp_path, split):
    """A record of 20 MB is read once, and ranges inside it are empty."""
    spark.dataSource.register(BamSource)
    noise = random.Random(1).randbytes(15_000_000).hex()[:20_000_000]
    row = lambda i, tags: (f"r{i}", 0, 0, i, 30, "5M", -1, -1, 0, "ACGTA", "IIIII", tags, len(tags), {k: "Z" for k in tags})
    rows = [row(i, {"XX": noise} if i == 50 else {}) for i in range(100)]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    frame.write.format("bam").option("contigs", json.dumps([["chr1", 100000]])).mode("overwrite").save(str(tmp_path / "out"))
    back = spark.read.format("bam").option("splitBytes", split).load(str(tmp_path / "out"))
    assert back.rdd.getNumPartitions() > (1 if split < 1 << 20 else 0)
    got = back.select("qname", "pos", "tags").collect()
    assert sorted(r.pos for r in got) == list(range(100)) and next(r.tags["XX"] for r in got if r.pos == 50) == noise


def test_vcf_files_and_header(spark, tmp_path):
    one = write(tmp_path / "a.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\n1\t10\t.\tA\tG\t5\t.\t.\tGT\t0/1\nbad\n1\tx\t.\tA\tG\t5\t.\t.\n")
    two = write(tmp_path / "b.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tb\n1\t10\t.\tA\tG\t7\t.\t.\tGT\t1/1\n1\t12\t.\tC\tT\t7\t.\t.\tGT\t0/0\n")
    got = {(r.pos): [(f.file, f.samples) for f in r.files] for r in tf.read_vcf_files(spark, [one, two]).collect()}
    assert got == {10: [(0, ["0/1"]), (1, ["1/1"])], 12: [(1, ["0/0"])]}
    assert {r.value for r in tf.malformed_vcf(spark.read.text(one)).collect()} == {"bad", "1\tx\t.\tA\tG\t5\t.\t."}
    filters = spark.createDataFrame([("q30", "Quality of 30 or more")], "id string, description string")
    lines = [r.value for r in out.vcf_header_lines(tf.vcf_header(spark, one), filters).collect()]
    assert lines == ["##fileformat=VCFv4.2", '##FILTER=<ID=q30,Description="Quality of 30 or more">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta"]


def test_caps_and_reports(spark, tmp_path):
    (tmp_path / "mc.bin").write_bytes(b"\x02" + struct.pack("<III", 7, 70000, 9))
    (tmp_path / "hmc.bin").write_bytes(struct.pack("<II", 3, 1 << 31))
    read = lambda ds: sorted((r.tid, r.max_reads) for r in tf.read_caps(spark, str(tmp_path / f"{ds}.bin"), ds).collect())
    assert read("mc") == [(0, 7), (1, 70000)] and read("hmc") == [(0, 3), (1, 1 << 31)]
    rows = spark.createDataFrame([("mc", 5, 2.5)], "ds string, total long, skipped_pct double")
    assert [r.value for r in out.statistics_lines(rows).collect()] == ["ds\ttotal\tskipped_pct", "mc\t5\t2.5"]
    sites = spark.createDataFrame([(0,), (0,), (2,)], "chr int")
    contigs = spark.createDataFrame([(0,), (1,), (2,)], "tid int")
    assert {(r.number, r.rows) for r in out.map_files(sites, contigs).collect()} == {(1, 2), (2, 0), (3, 1)}


def test_fastq_ordinals(spark, tmp_path):
    spark.dataSource.register(FastqSource)
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\nAC\n+\nII\n" for i in range(40)))
    reads = spark.read.format("fastq").option("splitBytes", 50).load(str(tmp_path / "a.fq"))
    assert sorted((r.ordinal, r.id) for r in with_ordinals(reads).collect()) == [(i, f"r{i}") for i in range(40)]
    chosen = spark.createDataFrame([(3,), (39,), (99,)], "ordinal long")
    assert {r.id for r in at_positions(reads, chosen).collect()} == {"r3", "r39"}


def test_maps_from_sam(spark, tmp_path):
    seven = "\t".join(f"X{i}:i:1" for i in range(6))
    path = write(tmp_path / "a.sam", f"r1\t0\tchr1\t11\t60\t4M2D4M\t*\t0\t0\tACGTACGT\tIIIIIIII\t{seven}\tXM:Z:z..Z.x.h\n")
    contigs = spark.createDataFrame([("chr1", 0)], "name string, tid int")
    reads = tf.reads_for_maps(tf.read_sam(spark, path), contigs, "mc")
    got = {r.pos: (r.c, r.nc, r.mc) for r in site_counts(filter_reads(reads)).collect()}
    # places 0-3 are aligned, 4-5 deleted, 6-9 aligned; places from 8 on lie behind the read's length
    assert got == {10: (1, 0, 0), 13: (0, 0, 1), 17: (0, 0, 0)}


def test_vcf(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n##source=x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n1\t10\trs1\tA\tG,T\t50\tPASS\tDP=5;H2\tGT:DP\t0/1:3\t./.:0\n1\t20\t.\tAT\t0\t.\t.\t.\tGT\t0|0\t1|1\nbad line\n"
    path = tmp_path / "a.vcf.gz"
    path.write_bytes(gzip.compress(text.encode()))
    rows = tf.read_vcf(spark, str(path)).orderBy("pos").collect()
    assert [(r.pos, r.alt, r.qual, r.samples) for r in rows] == [(10, "G,T", 50.0, ["0/1:3", "./.:0"]), (20, ".", -1.0, ["0|0", "1|1"])]
    assert {(r.key, r.value) for r in tf.vcf_header(spark, str(path)).collect()} == {("fileformat", "VCFv4.2"), ("source", "x"), ("samples", "a\tb")}
    assert {r.value for r in out.vcf_lines(tf.read_vcf(spark, str(path))).collect()} == {"1\t10\trs1\tA\tG,T\t50.00\tPASS\tDP=5;H2\tGT:DP\t0/1:3\t./.:0", "1\t20\t.\tAT\t.\t.\t.\t.\tGT\t0|0\t1|1"}


def test_small_formats(spark, tmp_path):
    gff = tf.read_gff(spark, write(tmp_path / "a.gff", "##gff-version 3\n# c\n1\ts\texon\t5\t9\t.\t+\t0\tID=1\n2\ts\tgene\t1\t4\t2.5\t-\t.\n")).orderBy("start").collect()
    assert [(r.sequence, r.end, r.score, r.attribute) for r in gff] == [("2", 4, 2.5, None), ("1", 9, None, "ID=1")]
    bed = tf.read_bed(spark, write(tmp_path / "a.bed", "track x\nchr1 5 9 n 3 +\nchr2\t7\n")).orderBy("start").collect()
    assert [(r.chrom, r.start, r.end, r.name) for r in bed] == [("chr1", 5, 9, "n"), ("chr2", 6, 7, None)]
    ped = tf.read_ped(spark, write(tmp_path / "a.ped", "f 1 0 0 1 1\nf 2 1 0 2 .\n")).orderBy("individual").collect()
    assert [(r.individual, r.father, r.mother, r.sex, r.phenotype) for r in ped] == [("1", None, None, 1, 1.0), ("2", "1", None, 2, None)]
    index = tf.read_index(spark, write(tmp_path / "index", ">c1 0 99\n>c2 0 49\n")).orderBy("name").collect()
    assert [(r.name, r.length) for r in index] == [("c1", 100), ("c2", 50)]
    fasta = tf.read_fasta(spark, write(tmp_path / "a.fa", ">c1 text\nACG\nTTT\n>c2\nggg\n"))
    assert {(r.name, r.sequence) for r in fasta.collect()} == {("c1", "ACGTTT"), ("c2", "GGG")}
    assert tf.fasta_slice(fasta, "c1", -3, 4).first().sequence == "ACGT" and tf.fasta_slice(fasta, "c1", 5, 99).first().sequence == "TT"


@pytest.mark.parametrize("split", [1 << 26, 100, 37])
def test_fastq(spark, tmp_path, split):
    records = "".join(f"@r{i} x\n{'ACGTN'[: 1 + i % 5]}\n+\n{'@@@@@'[: 1 + i % 5]}\n" for i in range(50))
    spark.dataSource.register(FastqSource)
    read = lambda p: spark.read.format("fastq").option("splitBytes", split).load(str(p))
    (tmp_path / "a.fq").write_text(records)
    rows = sorted(read(tmp_path / "a.fq").collect(), key=lambda r: r.place)
    assert [(r.id, len(r.sequence), r.quality[0]) for r in rows] == [(f"r{i} x", 1 + i % 5, "@") for i in range(50)]
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(records.encode()))
    assert read(tmp_path / "b.fq.gz").count() == 50
    lines = {r.value for r in out.fastq_lines(read(tmp_path / "a.fq")).collect()}
    assert lines == {f"@r{i} x\n{'ACGTN'[: 1 + i % 5]}\n+\n{'@@@@@'[: 1 + i % 5]}" for i in range(50)}


def test_map_file(spark, tmp_path):
    rows = spark.createDataFrame([(0, 5, 1, 2, 3, 4, 5, 6), (0, 2, 1, 1, 1, 1, 1, 1), (1, 9, 0, 0, 1, 0, 0, 7)], "chr int, pos long, c long, nc long, mc long, ch long, nch long, hmc long")
    out.write_map(rows, str(tmp_path / "maps"), "forward")
    back = tf.read_map(spark, str(tmp_path / "maps" / "forward" / "chr=0")).collect()
    assert sorted((r.pos, r.hmc) for r in back) == [(2, 1), (5, 6)]


def test_region_goldens(spark):
    # Regions and questions with known answers.
    table = spark.createDataFrame([("2", 10000, 20000), ("3", 30000, 40000), ("4", 60000, 80000), ("4", 200000, 250000), ("X", 1000000, 1500000), ("X", 1000000, 1800000), ("Y", 2000000, 3000000)], "chrom string, start long, end long")
    asked = [("3", 30000, 40000), ("Y", 2100000, 2200000), ("4", 30000, 70000), ("4", 30000, 90000), ("4", 100000, 190000), ("4", 160000, 210000), ("4", 240000, 270000), ("4", 280000, 300000), ("X", 1000000, 1700000)]
    rows = spark.createDataFrame(asked, "c string, s long, e long")
    assert {tuple(r) for r in rg.contained(rows, table, "c", "s", "e").collect()} == {asked[0], asked[1], asked[8]}


def bgzf(data, size):
    out_blocks = b""
    for a in [*range(0, len(data), size), None]:
        part = data[a : a + size] if a is not None else b""
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out_blocks += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out_blocks


def bam_record(name, tid, pos, flag, cigar, seq, tags=b""):
    raw = name.encode() + b"\0"
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(raw), 37, 0, len(cigar), flag, len(seq), -1, -1, 0) + raw + ops + packed + bytes([30] * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


@pytest.mark.parametrize("split", [1 << 26, 3000, 700])
def test_bam(spark, tmp_path, split):
    contigs = [(b"chr1\0", 1000), (b"chr2\0", 500)]
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(n)) + n + struct.pack("<i", k) for n, k in contigs)
    want, body = [], b""
    for i in range(400):
        seq = "ACGTN"[i % 5 :] + "ACG" * (i % 7)
        tags = b"NMC" + bytes([i % 9]) + b"XMZz.Z\0" + b"XBBc" + struct.pack("<i", 2) + b"\1\2"
        body += bam_record(f"read{i}", i % 2, i * 3, 16 * (i % 2), [(len(seq), "M")], seq, tags)
        want.append((f"read{i}", i % 2, i * 3, f"{len(seq)}M", seq, i % 9))
    path = tmp_path / "x.bam"
    path.write_bytes(bgzf(head + body, 900))
    spark.dataSource.register(BamSource)
    got = spark.read.format("bam").option("splitBytes", split).load(str(path)).collect()
    assert sorted((r.qname, r.tid, r.pos, r.cigar, r.seq, int(r.tags["NM"])) for r in got) == sorted(want)
    assert {(r.n_tags, r.tags["XM"], r.tags["XB"]) for r in got} == {(3, "z.Z", "c,1,2")}
    assert [(r.tid, r.name, r.length) for r in contigs_of(spark, str(path)).collect()] == [(0, "chr1", 1000), (1, "chr2", 500)]
