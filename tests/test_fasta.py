from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cytoplan.sources import fasta
from cytoplan.sources import text_formats as tf


def made(tmp_path, newline="\n"):
    rng = random.Random(3)
    texts = {"chr1": "".join(rng.choice("ACGTN") for _ in range(997)), "chr2": "".join(rng.choice("acgt") for _ in range(60)), "empty": "", "c:3": "ACGTA"}
    width = {"chr1": 50, "chr2": 60, "empty": 10, "c:3": 5}
    body = "".join(f">{n} some words{newline}" + "".join(t[i : i + width[n]] + newline for i in range(0, len(t), width[n])) for n, t in texts.items())
    path = tmp_path / "ref.fa"
    path.write_bytes(body.encode())
    return str(path), {n: t.upper() for n, t in texts.items()}


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.chrom, r.start)):
        begin, text = out.get(r.chrom, (r.start, ""))
        assert r.start == begin + len(text)
        out[r.chrom] = begin, text + r.sequence
    return out


@pytest.mark.parametrize(("newline", "split"), [("\n", 1 << 20), ("\n", 64), ("\r\n", 100), ("\n", 7)])
def test_index_and_pieces(spark, tmp_path, newline, split):
    path, texts = made(tmp_path, newline)
    rows = fasta.index_fasta(spark, path, split).collect()
    assert [(r["name"], r.length) for r in rows] == [(n, len(t)) for n, t in texts.items()]
    (tmp_path / "ref.fa.fai").write_text("".join("\t".join(map(str, r)) + "\n" for r in rows))
    for piece in (1, 7, 50, 64, 5000):
        if piece == 1 and split != 64:
            continue
        got = joined(fasta.contig_pieces(spark, path, piece=str(piece), splitBytes=str(split)))
        assert {n: t for n, (_, t) in got.items()} == {n: t for n, t in texts.items() if t}
    if newline == "\n" and split == 64:
        plain = {r["name"]: r.sequence for r in tf.read_fasta(spark, path).collect()}
        assert {n: plain[n] for n in texts if texts[n]} == {n: t for n, t in texts.items() if t}


def test_slices_at_every_border(spark, tmp_path):
    path, texts = made(tmp_path)
    rows = fasta.index_fasta(spark, path).collect()
    (tmp_path / "ref.fa.fai").write_text("".join("\t".join(map(str, r)) + "\n" for r in rows))
    reader = fasta.FastaReader({"path": path})
    for name, number in (("chr1", 0), ("chr2", 1), ("c:3", 3)):
        text = texts[name]
        for a in [*range(0, min(len(text), 110)), len(text) - 1]:
            for b in {a + 1, min(a + 50, len(text)), len(text)}:
                assert reader.letters(reader.contigs[number], a, b) == text[a:b]
    got = joined(fasta.contig_pieces(spark, path, "chr1:990-5000,c:3:2-3,nowhere:1-5,chr2:61-70"))
    assert got == {"chr1": (989, texts["chr1"][989:]), "c:3": (1, "CG")}
    assert joined(fasta.contig_pieces(spark, path, "c:3")) == {"c:3": (0, "ACGTA")}
    whole = fasta.contig_pieces(spark, path, splitBytes="100")
    assert whole.rdd.getNumPartitions() > 5
    assert whole.filter(F.col("chrom") == "chr2").count() == 1


def test_packed_genome(spark, tmp_path):
    _, texts = made(tmp_path)
    held = {n: t for n, t in texts.items() if t}
    (tmp_path / "dna").write_bytes(fasta.packed("".join(held.values())))
    (tmp_path / "index").write_text("".join(f">{n} 0 {len(t) - 1}\n" for n, t in held.items()))
    path = str(tmp_path / "dna")
    for piece in (7, 64, 5000):
        got = joined(fasta.contig_pieces(spark, path, packed_form=True, piece=str(piece), splitBytes="100"))
        assert got == {n: (0, t) for n, t in held.items()}
    reader = fasta.PackedReader({"path": path})
    for number, text in enumerate(held.values()):
        for a in range(0, len(text), 11 if number == 0 else 1):
            for b in {a + 1, min(a + 2, len(text)), min(a + 3, len(text)), len(text)}:
                assert reader.letters(reader.contigs[number], a, b) == text[a:b]
    assert joined(fasta.contig_pieces(spark, path, "chr2:10-12", packed_form=True)) == {"chr2": (9, held["chr2"][9:12])}
