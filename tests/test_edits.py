from __future__ import annotations

import random
import re

import pytest

from cytoplan.functions.edits import fits
from cytoplan.operators import raw_reads as rr


def distance(read, text):
    """Fewest edits of the read against a beginning of the text, and where the nearest such one ends."""
    row = list(range(len(text) + 1))
    for i, c in enumerate(read, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    best = min(row)
    return best, row.index(best)


def replay(cigar, read, text):
    """Edits that a CIGAR stands for, and letters of the text that it uses."""
    i = j = edits = 0
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        if op == "M":
            edits += sum(a != b for a, b in zip(read[i : i + n], text[j : j + n], strict=True))
            i, j = i + n, j + n
        elif op == "I":
            i, edits = i + n, edits + n
        else:
            j, edits = j + n, edits + n
    return i, j, edits


@pytest.mark.parametrize("errors", [0, 1, 3])
def test_distances_and_cigars(errors):
    rng = random.Random(errors)
    reads, texts = [], []
    for _ in range(400):
        text = "".join(rng.choice("ACG") for _ in range(rng.randrange(0, 40)))
        read = list(text[: rng.randrange(0, 36)])
        for _ in range(rng.randrange(0, errors + 2)):
            at, what = rng.randrange(len(read) + 1), rng.randrange(3)
            read[at : at + (what > 0)] = [rng.choice("ACGT")] if what < 2 else []
        reads.append("".join(read))
        texts.append(text)
    got, cigars = fits([r.encode() for r in reads], [t.encode() for t in texts], errors)
    seen = 0
    for read, text, edits, cigar in zip(reads, texts, got.tolist(), cigars, strict=True):
        want, end = distance(read, text)
        if not read or want > errors:
            assert edits == errors + 1 and cigar == ""
            continue
        seen += 1
        assert edits == want and replay(cigar, read, text) == (len(read), end, want)
    assert seen > 100


def all_places(reads, contigs, errors):
    """Every place of every contig, measured."""
    out = set()
    for name, read in reads:
        for strand in (0, 1):
            text = read if strand == 0 else read.translate(str.maketrans("ACGT", "TGCA"))[::-1]
            for chrom, start, sequence in contigs:
                found = {p: distance(text, sequence[p : p + len(text) + errors])[0] for p in range(len(sequence))}
                found = {p: d for p, d in found.items() if d <= errors}
                for p, d in found.items():
                    if all((d, p) <= (found[q], q) for q in range(p - errors, p + errors + 1) if q in found):
                        out.add((name, chrom, start + p, strand, d))
    return out


@pytest.mark.parametrize("errors", [1, 2])
def test_all_placements(spark, errors):
    rng = random.Random(10 + errors)
    contigs = [("c1", 0, "".join(rng.choice("ACGT") for _ in range(600)) + "ACG" * 20), ("c2", 50, "".join(rng.choice("AC") for _ in range(200)))]
    reads = []
    for i in range(60):
        _, _, sequence = contigs[i % 2]
        at = rng.randrange(0, len(sequence) - 30)
        read = list(sequence[at : at + rng.randrange(24, 30)])
        for _ in range(rng.randrange(0, errors + 2)):
            p, what = rng.randrange(len(read)), rng.randrange(3)
            read[p : p + (what > 0)] = [rng.choice("ACGT")] if what < 2 else []
        text = "".join(read)
        reads.append((f"r{i}", text if rng.random() < 0.5 else text.translate(str.maketrans("ACGT", "TGCA"))[::-1]))
    reads += [("edge", contigs[0][2][:26]), ("end", contigs[0][2][-26:]), ("beyond", contigs[1][2][-25:] + "G"), ("short", "ACGT")]
    long_enough = [r for r in reads if len(r[1]) // (errors + 1) >= 6]
    got = rr.map_edits(spark.createDataFrame(reads, "id string, sequence string").repartition(3), spark.createDataFrame(contigs, "chrom string, start long, sequence string"), errors, 6).collect()
    assert {(r.id, r.chrom, r.pos, r.strand, r.mismatches) for r in got} == all_places(long_enough, contigs, errors) and len(got) > 50
    texts = {c: (s, t) for c, s, t in contigs}
    for r in got:
        text = dict(reads)[r.id]
        text = text if r.strand == 0 else text.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        start, sequence = texts[r.chrom]
        i, _, edits = replay(r.cigar, text, sequence[r.pos - start :])
        assert i == len(text) and edits == r.mismatches
    assert {r.nh for r in rr.hit_tags(rr.map_edits(spark.createDataFrame(reads[:3], "id string, sequence string"), spark.createDataFrame(contigs, "chrom string, start long, sequence string"), errors, 6)).collect()} >= {1}


def test_long_reads_and_none(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("ACGT") for _ in range(12_000))
    read = text[1_000:5_000] + text[5_001:9_000] + "A" + text[9_000:10_000]
    contigs = spark.createDataFrame([("c", 7, text)], "chrom string, start long, sequence string")
    got = rr.map_edits(spark.createDataFrame([("long", read)], "id string, sequence string"), contigs, 2).collect()
    assert [(r.pos, r.strand, r.mismatches) for r in got] == [(1_007, 0, 2)] and replay(got[0].cigar, read, text[1_000:])[2] == 2
    assert rr.map_edits(spark.createDataFrame([], "id string, sequence string"), contigs, 1).collect() == []


@pytest.mark.parametrize(("errors", "bisulfite"), [(0, True), (1, False), (1, True), (2, False)])
def test_few_contigs_without_a_join(spark, errors, bisulfite):
    """Seeds of common letters meet many places; none of those pairs is shuffled, and the hits are those of the join."""
    rng = random.Random(40 + errors)
    texts = ["".join(rng.choices("ACGTNé", (5, 5, 2, 2, 0.2, 0.2), k=300)), "A" * 60 + "ACACAC" * 5, "GATTACA" * 9]
    contigs = spark.createDataFrame([(f"c{i}", i * 10, t) for i, t in enumerate(texts)], "chrom string, start long, sequence string")
    reads = [("a", "A" * 18), ("b", "AC" * 9), ("twice", texts[0][40:58]), ("twice", texts[0][40:58]), ("ends", texts[0][-18:])]
    for i in range(60):
        t = texts[i % 3]
        at = rng.randrange(len(t) - 20)
        read = t[at : at + rng.randrange(18, 21)]
        p = rng.randrange(len(read))
        read = read[:p] + rng.choice(["", "A", "CG", read[p]]) + read[p + 1 :]
        reads.append((f"r{i}", read if i % 2 else read.translate(str.maketrans("ACGT", "TGCA"))[::-1]))
    table = spark.createDataFrame(reads, "id string, sequence string")
    for find in (rr.map_mismatches, rr.map_edits):
        held = find(table, contigs, errors, 6, bisulfite=bisulfite)
        assert "Join" not in held._jdf.queryExecution().executedPlan().toString()
        assert sorted(held.collect()) == sorted(find(table, contigs, errors, 6, bisulfite=bisulfite, held=0).collect())
