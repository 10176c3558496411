import random

from pyspark.sql import functions as F

from cytoplan.operators import pileup as pl


def _tables(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGTN") for _ in range(1_200))
    rows = []
    for i in range(900):
        cigar, n = rng.choice([("20M", 20), ("3S17M", 20), ("8M2D12M", 20), ("6=3I10M1X", 20), ("5M300N15M", 20), ("2H20M", 20), ("40M", 20), ("20S", 20)])
        seq = "".join(rng.choice("ACGTNa") for _ in range(n))
        pos = 250 if i % 3 else rng.randrange(0, 1_190)
        rows.append((i, rng.choice([0, 0, 16, 4, 1024]), rng.choice([0, 1, -1]), pos, rng.choice([5, 30]), cigar, seq, "".join(chr(33 + rng.choice([5, 13, 20, 40])) for _ in range(n)) if i % 50 else None, rng.choice(["x", "y", None])))
    reads = spark.createDataFrame(rows, "read_id long, flag int, tid int, pos int, mapq int, cigar string, seq string, qual string, sample string")
    return reads, spark.createDataFrame([(0, text), (1, text[::-1])], "tid int, sequence string")


def test_counts_are_those_of_the_pileup(spark):
    reads, contigs = _tables(spark)
    for quality in (0, 13):
        rows = pl.pileup(reads, 10, contigs=contigs, min_quality=quality, keep=("sample",)).filter("letter IN ('A', 'C', 'G', 'T') AND ref IN ('A', 'C', 'G', 'T') AND quality <> ''")
        want = rows.groupBy("tid", "span", "pos", "sample", "ref", "letter", (F.ascii("quality") - 33).alias("quality")).count()
        got = pl.letter_counts(reads, contigs, ("sample",), 10, quality)
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and want.count() > 500


def test_letters_are_not_rows(spark):
    """A pileup of likelihoods takes no read apart into rows of letters."""
    reads, contigs = _tables(spark)
    plan = pl.genotype_likelihoods(reads, contigs, "sample", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 2 and "posexplode" not in plan
