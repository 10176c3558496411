from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplan.operators import genotypes as ge
from cytoplan.operators import regions as rg


def value(spark, column, **columns):
    """A column expression over one row."""
    row = spark.createDataFrame([tuple(v for v, _ in columns.values())], ", ".join(f"{n} {t}" for n, (_, t) in columns.items()))
    return row.select(column.alias("x")).first().x


def test_likelihoods_from_logarithms(spark):
    assert value(spark, ge.pl_of_gl(F.col("gl")), gl=([0.0, -0.05, -0.06, -3.21, -99.0, 1.0], "array<double>")) == [0, 0, 1, 32, 255, 0]


def test_genotype_comes_first(spark):
    for fmt, samples, want in (("DP:GT:GQ", ["3:0/1:9", "."], ("GT:DP:GQ", ["0/1:3:9", ".:."])), ("GT:DP", ["0/0:1"], ("GT:DP", ["0/0:1"])), ("DP:GTX", ["1:2"], ("DP:GTX", ["1:2"]))):
        a, b = ge.genotype_first(F.col("f"), F.col("s"))
        assert (value(spark, a, f=(fmt, "string"), s=(samples, "array<string>")), value(spark, b, f=(fmt, "string"), s=(samples, "array<string>"))) == want


def test_orders_and_fewer_alleles(spark):
    for n in (2, 3, 4):
        rows = [(k, l) for k in range(n) for l in range(k, n)]
        want = [rows.index((k, l)) for l in range(n) for k in range(l + 1)]
        assert value(spark, ge.pl_from_rows(F.col("pl"), F.col("n")), pl=(list(range(len(rows))), "array<int>"), n=(n, "int")) == want
    a, b = ge.fewer_alleles(F.col("al"), F.col("pl"), 2)
    assert value(spark, F.concat(a, b.cast("array<string>")), al=(["A", "C", "X"], "array<string>"), pl=([0, 1, 2, 3, 4, 5], "array<int>")) == ["A", "C", "0", "1", "2"]
    assert value(spark, ge.covered_samples(F.col("p")), p=([[0, 0, 0], [0, 3, 4], []], "array<array<int>>")) == 1
    assert value(spark, ge.best_apart(F.col("p")), p=([30, 4, 9], "array<int>")) == 5


def test_ten_genotypes(spark):
    def ten(alleles, pl):
        return value(spark, ge.ten_genotypes(F.col("a"), F.col("p")), a=(alleles, "array<string>"), p=(pl, "array<int>"))

    pl = [0, 1, 2, 3, 4, 5]
    place = {"G": 0, "A": 1}
    want = []
    for i, one in enumerate("ACGT"):
        for two in "ACGT"[i:]:
            x, y = sorted((place.get(one, 2), place.get(two, 2)))
            want.append(pl[y * (y + 1) // 2 + x])
    assert ten(["G", "A", "X"], pl) == want
    assert ten(["G", "A"], pl[:3]) == [2, 255, 1, 255, 255, 255, 255, 0, 255, 255]
    assert ten(["GA", "A"], pl[:3]) is None and ten(["N", "A"], pl[:3]) is None and ten(["G"], [0]) is None


def test_largest_annotations(spark):
    def top(gts, gq, sp):
        x = value(spark, ge.largest_annotations(F.col("g"), F.col("q"), F.col("s")), g=(gts, "array<array<int>>"), q=(gq, "array<int>"), s=(sp, "array<int>"))
        return x.mxsp, x.mxgq

    assert top([[0, 1], [1, 1], [0, 0]], [30, 40, 99], [9, 4, 50]) == (9, 40)
    assert top([[0, 1]] * 5, [30] * 5, [9, 1, 1, 1, 1]) == (9 - int(4.343 * math.log(5) + 0.499), 30)
    assert top([[0, 0]], [3], [3]) == (0, 0) and top([[0, 1]], [10], [2]) == (2, 10)


def test_pairs(spark):
    rows = [(0, 1, "a", 0, 5, 50), (0, 1, "b", 0, 9, 70), (0, 2, "a", 0, 5, 50), (0, 2, "b", 60, 9, 0), (0, 3, "a", 9, 0, 9), (0, 3, "c", 0, 1, 2)]
    df = spark.createDataFrame(rows, "tid int, pos int, s string, pl0 int, pl1 int, pl2 int")
    assert sorted(map(tuple, ge.pair_differences(df, "s", "a", "b").collect())) == [(0, 1, 0, 5), (0, 2, 14, 5)]


def test_incomplete_beta_by_integration():
    for a, b in ((0.5, 0.5), (1, 0.5), (7.5, 0.5), (40, 0.5), (300, 0.5), (3, 4)):
        for x in (0.0, 0.01, 0.3, 0.77, 0.999, 1.0):
            u = (np.arange(400_000) + 0.5) / 400_000 * math.asin(math.sqrt(x))  # x = sin^2 u
            whole = math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
            want = (2 * np.sin(u) ** (2 * a - 1) * np.cos(u) ** (2 * b - 1)).sum() * math.asin(math.sqrt(x)) / 400_000 / whole
            got = ge.incomplete_beta(np.array([float(a)]), np.array([float(b)]), np.array([x]))[0]
            assert got == pytest.approx(want, abs=2e-5)


def test_smaller_means(spark):
    one, two = [30, 35, 40, 38], [10, 12, 33]
    sums = lambda v: (len(v), sum(v), sum(x * x for x in v))
    names = ("n1", "s1", "q1", "n2", "s2", "q2")
    rows = [(*sums(one), *sums(two)), (*sums(two), *sums(one)), (*sums([]), *sums(two)), (1, 5, 25, 1, 3, 9), (*sums([9] * 3), *sums([5] * 3))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    p = [r.p for r in df.select(ge.smaller_mean(*names).alias("p")).collect()]
    m1, m2 = np.mean(one), np.mean(two)
    t = (m1 - m2) / math.sqrt((sum((x - m1) ** 2 for x in one) + sum((x - m2) ** 2 for x in two)) / 5 * (1 / 4 + 1 / 3))
    x = np.linspace(t, 2000, 4_000_000)
    density = math.gamma(3) / math.sqrt(5 * math.pi) / math.gamma(2.5) * (1 + x * x / 5) ** -3
    assert p[0] == pytest.approx(((density[1:] + density[:-1]) / 2 * np.diff(x)).sum(), rel=1e-4)
    assert p[1:] == [1, 1, 1, 0]


def test_same_place(spark):
    rows = [(("1", 5, 9, 0), ("1", 5, 9, 0)), (("1", 5, 9, 0), ("1", 5, 8, 0)), (("1", 5, 9, 0), ("1", 9, 5, 1)), (("1", 5, 9, 0), ("1", 9, 4, 1)), (("1", 5, 9, 0), ("2", 5, 9, 0))]
    kind = "struct<chrom:string,start:int,end:int,strand:int>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    got = [tuple(r) for r in df.select(rg.same_place("a", "b"), rg.same_place("a", "b", soft=True)).collect()]
    assert got == [(True, True), (False, True), (True, True), (False, True), (False, False)]


def test_regions_of_files(spark):
    gff = spark.createDataFrame([("1", "src", 5, 9)], "sequence string, source string, start int, end int")
    bed = spark.createDataFrame([("2", 0, 7, "n")], "chrom string, start int, end int, name string")
    assert [tuple(r) for r in rg.from_gff(gff).unionByName(rg.from_bed(bed)).collect()] == [("1", 5, 9), ("2", 0, 7)]
