"""Conversions of genotype likelihoods, calls of pairs, and tests of what variant letters have in common.

`pl` is the array of phred-scaled likelihoods of a sample's genotypes in the order of VCF (00, 01, 11, 02, 12, 22, ...).
Everything but the t-tests is built-in expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calling import BASES
from .scoring import fisher_exact

MOST = 255


def pl_of_gl(gl: Column) -> Column:
    """Phred-scaled likelihoods (0 to 255) from logarithms to base ten."""
    return F.transform(gl, lambda x: F.greatest(F.least((-10 * x + 0.499).cast("int"), F.lit(MOST)), F.lit(0)))


def genotype_first(fmt: Column, samples: Column) -> tuple[Column, Column]:
    """FORMAT and the samples with GT as the first field; as they are where it is missing or first."""
    keys = F.split(fmt, ":")
    at = F.array_position(keys, "GT").cast("int")

    def moved(fields: Column) -> Column:
        rest = F.filter(F.transform(fields, lambda x, i: F.struct((i + 1).alias("i"), x.alias("x"))), lambda f: f["i"] != at)
        return F.when(at > 1, F.array_join(F.concat(F.array(F.coalesce(F.get(fields, at - 1), F.lit("."))), F.transform(rest, lambda f: f["x"])), ":")).otherwise(F.array_join(fields, ":"))

    return moved(keys), F.transform(samples, lambda s: moved(F.split(s, ":")))


def pl_from_rows(pl: Column, alleles: Column) -> Column:
    """The order of VCF from that by first allele (00, 01, 02, ..., 11, 12, ...)."""
    n = alleles.cast("int")
    of = lambda high: F.transform(F.sequence(F.lit(0), high), lambda low: F.get(pl, (low * n - low * (low - 1) / 2 + high - low).cast("int")))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), of))


def fewer_alleles(alleles: Column, pl: Column, n: int) -> tuple[Column, Column]:
    """The first n alleles (an array, the reference's first) and the likelihoods of their genotypes."""
    return F.slice(alleles, 1, n), F.slice(pl, 1, n * (n + 1) // 2)


def covered_samples(pls: Column) -> Column:
    """Samples that know anything: any likelihood that isn't 0."""
    return F.size(F.filter(pls, lambda pl: F.exists(pl, lambda x: x > 0)))


def ten_genotypes(alleles: Column, pl: Column) -> Column:
    """Likelihoods of AA, AC, AG, AT, CC, CG, CT, GG, GT and TT, from those of a site's alleles (letters; X stands for all
    that weren't seen).

    255 where a letter is no allele and there is no X; null if an allele is longer than a letter, if the reference isn't
    known, or with more than four alleles or one only.
    """
    place = {b: F.coalesce(F.nullif(F.array_position(alleles, b), F.lit(0)), F.nullif(F.array_position(alleles, "X"), F.lit(0))).cast("int") - 1 for b in BASES}
    out = []
    for i, one in enumerate(BASES):
        for two in BASES[i:]:
            low, high = F.least(place[one], place[two]), F.greatest(place[one], place[two])
            known = place[one].isNotNull() & place[two].isNotNull()
            out.append(F.when(known, F.get(pl, (high * (high + 1) / 2 + low).cast("int"))).otherwise(MOST))
    fits = F.size(alleles).between(2, 4) & F.get(alleles, F.lit(0)).isin(*BASES) & ~F.exists(alleles, lambda a: F.length(a) != 1)
    return F.when(fits, F.array(*out))


def largest_annotations(gts: Column, gq: Column, sp: Column) -> Column:
    """mxsp and mxgq: the largest strand bias and genotype quality of samples with an alternate allele; the first less
    what so many heterozygotes (of quality 20 or more) weigh by chance.  `gts` are arrays of two allele numbers."""
    rows = F.arrays_zip(gts.alias("g"), gq.alias("q"), sp.alias("s"))
    alternate = F.filter(rows, lambda r: F.exists(r["g"], lambda a: a > 0))
    top = lambda name: F.aggregate(alternate, F.lit(0), lambda m, r: F.greatest(m, F.coalesce(r[name].cast("int"), F.lit(0))))
    mixed = F.size(F.filter(rows, lambda r: F.exists(r["g"], lambda a: a > 0) & F.exists(r["g"], lambda a: a == 0) & (F.coalesce(r["q"], F.lit(20)) >= 20)))
    chance = F.when(mixed > 0, F.floor(4.343 * F.log(F.greatest(mixed, F.lit(1))) + 0.499)).otherwise(0)
    return F.struct(F.greatest(top("s") - chance, F.lit(0)).cast("int").alias("mxsp"), top("q").alias("mxgq"))


def best_apart(pl: Column) -> Column:
    """How far the best genotype is ahead of the second."""
    order = F.array_sort(pl)
    return F.get(order, F.lit(1)) - F.get(order, F.lit(0))


def pair_differences(likelihoods: DataFrame, sample: str, one, two) -> DataFrame:  # noqa: ANN001
    """tid, pos, difference (by how much the best genotype that both samples share is less likely than the best of each;
    0 where both are best without alternate alleles) and apart (how far the less sure sample's best is ahead of its second).
    """
    sums = [F.max(F.when(F.col(sample) == who, F.col(f"pl{g}"))).alias(f"{r}{g}") for r, who in (("a", one), ("b", two)) for g in range(3)]
    rows = likelihoods.filter(F.col(sample).isin(one, two)).groupBy("tid", "pos").agg(*sums).dropna()
    together = F.least(*[F.col(f"a{g}") + F.col(f"b{g}") for g in range(3)])
    alone = F.least("a0", "a1", "a2") + F.least("b0", "b1", "b2")
    plain = (F.col("a0") == 0) & (F.col("b0") == 0)
    apart = F.least(*[best_apart(F.array(*[F.col(f"{r}{g}") for g in range(3)])) for r in "ab"])
    return rows.select("tid", "pos", F.when(plain, 0).otherwise(together - alone).alias("difference"), apart.alias("apart"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series from 8 on, and steps down to x."""
    shift = np.maximum(0, 8 - np.floor(x)).astype(int)
    steps = np.zeros_like(x)
    for k in range(8):
        steps += np.where(k < shift, np.log(x + k), 0)
    y = x + shift
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - steps


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction from the side where it converges."""
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(np.maximum(z, 1e-300)) + q * np.log(np.maximum(1 - z, 1e-300))) / p
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1 / safe(1 - (p + q) * z / (p + 1))
    c, out = np.ones_like(z), d.copy()
    for m in range(1, 200):
        for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / safe(1 + term * d), safe(1 + term / c)
            out = out * c * d
    value = np.clip(np.where(z <= 0, 0.0, front * out), 0, 1)
    return np.where(turn, 1 - value, value)


def smaller_mean(n1: Column | str, s1: Column | str, q1: Column | str, n2: Column | str, s2: Column | str, q2: Column | str) -> Column:
    """p of a t-test that the second group's mean isn't smaller than the first's, from numbers, sums and sums of squares;
    1 where it isn't smaller, or with fewer than three values or an empty group; 0 without any spread."""

    @F.pandas_udf("double")
    def test(n1: pd.Series, s1: pd.Series, q1: pd.Series, n2: pd.Series, s2: pd.Series, q2: pd.Series) -> pd.Series:
        a, sa, qa, b, sb, qb = (x.to_numpy(dtype=float) for x in (n1, s1, q1, n2, s2, q2))
        some = (a > 0) & (b > 0) & (a + b > 2)
        a, b = np.maximum(a, 1), np.maximum(b, 1)
        u, v = sa / a, sb / b
        free = np.maximum(a + b - 2, 1)
        spread = np.maximum((qa - a * u * u) + (qb - b * v * v), 0) / free * (1 / a + 1 / b)
        with np.errstate(divide="ignore"):
            t2 = np.where(spread > 0, (u - v) ** 2 / np.maximum(spread, 1e-300), np.inf)
        p = 0.5 * incomplete_beta(0.5 * free, np.full_like(free, 0.5), free / (free + t2))
        return pd.Series(np.where(some & (u > v), p, 1.0))

    return test(*[F.col(c) if isinstance(c, str) else c for c in (n1, s1, q1, n2, s2, q2)])


def site_biases(annotations: DataFrame) -> DataFrame:
    """tid, pos, mapq (root mean square) and p_strand, p_base, p_mapq and p_edge of `calling.site_annotations`: whether
    variant letters prefer a strand, and whether they are of less quality, in reads of less mapping quality, or nearer to
    an end than the reference's."""
    n1, n2 = F.col("ref_forward") + F.col("ref_reverse"), F.col("alt_forward") + F.col("alt_reverse")
    test = lambda what: smaller_mean(n1, f"ref_{what}", f"ref_{what}_squares", n2, f"alt_{what}", f"alt_{what}_squares").alias(f"p_{what}")
    rows = annotations.filter("depth > 0")
    mapq = F.floor(F.sqrt(F.floor((F.col("ref_mapq_squares") + F.col("alt_mapq_squares")) / F.col("depth"))) + 0.499).cast("int")
    return rows.select("tid", "pos", mapq.alias("mapq"), fisher_exact("ref_forward", "ref_reverse", "alt_forward", "alt_reverse").alias("p_strand"), *[test(w) for w in ("base", "mapq", "edge")])
