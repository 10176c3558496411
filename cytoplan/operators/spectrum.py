"""Calling over an allele frequency spectrum: the spectrum of all sites, calls under it, and two groups of samples compared.

What is known of a site is how likely its data are with 0, 1, ... 2n alternate alleles among n samples.  The spectrum,
how many sites have so many, starts as that of a neutral population and is improved by all sites at once: each round is
one aggregate over the table, and 2n + 1 numbers come to the driver.  Samples are a given list; one that a site doesn't
show is one of which nothing is known.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THETA, ROUNDS = 0.001, 3
#: Both ends of the interval of likely frequencies together leave out so much.
OUTSIDE = 0.05


def neutral(alleles: int, theta: float = THETA) -> list[float]:
    """Shares of sites with 0, 1, ... alternate alleles among so many, in a neutral population."""
    rest = [theta / k for k in range(1, alleles + 1)]
    return [1 - sum(rest), *rest]


def by_site(likelihoods: DataFrame, sample: str, samples: list) -> DataFrame:  # noqa: ANN001
    """tid, pos and l: for each of the samples, in their order, the likelihoods of 0, 1 and 2 alternate alleles."""
    own = [F.max(F.when(F.col(sample) == s, F.array("pl0", "pl1", "pl2"))).alias(f"_{i}") for i, s in enumerate(samples)]
    rows = likelihoods.filter(F.col(sample).isin(*samples)).groupBy("tid", "pos").agg(*own)
    known = [F.coalesce(F.col(f"_{i}"), F.array(*[F.lit(0)] * 3)) for i in range(len(samples))]
    return rows.select("tid", "pos", F.array(*[F.transform(x, lambda p: F.pow(F.lit(10.0), -p / 10)) for x in known]).alias("l"))


def _ways(alleles: int) -> np.ndarray:
    return np.array([math.comb(alleles, k) for k in range(alleles + 1)], dtype=float)


def summed(l: np.ndarray) -> np.ndarray:  # noqa: E741
    """Sites x samples x 3 likelihoods to sites x (2n + 1): all ways to have so many alternate alleles, each site up to a factor."""
    y = np.ones((len(l), 1))
    for i in range(l.shape[1]):
        wide = np.zeros((len(l), y.shape[1] + 2))
        for g, times in enumerate((1, 2, 1)):
            wide[:, g : g + y.shape[1]] += times * l[:, i, g, None] * y
        y = wide / wide.max(axis=1, keepdims=True, initial=1e-300)
    return y


def _likelihoods(column: pa.Array, samples: int) -> np.ndarray:
    return column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, samples, 3)


def allele_count_likelihoods(likelihoods: DataFrame, sample: str, samples: list) -> DataFrame:  # noqa: ANN001
    """tid, pos and z: how likely a site's data are with k alternate alleles, up to a factor."""
    n = len(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = summed(_likelihoods(batch.column(2), n)) / _ways(2 * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(z), pa.list_(pa.float64()))], names=["tid", "pos", "z"])

    rows = by_site(likelihoods, sample, samples)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"tid {kinds['tid']}, pos {kinds['pos']}, z array<double>")


def _posterior(spectrum: list[float]) -> Column:
    weighed = F.zip_with("z", F.array(*map(F.lit, spectrum)), lambda z, p: z * p)
    total = F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weighed, lambda x: x / total)


def spectrum_of(sites: DataFrame, alleles: int, rounds: int = ROUNDS, theta: float = THETA) -> list[float]:
    """Shares of sites with 0, 1, ... alternate alleles, from `allele_count_likelihoods`; the neutral ones without sites."""
    found = neutral(alleles, theta)
    for _ in range(rounds):
        row = sites.select(_posterior(found).alias("p")).agg(*[F.avg(F.get("p", F.lit(k))).alias(f"k{k}") for k in range(alleles + 1)]).first()
        if row[0] is None:
            break
        found = list(row)
    return found


def afs_spectrum(likelihoods: DataFrame, sample: str, samples: list, rounds: int = ROUNDS, theta: float = THETA) -> DataFrame:  # noqa: ANN001
    """alleles (0 to 2n) and share of sites, after so many rounds."""
    sites = allele_count_likelihoods(likelihoods, sample, samples).persist(StorageLevel.DISK_ONLY)
    found = spectrum_of(sites, 2 * len(samples), rounds, theta)
    sites.unpersist()
    return likelihoods.sparkSession.createDataFrame(list(enumerate(found)), "alleles int, share double")


def spectrum_calls(likelihoods: DataFrame, sample: str, samples: list, rounds: int = ROUNDS, theta: float = THETA) -> DataFrame:  # noqa: ANN001
    """tid, pos, alleles (the likeliest number, whatever the spectrum; ties: fewer), variant (chance that there is any),
    folded (chance of a variant if neither allele is known to be the older one), frequency (expected), low and high (the
    alternate allele's frequency lies between them, but for 2.5 % at either end)."""
    m = 2 * len(samples)
    sites = allele_count_likelihoods(likelihoods, sample, samples).persist(StorageLevel.DISK_ONLY)
    found = spectrum_of(sites, m, rounds, theta)
    both = [(a + b) / 2 for a, b in zip(found, reversed(found), strict=True)]
    rows = sites.withColumns({"p": _posterior(found), "f": _posterior(both)})
    expected = F.aggregate(F.transform("p", lambda p, k: p * k), F.lit(0.0), lambda s, x: s + x) / m

    def end(values: Column) -> Column:
        """How many entries stay under the share that is left out, from the front."""
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + F.when(s["sum"] + x <= OUTSIDE / 2, 1).otherwise(0)).alias("n"))
        return F.aggregate(values, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), step, lambda s: s["n"])

    first, last = F.get("f", F.lit(0)), F.get("f", F.lit(m))
    return rows.select(
        "tid",
        "pos",
        (F.array_position("z", F.array_max("z")) - 1).cast("int").alias("alleles"),
        (1 - F.get("p", F.lit(0))).alias("variant"),
        (1 - first - last).alias("folded"),
        expected.alias("frequency"),
        (end(F.col("p")) / m).alias("low"),
        (1 - end(F.reverse("p")) / m).alias("high"),
    )


class Contrast:
    """Two groups of so many samples each, under one spectrum."""

    def __init__(self, one: int, two: int, spectrum: list[float]):
        a, b = 2 * one, 2 * two
        self.ways = _ways(a), _ways(b), _ways(a + b)
        self.phi = np.array(spectrum)[np.arange(a + 1)[:, None] + np.arange(b + 1)]
        self.hyper = self.ways[0][:, None] * self.ways[1] / self.ways[2][np.arange(a + 1)[:, None] + np.arange(b + 1)]
        self.chi = np.array([[self._chi(i, j, a - i, b - j) for j in range(b + 1)] for i in range(a + 1)])
        share = np.arange(a + 1)[:, None] / a - np.arange(b + 1) / b
        self.side = np.where(np.abs(share) < 1e-12, 0, np.where(share < 0, 1, 2))

    @staticmethod
    def _chi(a: int, b: int, c: int, d: int) -> float:
        """The chance of a table as uneven as this, without a difference."""
        x = float(a + b) * (c + d) * (b + d) * (a + c)
        return math.erfc(math.sqrt(0.5 * (a * d - b * c) ** 2 * (a + b + c + d) / x)) if x else 1.0

    def __call__(self, l: np.ndarray, one: list[int], two: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
        """p of equal frequencies (expected over allele counts), chances that they are equal, lower and higher in the first
        group, and p of the likelihood ratio."""
        y1, y2 = summed(l[:, one]), summed(l[:, two])
        z1, z2 = y1 / self.ways[0], y2 / self.ways[1]
        joint = z1[:, :, None] * z2[:, None, :] * self.hyper
        weighed = joint * self.phi
        weighed /= weighed.sum(axis=(1, 2), keepdims=True)
        whole = np.zeros((len(l), len(self.ways[2])))
        for i in range(joint.shape[1]):
            whole[:, i : i + joint.shape[2]] += joint[:, i]
        ratio = np.log(z1.max(axis=1) * z2.max(axis=1) / whole.max(axis=1))
        sides = np.stack([(weighed * (self.side == s)).sum(axis=(1, 2)) for s in range(3)], axis=1)
        return (weighed * self.chi).sum(axis=(1, 2)), sides, np.array([1.0 if r < 0 else math.erfc(math.sqrt(r)) for r in ratio])


def shuffles(samples: list, times: int, seed: int) -> list[list[int]]:  # noqa: ANN001
    """Orders of the samples by hashes of their names."""
    key = lambda t, s: hashlib.sha256(f"{seed}:{t}:{s}".encode()).hexdigest()
    return [sorted(range(len(samples)), key=lambda i: (key(t, samples[i]), i)) for t in range(times)]


def afs_contrast(likelihoods: DataFrame, sample: str, first: list, second: list, permutations: int = 0, seed: int = 1, rounds: int = ROUNDS, theta: float = THETA) -> DataFrame:  # noqa: ANN001
    """tid, pos, p_contrast, equal, lower, higher, p_ratio and as_uneven of every site that is more likely a variant than not.

    `p_contrast` is the p of a chi-square test of both groups' allele counts, expected over what the counts can be;
    equal, lower and higher are the chances for the first group's frequency against the second's; `p_ratio` is of the
    likelihood ratio of two frequencies against one.  `as_uneven` counts, among so many orders of the samples by hashes,
    those whose groups give no larger p_contrast.
    """
    samples = [*first, *second]
    n, n1 = len(samples), len(first)
    rows = by_site(likelihoods, sample, samples).persist(StorageLevel.DISK_ONLY)
    found = spectrum_of(allele_count_likelihoods(likelihoods, sample, samples), 2 * n, rounds, theta)
    orders = shuffles(samples, permutations, seed)
    contrast = Contrast(n1, n - n1, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l = _likelihoods(batch.column(2), n)  # noqa: E741
            p = summed(l) / _ways(2 * n) * found
            variant = p[:, 0] <= 0.5 * p.sum(axis=1)
            l = l[variant]  # noqa: E741
            p, sides, ratio = contrast(l, list(range(n1)), list(range(n1, n)))
            uneven = np.zeros(len(l), dtype=np.int64)
            for order in orders:
                uneven += contrast(l, order[:n1], order[n1:])[0] <= p * (1 + 1e-12)
            held = [batch.column(i).filter(pa.array(variant)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*held, *map(pa.array, (p, *sides.T, ratio)), pa.array(uneven, pa.int32())], names=["tid", "pos", "p_contrast", "equal", "lower", "higher", "p_ratio", "as_uneven"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"tid {kinds['tid']}, pos {kinds['pos']}, p_contrast double, equal double, lower double, higher double, p_ratio double, as_uneven int")
