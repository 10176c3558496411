from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from cytoplan.operators import spectrum as sp

PL = "tid int, pos long, s string, pl0 int, pl1 int, pl2 int"


def made(seed, sites=25, samples="abcde"):
    rng, rows = random.Random(seed), []
    for pos in range(sites):
        share = rng.choice([0.0, 0.2, 0.5, 0.9])
        for i, s in enumerate(samples):
            if rng.random() < 0.1:
                continue
            g = sum(rng.random() < (share if i < 2 or pos % 3 else 1 - share) for _ in range(2))
            pl = [rng.randint(5, 90) for _ in range(3)]
            pl[g] = 0
            rows.append((0, pos, s, *pl))
    return rows


def table(rows, samples):
    """site: likelihoods of each sample, all ones for a missing one."""
    out = {}
    for _, pos, s, *pl in rows:
        out.setdefault(pos, {})[s] = [10 ** (-p / 10) for p in pl]
    return {pos: [held.get(s, [1.0] * 3) for s in samples] for pos, held in out.items()}


def counts(l):
    """All genotypes of all samples, one by one: likelihood of the data with k alternate alleles."""
    m = 2 * len(l)
    z = [0.0] * (m + 1)
    for gs in itertools.product(range(3), repeat=len(l)):
        z[sum(gs)] += math.prod(x[g] * (1, 2, 1)[g] for x, g in zip(l, gs, strict=True))
    return [x / math.comb(m, k) for k, x in enumerate(z)]


def spectrum(zs, m, rounds):
    phi = [1 - sum(0.001 / k for k in range(1, m + 1)), *[0.001 / k for k in range(1, m + 1)]]
    for _ in range(rounds):
        posts = [[p * x for p, x in zip(phi, z, strict=True)] for z in zs]
        phi = [sum(p[k] / sum(p) for p in posts) / len(posts) for k in range(m + 1)]
    return phi


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_spectrum_and_calls_by_hand(spark, rounds):
    samples = list("abc")
    rows = made(1, samples="abcx")  # x takes no part
    zs = {pos: counts(l) for pos, l in table([r for r in rows if r[2] != "x"], samples).items()}
    df = spark.createDataFrame(rows, PL).repartition(3)
    phi = spectrum(list(zs.values()), 6, rounds)
    got = [r.share for r in sorted(sp.afs_spectrum(df, "s", samples, rounds).collect())]
    assert np.allclose(got, phi)
    calls = {r.pos: r for r in sp.spectrum_calls(df, "s", samples, rounds).collect()}
    assert set(calls) == set(zs)
    for pos, z in zs.items():
        p = np.array(phi) * z
        p /= p.sum()
        f = (np.array(phi) + phi[::-1]) / 2 * z
        low = next(i for i in range(8) if i == 7 or p[: i + 1].sum() > 0.025)
        high = next(i for i in range(8) if i == 7 or p[6 - i :].sum() > 0.025)
        r = calls[pos]
        assert r.alleles == int(np.argmax(z)) and (r.low, r.high) == pytest.approx((low / 6, 1 - high / 6))
        assert (r.variant, r.folded, r.frequency) == pytest.approx((1 - p[0], 1 - (f[0] + f[6]) / f.sum(), (p * range(7)).sum() / 6))


def test_contrast_by_hand(spark):
    samples, rows = list("abcde"), made(2)
    df = spark.createDataFrame(rows, PL).repartition(3)
    held = table(rows, samples)
    phi = spectrum([counts(l) for l in held.values()], 10, 2)
    got = {r.pos: r for r in sp.afs_contrast(df, "s", ["a", "b"], ["c", "d", "e"], permutations=5, rounds=2).collect()}

    def chi(a, b, c, d):
        x = (a + b) * (c + d) * (b + d) * (a + c)
        return math.erfc(math.sqrt((a * d - b * c) ** 2 * (a + b + c + d) / x / 2)) if x else 1.0

    def one(l, first, second):
        z1, z2, z = counts([l[i] for i in first]), counts([l[i] for i in second]), counts(l)
        total, p, side = sum(a * b for a, b in zip(phi, z, strict=True)), 0.0, [0.0] * 3
        for k1, k2 in itertools.product(range(5), range(7)):
            w = phi[k1 + k2] * z1[k1] * z2[k2] * math.comb(4, k1) * math.comb(6, k2) / math.comb(10, k1 + k2) / total
            p += w * chi(k1, k2, 4 - k1, 6 - k2)
            side[0 if k1 * 6 == k2 * 4 else 1 if k1 * 6 < k2 * 4 else 2] += w
        ratio = math.log(max(z1) * max(z2) / max(z))
        return p, side, 1.0 if ratio < 0 else math.erfc(math.sqrt(ratio))

    variants = 0
    for pos, l in held.items():
        post = [a * b for a, b in zip(phi, counts(l), strict=True)]
        assert (pos in got) == (post[0] <= 0.5 * sum(post))
        if pos in got:
            variants += 1
            p, side, ratio = one(l, [0, 1], [2, 3, 4])
            r = got[pos]
            assert (r.p_contrast, r.equal, r.lower, r.higher, r.p_ratio) == pytest.approx((p, *side, ratio), rel=1e-6)
            assert r.as_uneven == sum(one(l, o[:2], o[2:])[0] <= p * (1 + 1e-9) for o in sp.shuffles(samples, 5, 1))
    assert 5 < variants < len(held) or variants == len(held)
    assert len({tuple(o) for o in sp.shuffles(samples, 20, 1)}) > 10


def test_no_sites(spark):
    none = spark.createDataFrame([], PL)
    assert [r.share for r in sp.afs_spectrum(none, "s", ["a"]).collect()] == pytest.approx(sp.neutral(2))
    assert sp.spectrum_calls(none, "s", ["a"]).collect() == [] and sp.afs_contrast(none, "s", ["a"], ["b"]).collect() == []
