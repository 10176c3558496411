from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from .helpers import ODD, frame, prose

from cytoplan.llm import simhash as sh

UPPER = {i: i + 32 for i in range(65, 91)}


def print_of(text):
    """The fingerprint, bit by bit."""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in (text or "").translate(UPPER)).split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    """Smallest id that is reachable, over all pairs."""
    group = list(range(len(prints)))
    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    return [min((x for x, g in zip(ids, group, strict=True) if g == mine and x is not None), default=None) for mine in group]


def check(spark, rows):
    got = sorted(map(tuple, sh.simhash_components(frame(spark, rows)).collect()), key=str)
    prints = [print_of(t) for _, t in rows]
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, components(prints, [i for i, _ in rows]), strict=True)]
    assert got == sorted(want, key=str)
    return got


def test_code_is_perfect_and_keys_meet():
    assert len(set(sh._NEAR[:, 0].tolist())) == 1 << sh.CHECK_BITS
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 20_000)
    near = sh.nearby_codewords(words)
    assert near.shape[1] == 6
    for bit in range(23):
        assert (near == sh.nearby_codewords(words ^ (1 << bit))[:, :1]).any(axis=1).all()


@pytest.mark.parametrize("flips", [1, 2, 3])
def test_every_pattern_of_flips_is_found(flips):
    rng = random.Random(flips)
    base = rng.getrandbits(64)
    chosen = list(combinations(range(64), flips))
    for bits in rng.sample(chosen, min(len(chosen), 1500)):
        other = base ^ sum(1 << b for b in bits)
        own, sought = sh.fuzzy_keys(np.array([base, other], dtype=np.uint64))
        assert set(own[0].tolist()) & set(sought[1].as_py())
        assert set(own[1].tolist()) & set(sought[0].as_py())


def test_fingerprints_of_odd_and_long_texts():
    texts = [t for _, t in ODD] + ["A b C", "a b c", "a\x0bb c  d", "one two", "x " * 700, " ".join(prose(5000, 1)), "w" * 9000 + " tail of words", "\n" + "Q" * 7000]
    want = [print_of(t) for t in texts]
    assert sh.fingerprints(pa.array(texts)).tolist() == want
    assert sh.fingerprints(pa.array(texts), size=512).tolist() == want  # in pieces
    assert sh.fingerprints(pa.array(texts).slice(3, 4)).tolist() == want[3:7]


def test_components(spark):
    rng = random.Random(5)
    rows = list(ODD)
    for family in range(12):
        words = prose(300, family)
        for copy in range(8):
            changed = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(9)}"
            rows.append((1000 - family * 20 - copy, " ".join(changed)))
    rows += [(50, " ".join(prose(300, 0))), (None, " ".join(prose(300, 3))), (None, "nobody else has these words")]
    got = check(spark, rows)
    assert sum(i != c for i, _, c in got) > 40


def test_chains_and_hot_fingerprints(spark):
    prints = [0]
    for bit in range(0, 60, 3):
        prints.append(prints[-1] | 7 << bit)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints + [0x5555555555555555]], "fp long")
    found = {frozenset((r.u, r.v)) for r in sh.links(table).collect()}
    assert found == {frozenset(x) for x in zip(prints, prints[1:], strict=False)}
    check(spark, [(i, "same old text here") for i in range(200)] + [(999, "another text of its own kind")])


def test_empty_table_and_clashing_columns(spark):
    assert sh.simhash_components(frame(spark, [])).collect() == []
    docs = spark.createDataFrame([(1, "a b c d", 5, "k"), (2, "a b c d", 6, "k")], "doc_id long, text string, fp int, component_id string")
    assert {r.component_id for r in sh.simhash_components(docs).collect()} == {1}
