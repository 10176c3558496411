"""Small document tables with every odd case."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, partitions=3):
    """rows of (doc_id, text)."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ÄÖ ß été 漢字 \U0001f600"), (6, "a" * 5000), (7, "x\n" * 300), (None, "a text whose id is missing"), (9, "one"), (9, "one")]
