from __future__ import annotations

import hashlib
from collections import defaultdict

from cytoplan.llm.exact_dedup import LOWER, UPPER, drop_copies, exact_dedup

from .helpers import ODD, frame

FOLD = str.maketrans(UPPER, LOWER)


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = []
    for text, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        out += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


def test_odd_cases(spark):
    rows = [*ODD, (20, "Same Text"), (21, "same text"), (22, "SAME TEXT"), (23, "sÄme"), (24, "säme")]
    assert rows_of(exact_dedup(frame(spark, rows))) == expected(rows)


def test_every_row_counts(spark):
    """Rows that repeat an id, a text or both."""
    rows = [(1, "A"), (1, "a"), (2, "x"), (2, "x"), (2, "y"), (None, "x"), (None, "x"), (None, None), (3, "z" * 3_000_000), (4, "Z" * 3_000_000)]
    assert rows_of(exact_dedup(frame(spark, rows))) == expected(rows)


def test_large_group_over_all_runs(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i % 500}") for i in range(3000)]
    assert rows_of(exact_dedup(frame(spark, rows), runs=64, fan_in=4)) == expected(rows)


def test_single_run(spark):
    rows = [(1, "a"), (2, "A"), (3, "b")]
    assert rows_of(exact_dedup(frame(spark, rows), runs=1)) == expected(rows)


def test_empty(spark):
    assert rows_of(exact_dedup(frame(spark, []))) == []


def test_drop_keeps_columns(spark):
    docs = frame(spark, [*ODD, (20, "Same"), (21, "same")])
    docs = docs.withColumnsRenamed({"lang": "keep_id", "source": "_name", "n_chars": "_lost"})  # a column named like one of the report's
    left = drop_copies(docs)
    assert left.columns == docs.columns
    # null, "" are equal texts; 9 stands twice; 4 and 9 are equal
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [2, 3, 5, 6, 7, None, 9, 21]))
