from __future__ import annotations

import random
import time
from hashlib import md5

import pytest

from cytoplan.llm.line_dedup import line_dedup, windows

from .helpers import ODD, frame, prose


def result(spark, rows, **options):
    return {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in line_dedup(frame(spark, rows), **options).collect()}


def test_passage_of_one_and_of_many_lines_goes_later(spark):
    passage = " ".join(prose(60, 1))
    lines = [" ".join(prose(9, s)) for s in range(10, 18)]
    rows = [(1, f"own words here\n{passage}\nand more"), (2, f"other start\n{passage}"), (3, "\n".join(["alpha", *lines, "omega"])), (4, "\n".join(["beta", *lines])), (5, " ".join(prose(80, 99)))]
    got = result(spark, rows)
    assert got[1] == (rows[0][1], 3, 0)
    assert got[2] == ("other start", 2, 1)
    assert got[3][2] == 0
    assert got[4] == ("beta", 9, 8)
    assert got[5] == (rows[4][1], 1, 0)


def test_short_runs_stay(spark):
    rows = [(1, "a footer of five words\nx y z"), (2, "a footer of five words\nu v w")]
    assert all(n == 0 for _, _, n in result(spark, rows).values())


def test_repeats_inside_a_document(spark):
    line = " ".join(prose(30, 3))
    got = result(spark, [(1, f"{line}\nbetween\n{line}\n{line}")])
    assert got[1] == (f"{line}\nbetween", 4, 2)


def test_every_run_with_a_full_window_is_covered(spark):
    """Each document after the first repeats a stretch of it, cut anywhere."""
    base = [" ".join(prose(3 + s % 11, 500 + s)) for s in range(60)]
    rows = [(0, "\n".join(base))]
    for k in range(1, 30):
        a = (k * 7) % 40
        rows.append((k, "\n".join([f"head {k}", *base[a : a + 12], f"tail {k}"])))
    got = result(spark, rows)
    for k in range(1, 30):
        a = (k * 7) % 40
        assert sum(len(x.split()) for x in base[a : a + 12]) >= 25
        assert got[k][0] == f"head {k}\ntail {k}"


def test_odd_cases(spark):
    docs = frame(spark, ODD).withColumnRenamed("lang", "n_lines")
    out = line_dedup(docs)
    got = out.collect()
    assert len(got) == len(ODD) and sum(r.text is None for r in got) == 1
    assert {"doc_id", "text", "n_lines", "n_deleted", "source", "n_chars"} == set(out.columns)
    assert [r.n_deleted for r in got if r.doc_id == 7] == [299]  # of 300 equal lines the first stays
    assert line_dedup(frame(spark, [])).collect() == []


def test_runs_whose_lines_stand_earlier_in_other_places(spark):
    """Every line of the run stands before on its own, so no line's first place is that of the run."""
    order = lambda line: md5(line.encode()).digest()
    run = sorted((" ".join(prose(9, s)) for s in range(70, 100)), key=order)[:6]
    long = [max((" ".join(prose(30, 100 * k + i)) for i in range(20)), key=order) for k in range(1, 13)]
    rows = [(k, f"{long[k]}\n{line}\n{long[k + 6]}") for k, line in enumerate(run)]
    rows += [(10, "\n".join(["alpha", *run])), (11, "\n".join(["beta", *run, "omega"]))]
    got = result(spark, rows)
    assert all(got[k][2] == 0 for k in range(6)) and got[10][2] == 0
    assert got[11] == ("beta\nomega", 8, 6)


def by_hand(rows, least):
    """Every run of lines of `least` words or more that stands before goes, by comparing all runs."""
    seen, out = set(), {}
    for i, text in rows:
        lines = (text or "").split("\n")
        full = [(k, x.strip(" \t\r\v\f")) for k, x in enumerate(lines) if x.strip(" \t\r\v\f")]
        gone, words = set(), [len(x.split(" ")) for _, x in full]
        for a in range(len(full)):
            for b in range(a + 1, len(full) + 1):
                if sum(words[a:b]) >= least:
                    run = tuple(x for _, x in full[a:b])
                    if run in seen:
                        gone.update(range(a, b))
                    seen.add(run)
        if text is not None:
            dropped = {full[k][0] for k in gone}
            text = "\n".join(x for k, x in enumerate(lines) if k not in dropped) if dropped else text
        out[i] = (text, 0 if text is None and not gone else len(lines), len(gone))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_all_runs(spark, seed):
    """Texts of few different lines, so that most lines stand in many places."""
    rng = random.Random(seed)
    lines = [" ".join(prose(rng.randrange(1, 6), 900 + i)) for i in range(12)] + ["", " \t"]
    pieces = [[rng.choice(lines) for _ in range(rng.randrange(3, 9))] for _ in range(8)]
    rows = [(i, "\n".join(x for _ in range(rng.randrange(1, 5)) for x in (rng.choice(pieces) if rng.random() < 0.6 else [rng.choice(lines)]))) for i in range(60)]
    assert result(spark, rows, min_words=8) == by_hand(rows, 8)


def test_a_common_line_with_a_small_hash_hides_nothing(spark):
    line = min((" ".join(prose(8, s)) for s in range(200, 260)), key=lambda x: md5(x.encode()).digest())
    strangers = [" ".join(prose(20, s)) for s in range(300, 302)]
    run = [" ".join(prose(8, s)) for s in (310, 311)] + [line] + [" ".join(prose(8, 312))]
    rows = [(1, "\n".join([strangers[0], line, strangers[1]])), (2, "\n".join(run)), (3, "\n".join(["own", *run]))]
    got = result(spark, rows)
    assert got[1][2] == 0 and got[2][2] == 0 and got[3] == ("own", 5, 4)


def test_windows_choose_the_smallest_hash(spark):
    lines = [(1, 0, i, h, h, 10) for i, h in enumerate([5, 3, 9, 3, 7, 1])]
    got = windows(spark.createDataFrame(lines, "doc_id long, text_key long, pos int, h long, g long, w long"), 25).collect()
    assert sorted((r.first_line, r.last_line, r.mark, r.at) for r in got) == [(0, 2, 3, 1), (1, 3, 3, 1), (2, 4, 3, 3), (3, 5, 1, 5)]


def test_long_texts_take_linear_time(spark):
    """100,000 lines in a document."""
    text = "\n".join(f"line {i} of many words, which goes on to its end {i * i}" for i in range(100_000))
    result(spark, [(1, "x")])
    start = time.perf_counter()
    got = result(spark, [(1, text), (2, text + "\nend")])
    assert got[1][1:] == (100_000, 0) and got[2] == ("end", 100_001, 100_000)
    assert time.perf_counter() - start < 60


def test_clashing_names_and_repeated_rows(spark):
    line = " ".join(prose(30, 5))
    rows = [(None, line), (1, line), (1, line), (1, f"{line}\nx"), (2, None)]
    docs = frame(spark, rows).withColumnsRenamed({"lang": "key", "source": "gone", "n_chars": "runs"}).withColumn("own", docs_own()).withColumn("a.b", docs_own())
    out = line_dedup(docs)
    assert set(out.columns) == {"doc_id", "text", "key", "gone", "runs", "own", "a.b", "n_lines", "n_deleted"}
    got = sorted((r.doc_id or 0, r.text or "", r.n_deleted, r.own) for r in out.collect())
    assert got[0] == (0, line, 0, 1) and got[1:3] == [(1, "", 1, 1)] * 2 and got[3] == (1, "x", 1, 1) and got[4] == (2, "", 0, 1)


def docs_own():
    from pyspark.sql import functions as F

    return F.lit(1)
