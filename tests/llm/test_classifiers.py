from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from cytoplan.llm import quality, toxicity
from cytoplan.llm._labels import labelled_sample

from .helpers import ODD, frame, prose

DATA = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"
INSULTS = ["blockhead", "nitwit", "numbskull", "dimwit"]


def corpus(n=240):
    """Every fourth document has insults, every third is junk."""
    rng, rows, labels = random.Random(1), [], []
    syllables = ["an", "ther", "in", "on", "sh", "wh", "ed", "ing", "re", "st"]
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(30, 120))]
        if i % 4 == 0:
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        if i % 3 == 0:
            words = [f"{w}%%&&" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 != 0), int(i % 4 == 0)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return frame(spark, [*rows, *((None if i is None else 1000 + i, t) for i, t in ODD)]), spark.createDataFrame([*labels, (5, None, None), (9999, 1, 1)], LABELS), {i: x for i, *x in labels}


def check(out, want, at, least):
    got = out.collect()
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    held = [(r.predicted, want[r.doc_id][at]) for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) >= least
    return got


def test_quality_held_out(tables):
    docs, labels, want = tables
    got = check(quality.classify_quality(docs, labels), want, 0, 0.95)
    assert len(got) == docs.count()


def test_toxicity_held_out(tables):
    docs, labels, want = tables
    got = check(toxicity.classify_toxicity(docs, labels), want, 1, 0.95)
    assert len(got) == docs.count()


def test_drop_toxic(tables):
    docs, labels, want = tables
    named = docs.withColumnsRenamed({"lang": "score", "source": "_toxicity_score"})
    left = toxicity.drop_toxic(named, labels)
    assert left.columns == named.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    clean = [i for i, x in want.items() if not x[1]]
    assert len(set(ids) & set(clean)) >= 0.97 * len(clean) and sum(i in ids for i, x in want.items() if x[1]) <= 3


def test_repeated_ids_and_long_texts(spark, tables):
    """Labels that contradict each other, an id that stands twice, and a text of 6 MB."""
    _, labels, _ = tables
    rows, _ = corpus(60)
    docs = frame(spark, [*rows, (3, "another text"), (None, rows[0][1]), (None, rows[0][1]), (900, rows[5][1] * 8000)])
    more = labels.unionByName(spark.createDataFrame([(4, 0, 0), (4, 1, 1), (7, 0, None)], LABELS))
    for out in (quality.classify_quality(docs, more), toxicity.classify_toxicity(docs, more)):
        got = out.collect()
        assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id is None}) == 1


def test_without_labels(spark, tables):
    docs, labels, _ = tables
    none = labels.limit(0)
    assert {r.score for r in quality.classify_quality(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.classify_toxicity(docs, none).collect()} == {0.0}
    assert {r.score for r in quality.classify_quality(docs, labels.filter("quality = 1")).collect()} <= {1.0, 0.5}
    empty = frame(spark, [])
    assert quality.classify_quality(empty, labels).collect() == [] and toxicity.classify_toxicity(empty, labels).collect() == []


def test_sample_is_bounded_and_the_same_each_time(tables):
    docs, labels, _ = tables
    one, two = (labelled_sample(docs, labels, "toxic", {0: 20, 1: 7}) for _ in range(2))
    assert one.equals(two) and one["label"].to_pylist().count(0) == 20 and 0 < one["label"].to_pylist().count(1) <= 7


def test_neighbours_by_hand():
    """Blocked products and votes against a loop over all pairs."""
    rows, labels = corpus(90)
    texts, marks = pa.array([t for _, t in rows]), np.array([x[1] for x in labels])
    model = quality.fit(texts, marks)
    asked = pa.array(["an ther in on", "an%%&& ther%%&&", "", None, "漢字 " * 50])
    latent = model.latent(*quality.features(asked))
    for got, v in zip(model.score(*quality.features(asked)), latent, strict=True):
        near = sorted(range(len(marks)), key=lambda i: -float(model.vectors[i] @ v))[: quality.NEIGHBOURS]
        votes = [max(float(model.vectors[i] @ v), 0) ** quality.POWER * model.class_weight[i] for i in near]
        want = sum(w for i, w in zip(near, votes, strict=True) if marks[i]) / sum(votes) if sum(votes) else 0.5
        assert got == pytest.approx(want, abs=1e-4)


def test_driver_gives_memory_back_after_the_fit(tables, monkeypatch):
    order = []
    monkeypatch.setattr(toxicity, "fit_on", lambda *_, **__: order.append("fit"))
    monkeypatch.setattr(toxicity, "trim", lambda: order.append("trim"))
    toxicity.drop_toxic(tables[0], tables[1])
    assert order == ["fit", "trim"]


def test_windows_cover_the_text():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        text = bytes(i % 251 for i in range(n))
        parts = list(toxicity.windows(text))
        assert parts[0] == text[: toxicity.WINDOW] and parts[-1] == text[-toxicity.WINDOW :]
        assert sum(map(len, parts)) >= n


def test_telling_stretches_are_the_insults():
    rows, labels = corpus()
    toxic, plain = ([toxicity.normalised(t) for (_, t), (_, _, x) in zip(rows, labels, strict=True) if x == k] for k in (1, 0))
    marks = toxicity.telling_stretches(toxic, plain)
    assert {m.strip() for m in marks} >= {w.encode() for w in INSULTS} and len(marks) < 30


def test_distance_by_hand(monkeypatch):
    """Window counts against a loop with a compressor of its own for every window."""
    import zstandard

    rows, labels = corpus()
    toxic, plain = ([t for (_, t), (_, _, x) in zip(rows, labels, strict=True) if x == k] for k in (1, 0))
    model = toxicity.dictionaries(toxic[:40], plain[:120])
    monkeypatch.setattr(toxicity, "BLOCK", 5)
    distance = toxicity.Distance(model.ordinary, model.toxic)
    held = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (model.ordinary, model.toxic)]
    settings = zstandard.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=6, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False)
    for text in (toxic[45], plain[130], "", "idle nitwit", "漢字 " * 40):
        gains = []
        for w in toxicity.windows(toxicity.normalised(text)):
            one, two = (len(zstandard.ZstdCompressor(dict_data=d, compression_params=settings).compress(w)) for d in held)
            gains.append(one - two)
        gains.sort(reverse=True)
        n = len(gains)
        passed = [sum(g >= t for g in gains) for t in toxicity.GAINS]
        want = [gains[0], np.mean(gains[:3]), np.mean(gains), np.log(n), *np.log1p(passed), *(p / n for p in passed[1:5])]
        assert distance.features(toxicity.normalised(text)) == pytest.approx(want)


def test_calibration_rows_train_nothing():
    sample = pa.table({"label": pa.array([0, 1, 1, 0, 0, 1, 0, 0]), "text": pa.array(list("abcdefgh"))})
    toxic, plain, rest = toxicity.split(sample)
    assert toxic == ["b", "c"] and plain == ["a", "d", "g", "h"] and rest["text"].to_pylist() == ["e", "f"]


def test_one_long_text_costs_no_other_row(spark):
    """Wherever it stands in the order, a text that doesn't fit is passed over alone."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], LABELS)
    plain = labelled_sample(frame(spark, [(i, "x" * 10) for i in range(60)]), labels, "toxic", {0: 60}, most_bytes=1000)
    ids = plain["doc_id"].to_pylist()
    assert 40 < len(ids) < 60
    for place in (0, 2, len(ids) // 2, len(ids) - 1):
        docs = frame(spark, [(i, "x" * (995 if i == ids[place] else 10)) for i in range(60)])
        got = labelled_sample(docs, labels, "toxic", {0: 60}, most_bytes=1000)
        if place == 0:  # it comes first and fits: nothing else does
            assert got["doc_id"].to_pylist() == [ids[0]]
        else:
            assert got["doc_id"].to_pylist() == [i for i in ids if i != ids[place]]
    all_fit = labelled_sample(docs, labels, "toxic", {0: 60})
    assert all_fit["doc_id"].to_pylist() == ids and max(map(len, all_fit["text"].to_pylist())) == 995
    assert len(labelled_sample(docs, labels, "toxic", {0: 60}, most_bytes=55)) == 5


def test_bounds_are_handed_through(spark):
    rows, marks = corpus(60)
    docs = frame(spark, rows)
    labels = spark.createDataFrame(marks, LABELS)
    assert {r.score for r in quality.classify_quality(docs, labels, most_bytes=0).collect()} == {0.5}
    assert toxicity.fit_on(docs, labels, most_bytes=0) is None
    assert toxicity.drop_toxic(docs, labels, most_bytes=0).count() == docs.count()


def test_equal_neighbours_go_to_the_earlier(monkeypatch):
    vectors = np.tile(np.eye(6, quality.DIMENSIONS, dtype=np.float32), (50, 1))
    labels = np.arange(300) % 7 % 2
    model = quality.Model(np.ones(quality.TERMS), np.zeros(1), np.zeros((1, 1)), vectors, labels, np.ones(300))
    asked = np.abs(np.random.default_rng(0).normal(size=(200, quality.DIMENSIONS))).astype(np.float32)
    monkeypatch.setattr(quality.Model, "latent", lambda self, counts, measures: counts)
    got = model.score(asked, asked)
    for row, score in zip(asked @ vectors.T, got, strict=True):
        near = sorted(range(300), key=lambda i: (-row[i], i))[: quality.NEIGHBOURS]
        votes = [float(row[i]) ** quality.POWER for i in near]
        assert score == pytest.approx(sum(v for i, v in zip(near, votes, strict=True) if labels[i]) / sum(votes), abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables aren't here")
def test_held_out_on_the_given_tables(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    for out, label in ((quality.classify_quality(docs, labels), "quality"), (toxicity.classify_toxicity(docs, labels), "toxic")):
        held = out.filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
        assert np.mean([a == b for a, b in held]) > 0.93
