"""The pipeline against a version written out by hand, on small tables."""

from __future__ import annotations

import struct

import public_tokenizers
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from cytoplan.llm import toxicity  # noqa: E402
from cytoplan.llm._labels import labelled_sample  # noqa: E402
from cytoplan.llm.byte_bpe import read_ranks  # noqa: E402

from .helpers import frame, prose  # noqa: E402
from .test_classifiers import LABELS, corpus  # noqa: E402
from .test_decontaminate import tiles_by_hand, words  # noqa: E402
from .test_exact_dedup import FOLD  # noqa: E402
from .test_near_dedup import classes_by_hand  # noqa: E402


def write(spark, folder, rows, labels, items):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def by_hand(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    toxic, plain, rest = toxicity.split(labelled_sample(docs, labels, "toxic", {0: toxicity.ORDINARY_DOCS, 1: toxicity.TOXIC_DOCS}))
    if toxic and plain and len(rest):
        model = toxicity.dictionaries(toxic, plain)
        distance = toxicity.Distance(model.ordinary, model.toxic)
        found = [distance.features(toxicity.normalised(t)) for t in rest["text"].to_pylist()]
        toxicity.calibrate(model, __import__("numpy").array(found), rest["label"].to_numpy())
        distance = toxicity.Distance(model.ordinary, model.toxic)
        rows = {(i, t) for i, t in rows if model.scores(__import__("numpy").array([distance.features(toxicity.normalised(t))]))[0] < 0.5}
    best = {}
    for i, t in rows:
        text = (t or "").translate(FOLD)
        best[text] = max(best.get(text, -1), i)
    rows = sorted((i, t) for i, t in rows if best[(t or "").translate(FOLD)] == i)
    stay = {min(c) for c in classes_by_hand(rows)}
    rows = [(i, t) for i, t in rows if i in stay]
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [(i, t) for i, t in rows if not any(x and tiles_by_hand(words(t), x, min(5, len(x)))[0] >= 0.6 * len(x) for x in items)]
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    return {i: coder.encode_ordinary(t or "") for i, t in clean}


def test_pipeline(spark, tmp_path):
    rows, labels = corpus(120)
    item = " ".join(prose(30, 77, 5000))
    extra = [
        (500, "A copy of this text, word for word, in full"),
        (501, "a copy of this text, word for word, in full"),
        (510, " ".join(prose(120, 8))),
        (511, " ".join([*prose(120, 8)[:119], "changed"])),
        (520, f"before {item} after"),
        (530, None),
        (531, ""),
    ]
    folder = write(spark, tmp_path, [*rows, *extra], labels, [(1, item), (2, None)])
    got = {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in corpus_pipeline.run(spark, folder).collect()}
    want = by_hand(spark, folder)
    assert got == want
    assert 501 in got and 500 not in got and (510 in got) != (511 in got) and 520 not in got


def test_stages_keep_the_columns(spark, tmp_path):
    rows, labels = corpus(40)
    folder = write(spark, tmp_path, rows, labels, [(1, "nothing of the kind stands there at all")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, folder).columns) == sorted(docs.columns)


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null ids and texts, repeated rows and ids, a long text, and columns named like those of the stages."""
    from pyspark.sql import functions as F

    long = " ".join(prose(400_000, 3, 9000))
    rows = [(None, None), (None, ""), (None, "a text whose id is missing"), (1, "one two three"), (1, "one two three"), (1, "something else"), (2, "One Two Three"), (3, long), (4, long + " end")]
    docs = frame(spark, rows).withColumns({n: F.lit(7) for n in ("n_tokens", "ids", "hits", "_key", "_lost", "_name", "score", "class_id", "a.b")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind stands there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, [None, None, 1, 2, 3]))
    assert all(r["hits"] == r["a.b"] == r["score"] == 7 and r.lang == "en" and r.n_tokens == len(r.ids) // 4 for r in got)


def test_empty(spark, tmp_path):
    folder = write(spark, tmp_path, [], [(1, 1, 1)], [(1, "x")])
    assert corpus_pipeline.run(spark, folder).collect() == []
