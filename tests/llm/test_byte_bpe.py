from __future__ import annotations

import random
import re
import tracemalloc
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from cytoplan.llm import byte_bpe
from cytoplan.llm._store import tidied, trim
from cytoplan.llm.byte_bpe import Encoder, PairTable, decode, encode, merge, merge_forest, read_ranks

from .helpers import ODD, frame

RANKS = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("alphabet", ["ab", "aeinst", "0123456789", "äöüß€漢😀", " \n\t"])
def test_merge_is_the_librarys(alphabet):
    rng = random.Random(4)
    for n in (1, 2, 3, 5, 17, 200, 3000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert merge(text.encode(), RANKS) == REFERENCE._core_bpe.encode_single_piece(text.encode())


@pytest.mark.parametrize("alphabet", ["ab", "aeinst", "0123456789", "äöüß€漢😀", " \n\t"])
@pytest.mark.parametrize("width", [2, 4, 8, 32, 64])
def test_forest_is_the_librarys(alphabet, width):
    rng = random.Random(width)
    table = PairTable(RANKS)
    pieces = []
    while len(pieces) < 200:
        raw = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, width + 1))).encode()
        if 2 <= len(raw) <= width and raw not in RANKS:
            pieces.append(raw)
        elif width < 4:
            pieces.append(bytes([rng.randrange(256), rng.randrange(256)]))
            if pieces[-1] in RANKS:
                pieces.pop()
    for raw, packed in zip(pieces, merge_forest(pieces, width, table), strict=True):
        ids = [int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)]
        assert ids == REFERENCE._core_bpe.encode_single_piece(raw)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    monkeypatch.setattr(byte_bpe, "CHARACTERS", 400)
    monkeypatch.setattr(byte_bpe, "BLOCK", 7)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("aeinstz") for _ in range(rng.randrange(1, 90))) for _ in range(rng.randrange(60))) for _ in range(60)]
    encoder = Encoder(RANKS, public_tokenizers.PATTERN)
    for text, packed in zip(texts, encoder.encode_all(texts), strict=True):
        assert [int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)] == REFERENCE.encode_ordinary(text)
        assert len(encoder) <= 50


def test_memory_follows_a_block_of_texts():
    """4 MB of words that are mostly new: only about a block of their pieces is held at once."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("aeinstz", k=rng.randrange(2, 9))) for _ in range(700)) for _ in range(1000)]
    encoder = Encoder(RANKS, public_tokenizers.PATTERN)
    tracemalloc.start()
    try:
        packed = encoder.encode_all(texts)
        peak = tracemalloc.get_traced_memory()[1] - sum(map(len, packed))
    finally:
        tracemalloc.stop()
    for text, ids in zip(texts[::50], packed[::50], strict=True):
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == REFERENCE.encode_ordinary(text)
    assert peak < 40 << 20


def test_other_maps_drop_the_encoder():
    docs = pa.RecordBatch.from_pydict({"text": ["one"]})
    made = byte_bpe.in_worker("a call", lambda: Encoder({}, public_tokenizers.PATTERN))
    assert list(tidied(lambda batches: batches, shares=True)(iter([docs]))) == [docs]
    assert byte_bpe.in_worker("a call", dict) is made
    assert list(tidied(lambda batches: batches)(iter([docs]))) == [docs]
    assert byte_bpe.in_worker("a call", dict) == {}


def test_trim_hands_memory_back():
    def own() -> float:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    held = [bytes(1000) for _ in range(100_000)]
    del held[:-1]  # the last one keeps the heap's top
    before = own()
    trim()
    assert before - own() > 50


def test_very_long_texts(spark):
    """20 MB of words, and a word of 200,000 letters."""
    rng = random.Random(2)
    words = ["".join(rng.choice("aeinst") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    rows = [(1, " ".join(rng.choices(words, k=3_200_000))), (2, "".join(rng.choices("abc", k=200_000)))]
    got = {r.doc_id: r.ids for r in encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in rows:
        want = b"".join(x.to_bytes(4, "little") for x in REFERENCE.encode_ordinary(text))
        assert bytes(got[i]) == want


def test_round_trip(spark):
    rows = [*ODD, (30, "It's <|endoftext|>, isn't it?  Two  spaces\r\n\r\nand 12345 ..."), (31, "the " * 3000)]
    out = decode(encode(frame(spark, rows).withColumnRenamed("lang", "decoded"), RANKS, public_tokenizers.PATTERN), RANKS)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        ids = [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
        assert ids == REFERENCE.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_empty(spark):
    assert encode(frame(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []
