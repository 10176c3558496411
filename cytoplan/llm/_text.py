"""Array code for whole batches of texts: words, word hashes and word shingles.

Everything here works on one Arrow batch inside a Spark task.  Words are maximal runs of ASCII letters,
digits and bytes from 0x80 on, A-Z lower-cased; all else separates.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are handled at once inside a task; a single longer text is handled alone.
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_FOLD = bytes(int(_LOWER[c]) if _WORD[c] else 32 for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for n positions."""
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 8 * CHUNK_BYTES:  # of a very long text: not kept
            return up, down
        _powers.update(n=size, up=up, down=down)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together stay within the limit; a longer text comes alone."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + 32768, rows)
        yield start, end
        start = end


def cut_between(data: np.ndarray, inside: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Begin and end of pieces of a long text of about so many bytes, none of which ends inside a word."""
    begin = 0
    while begin < len(data):
        end = min(begin + size, len(data))
        while end < len(data) and inside[data[end]]:
            gap = np.flatnonzero(~inside[data[end : end + size]])
            end = end + int(gap[0]) if len(gap) else min(end + size, len(data))
        yield begin, end
        begin = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words each text has."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = table[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    borders = offsets[1:-1]
    borders = np.unique(borders[(borders > 0) & (borders < len(data))])
    cut = borders[(inside[borders] == 1) & (inside[borders + 1] == 1)]  # words that would run on into the next text
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, A-Z lower-cased (prefix sums of a polynomial modulo 2**64)."""
    up, down = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has; a long text is read in pieces that end between words."""
    if len(data) <= 2 * CHUNK_BYTES or len(offsets) != 2:
        starts, ends, counts = word_spans(data, offsets, table)
        return hash_spans(data, starts, ends), counts
    out, start = [], 0
    while start < len(data):
        end = min(start + CHUNK_BYTES, len(data))
        while end < len(data) and table[data[end]]:
            gap = np.flatnonzero(~table[data[end : end + CHUNK_BYTES]])
            end = end + int(gap[0]) if len(gap) else min(end + CHUNK_BYTES, len(data))
        piece = data[start:end]
        starts, ends, _ = word_spans(piece, np.array([0, len(piece)]), table)
        out.append(hash_spans(piece, starts, ends))
        start = end
    found = np.concatenate(out)
    return found, np.array([len(found)])


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens between white space (space, 0x09-0x0D), and how many each text has."""
    return word_hashes(data, offsets, ~_SPACE)


def words_of(text: str | None) -> list[bytes]:
    """The words themselves."""
    return (text or "").encode().translate(_FOLD).split()


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of each text's runs of `width` words, and how many each text has.

    A text of fewer words gives one shingle of all its words, a text without words none.
    """
    n = len(words)
    rolled = np.zeros(n, dtype=np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for i in range(width):
        rolled[: max(0, n - i)] = rolled[: max(0, n - i)] * factor + words[i:]
    ends = np.cumsum(counts)
    first = ends - counts
    full = np.maximum(counts - width + 1, 0)
    keep = np.zeros(n + 1, dtype=np.int32)
    np.add.at(keep, first[full > 0], 1)
    np.add.at(keep, (first + full)[full > 0], -1)
    out = mix(rolled[np.cumsum(keep[:-1]) > 0])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return out, full
    number = full.copy()
    number[short] = 1
    whole = []
    for i in short:
        h = np.uint64(0)
        for w in words[first[i] : ends[i]]:
            h = np.uint64((int(h) * int(factor) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        whole.append(h)
    where = np.cumsum(number) - number
    result = np.empty(int(number.sum()), dtype=np.uint64)
    is_short = np.zeros(len(result), dtype=bool)
    is_short[where[short]] = True
    result[~is_short] = out
    result[is_short] = mix(np.array(whole, dtype=np.uint64))
    return result, number
