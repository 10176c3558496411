"""Where many short texts may stand in a few contigs, with some letters changed, inserted or deleted: seeds for whole batches.

A text is cut into stretches, some more than it may have errors.  Wherever it stands, all but `errors` of them stand
unchanged, so for every choice of stretches that are left out the others are one key, which is looked up among the keys of
all places of the contigs.  With insertions and deletions the kept stretches may be shifted against each other where one
between them is left out.  Such keys are long, so that few places are looked at that aren't hits; none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches beside those that errors may touch, and letters of a stretch at most.
SPARE, WIDEST = 3, 8
#: Letters that are compared at once.
CELLS = 1 << 21
#: Stands outside of all contigs; no letter has this code.
OUTSIDE = 0xFFFFFFFF
_COMPLEMENT = np.arange(128, dtype=np.uint32)
for _a, _b in zip(b"ACGTacgt", b"TGCAtgca", strict=True):
    _COMPLEMENT[_a] = _b
_ODD = np.uint64(0x9E3779B97F4A7C15)


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts one behind the other, and how many each has."""
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32), pc.utf8_length(texts).to_numpy(zero_copy_only=False)


def reverse_complement(rows: np.ndarray) -> np.ndarray:
    back = rows[:, ::-1]
    return np.where(back < 128, _COMPLEMENT[np.minimum(back, 127)], back)


def _shifts(held: tuple[int, ...], errors: int) -> Iterator[tuple[int, ...]]:
    """How far each kept stretch may stand from its place, if `errors` letters were inserted or deleted in all."""

    def go(k: int, now: int, left: int) -> Iterator[tuple[int, ...]]:
        if k == len(held):
            yield ()
            return
        free = left if held[k] - (held[k - 1] if k else -1) > 1 else 0
        for d in range(-free, free + 1):
            for rest in go(k + 1, now + d, left - abs(d)):
                yield (now + d, *rest)

    return go(0, 0, errors)


def keys_of(stretches: int, width: int, errors: int, gaps: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Offsets of each key's letters in a text, and from the place where it stands."""
    out = []
    for held in combinations(range(stretches), stretches - errors):
        own = np.concatenate([i * width + np.arange(width) for i in held])
        out += [(own, own + np.repeat(shift, width)) for shift in (_shifts(held, errors) if gaps else [(0,) * len(held)])]
    return out


def _hashed(letters: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for d in offsets.tolist():
        out = (out + letters[at + d].astype(np.uint64) + np.uint64(1)) * _ODD
        out ^= out >> np.uint64(29)
    return out


class Contigs:
    """Contigs (name, start, letters) in one text, and the keys of all their places."""

    def __init__(self, contigs: list[tuple], errors: int, gaps: bool):
        self.errors, self.gaps = errors, gaps
        room = np.full((errors + SPARE) * WIDEST + errors + 1, OUTSIDE, dtype=np.uint32)
        parts, owner, self.begin = [room], [np.full(len(room), -1)], np.zeros(len(contigs), dtype=np.int64)
        at = len(room)
        for i, (_, _, text) in enumerate(contigs):
            own = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            self.begin[i] = at
            parts += [own, room]
            owner += [np.full(len(own), i), np.full(len(room), -1)]
            at += len(own) + len(room)
        self.text, self.owner = np.concatenate(parts), np.concatenate(owner).astype(np.int32)
        self.end = self.begin + np.array([len(t) for *_, t in contigs], dtype=np.int64)
        self.places = np.flatnonzero(self.owner >= 0)
        self.found: dict[tuple[int, int], list] = {}

    def _index(self, stretches: int, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each key its offsets in a text, its values, where each one's places begin, and the places."""
        if (stretches, width) not in self.found:
            self.found.clear()  # one is held at a time
            out = []
            for own, there in keys_of(stretches, width, self.errors, self.gaps):
                mine = self.owner[self.places]
                good = self.places[(self.owner[self.places + there.min()] == mine) & (self.owner[self.places + there.max()] == mine)]
                key = _hashed(self.text, good, there)
                order = np.argsort(key, kind="stable")
                values, first = np.unique(key[order], return_index=True)
                out.append((own, values, np.append(first, len(key)), good[order].astype(np.int32)))
            self.found[stretches, width] = out
        return self.found[stretches, width]

    def near(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and places (in the text of all contigs) that share a key, each pair once; in parts, none of one row in two of them."""
        n, size = rows.shape
        stretches = min(self.errors + SPARE, size)
        index = self._index(stretches, min(size // stretches, WIDEST))
        flat, at = np.ascontiguousarray(rows).ravel(), np.arange(n, dtype=np.int64) * size
        met = []
        for own, values, first, places in index:
            if not len(values):
                continue
            key = _hashed(flat, at, own)
            slot = np.minimum(np.searchsorted(values, key), len(values) - 1)
            hit = np.flatnonzero(values[slot] == key)
            met.append((hit, first[slot[hit]], first[slot[hit] + 1], places))
        total = np.zeros(n, dtype=np.int64)
        for hit, a, b, _ in met:
            total[hit] += b - a
        most = max(1, CELLS // size)
        part = (np.cumsum(total) - total) // most  # which part each row is in
        for k in np.unique(part[total > 0]).tolist():
            pairs = []
            for hit, a, b, places in met:
                mine = part[hit] == k
                count = (b - a)[mine]
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                pairs.append(np.repeat(hit[mine], count) * len(self.text) + places[np.repeat(a[mine], count) + step])
            pair = np.unique(np.concatenate(pairs))
            yield pair // len(self.text), pair % len(self.text)

    def mismatches(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, places and differing letters wherever a row fits inside a contig with few enough of them."""
        size = rows.shape[1]
        for row, place in self.near(rows):
            inside = place + size <= self.end[self.owner[place]]
            row, place = row[inside], place[inside]
            differ = np.zeros(len(row), dtype=np.int32)
            for i in range(size):
                differ += rows[row, i] != self.text[place + i]
            good = differ <= self.errors
            yield row[good], place[good], differ[good]

    def edits(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and places where a row fits with few enough letters changed, inserted or deleted."""
        size, e = rows.shape[1], self.errors
        far = np.int16(2 * e + 2)
        for row, place in self.near(rows):
            left = self.end[self.owner[place]] - place
            short = left < size + e
            now = [np.where(left >= j - e, np.int16(j - e), far) if j >= e else np.full(len(row), far, dtype=np.int16) for j in range(2 * e + 1)]
            for i in range(1, size + 1):
                letter, after = rows[row, i - 1], []
                for j in range(2 * e + 1):
                    at = i + j - e  # letters of the contig that are used up
                    if at < 0:
                        after.append(np.full(len(row), far, dtype=np.int16))
                        continue
                    value = now[j] + (letter != self.text[np.minimum(place + at - 1, len(self.text) - 1)]).astype(np.int16) if at else np.full(len(row), far, dtype=np.int16)
                    if j < 2 * e:
                        value = np.minimum(value, now[j + 1] + np.int16(1))
                    if j:
                        value = np.minimum(value, after[j - 1] + np.int16(1))
                    value = np.minimum(value, far)
                    if short.any():
                        value[short & (left < at)] = far
                    after.append(value)
                now = after
            good = np.minimum.reduce(now) <= e
            yield row[good], place[good]


def groups(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and letters of texts of one length, in blocks."""
    flat, sizes = codes(texts)
    begin = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        for a in range(0, len(rows), step := max(1, CELLS // size)):
            part = rows[a : a + step]
            yield part, flat[begin[part, None] + np.arange(size)]
