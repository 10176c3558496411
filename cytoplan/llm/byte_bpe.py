"""Byte-level BPE encoding and decoding.

A text is cut by the vocabulary's pattern and every piece is merged on its own.  A segment tree over the piece's
bytes holds, at each live position, the rank of the pair that starts there and, above, the leftmost smallest rank.
A merge is taken from the root and changes three leaves: the pair's own, the one of the token that vanished and the
one of the live neighbour before, each in logarithmic time; a piece of n bytes takes O(n log n).

Pieces that a worker hasn't met are merged together: those of about one length form a forest of equally wide trees,
one column for each piece, and every step takes all roots at once and updates three leaves of each, level by level.
Long pieces, of which there are few, are merged one by one on the same kind of tree.

Both directions are Arrow maps without a shuffle; ids travel as little-endian unsigned 32-bit integers.

Defined cases
-------------
* A null text counts as empty: no ids, no bytes.  Very long texts are cut piece by piece, so that only one block of
  pieces is held at once; a very long piece takes 24 bytes a byte.  Special tokens are not known: their strings are
  ordinary text.
* Rows are independent: repeated rows, ties and null ids change nothing.  Empty tables give empty results.
* Other columns stay; `ids` (and `decoded`) are added and replace columns of the same name.
"""

from __future__ import annotations

import base64
import itertools
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._store import in_worker, plain, small_batches, tidied

#: Pieces that a worker remembers, and the bytes of the longest of them.
REMEMBERED, LONGEST = 1 << 16, 64
#: Pieces that are held at once of a text, and characters of texts that are cut together.
BLOCK, CHARACTERS = 1 << 16, 1 << 18
#: Pieces of a forest at most, and at least; the widest tree in a forest.
FOREST, GROVE, WIDEST = 1 << 15, 24, 64

_NONE = np.int64(1) << np.int64(62)


def load_ranks(lines: Iterable[str]) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    pairs = (line.split() for line in lines if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file that lies beside the driver (under 2 MB); tasks get them by broadcast."""
    with open(path) as lines:
        return load_ranks(lines)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << max(0, n - 1).bit_length()
    none = int(_NONE)
    tree = array("q", [none]) * (2 * width)
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank << 32 | i  # equal ranks: the leftmost is smallest
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    def pair(i: int) -> int:
        j = after[i]
        rank = ranks.get(piece[i : after[j]]) if j < n else None
        return none if rank is None else rank << 32 | i

    while tree[1] != none:
        i = tree[1] & 0xFFFFFFFF
        gone = after[i]
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PairTable:
    """Rank of the token that two neighbouring tokens make up, for whole arrays of pairs: a table of open addresses."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes = np.full(256, -1, dtype=np.int64)
        keys, made = [], []
        for token, rank in ranks.items():
            if len(token) == 1:
                self.bytes[token[0]] = rank
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.made = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, _NONE, dtype=np.int64)
        todo, values = np.array(keys, dtype=np.int64), np.array(made, dtype=np.int64)
        at = self._first(todo)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = todo[free]  # of those that meet here one stays
            held = self.keys[at] == todo
            self.made[at[held]] = values[held]
            todo, values, at = todo[~held], values[~held], (at[~held] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, _NONE where two tokens make up none."""
        keys = left << 32 | right
        at = self._first(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.made[at], _NONE)
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            at = (at[more] if len(at) != len(more) else at) + 1 & self.mask
            there = self.keys[at]
            found = there == keys[more]
            out[more[found]] = self.made[at[found]]
            on = ~found & (there >= 0)
            more, at = more[on], at[on]
        return out


def merge_forest(pieces: list[bytes], width: int, table: PairTable) -> list[bytes]:
    """Packed ids of pieces of 2 to `width` bytes (a power of two), merged in step; every byte has a rank."""
    n, levels = len(pieces), width.bit_length() - 1
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    row = np.repeat(np.arange(n), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # ident, after and before of (place, piece) stand at place * n + piece; place `width` is beyond the end
    ident = np.full((width + 1) * n, -1, dtype=np.int64)
    ident[place * n + row] = table.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    after = np.repeat(np.arange(1, width + 2), n)
    before = np.repeat(np.arange(-1, width), n)
    tree = np.full(2 * width * n, _NONE, dtype=np.int64)
    places = np.arange(width - 1)
    left, right = ident[: (width - 1) * n], ident[n : width * n]
    live = np.flatnonzero(right >= 0)
    first = table.rank(left[live], right[live])
    tree[width * n + live] = np.where(first < _NONE, first << 8 | np.repeat(places, n)[live], _NONE)
    for k in range(width - 1, 0, -1):
        np.minimum(tree[2 * k * n : (2 * k + 1) * n], tree[(2 * k + 1) * n : (2 * k + 2) * n], out=tree[k * n : (k + 1) * n])
    at = np.flatnonzero(tree[n : 2 * n] < _NONE)
    while len(at):
        root = tree[n + at]
        i, made = root & 255, root >> 8
        here = i * n + at
        gone = after[here]
        then = after[gone * n + at]
        after[here], before[then * n + at], ident[here] = then, i, made
        prior = before[here]
        following = ident[then * n + at]  # -1 beyond the end
        has_next, has_prior = np.flatnonzero(following >= 0), np.flatnonzero(prior >= 0)
        on, back = np.full(len(at), _NONE), np.full(len(at), _NONE)
        ranks = table.rank(np.concatenate([made[has_next], ident[prior[has_prior] * n + at[has_prior]]]), np.concatenate([following[has_next], made[has_prior]]))
        on[has_next], back[has_prior] = ranks[: len(has_next)], ranks[len(has_next) :]
        leaves = np.concatenate([gone, i, prior[has_prior]]) + width
        column = np.concatenate([at, at, at[has_prior]])
        values = np.concatenate([np.full(len(at), _NONE), np.where(on < _NONE, on << 8 | i, _NONE), np.where(back < _NONE, back << 8 | prior, _NONE)[has_prior]])
        tree[leaves * n + column] = values
        for _ in range(levels):
            leaves >>= 1
            below = 2 * leaves * n + column
            tree[leaves * n + column] = np.minimum(tree[below], tree[below + n])
        at = at[tree[n + at] < _NONE]
    # what is left stands at the places that are reached from the first
    alive = np.zeros((width + 1) * n, dtype=bool)
    at, i = np.arange(n), np.zeros(n, dtype=np.int64)
    while len(at):
        alive[i * n + at] = True
        i = after[i * n + at]
        on = i < lengths[at]
        at, i = at[on], i[on]
    by_piece = np.ascontiguousarray(alive[: width * n].reshape(width, n).T)
    ids = ident[: width * n].reshape(width, n).T[by_piece].astype("<u4").tobytes()
    cuts = np.concatenate([[0], np.cumsum(by_piece.sum(axis=1))]) * 4
    cuts = cuts.tolist()
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Encoder(dict):
    """Remembers the packed ids of short pieces, and forgets the older half when it holds too many."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self.table = ranks, regex.compile(pattern), PairTable(ranks)
        self.all_bytes = bool((self.table.bytes >= 0).all())

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of pieces that aren't known yet; the short ones are remembered."""
        known: dict[str, bytes] = {}
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                known[piece] = whole.to_bytes(4, "little")
            else:
                groups.setdefault(max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for bits, members in groups.items():
            for k in range(0, len(members), FOREST):
                part = members[k : k + FOREST]
                if self.all_bytes and len(part) >= GROVE and 1 << bits <= WIDEST:
                    merged = merge_forest([raw for _, raw in part], 1 << bits, self.table)
                else:
                    merged = [np.array(merge(raw, self.ranks), dtype="<u4").tobytes() for _, raw in part]
                known.update(zip((piece for piece, _ in part), merged, strict=True))
        if len(self) + len(known) > REMEMBERED:
            for piece in list(itertools.islice(self, max(len(self) // 2, len(self) + len(known) - REMEMBERED))):
                del self[piece]
        room = REMEMBERED - len(self)
        self.update(itertools.islice(((p, x) for p, x in known.items() if len(p) <= LONGEST), room))
        return known

    def pack(self, cut: list[list[str]]) -> list[bytes]:
        """Packed ids of texts that are cut into pieces."""
        asked = set().union(*cut)
        unseen = asked.difference(self)
        seen = {p: self[p] for p in asked.difference(unseen)}
        seen.update(self.learn(sorted(unseen)))
        return [b"".join(map(seen.__getitem__, pieces)) for pieces in cut]

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        held: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) <= CHARACTERS:
                held.append(self.pattern.findall(text))
                size += len(text)
                if size > CHARACTERS:
                    out += self.pack(held)
                    held, size = [], 0
                continue
            out += self.pack(held)
            held, size = [], 0
            pieces, blocks = (m.group() for m in self.pattern.finditer(text)), []
            while block := list(itertools.islice(pieces, BLOCK)):
                blocks += self.pack([block])
            out.append(b"".join(blocks))
        return out + self.pack(held)


def _encoder(name: str, shared: Broadcast, pattern: str) -> Encoder:
    """The encoder of this worker: tasks of one call share what it remembers."""
    return in_worker(name, lambda: Encoder(shared.value, pattern))


def _mapped(df: DataFrame, read: str, name: str, convert: Callable[[], Callable[[pa.Array], list[bytes]]]) -> DataFrame:
    """The table with a binary column `name` (in place of one of that name), made of the column `read` batch by batch."""
    small_batches(df.sparkSession)
    rows, at = plain(df), df.columns.index(read)
    left = [i for i, c in enumerate(df.columns) if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = convert()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in left), pa.array(call(batch.column(at)), pa.binary())], names=[*(f"c{i}" for i in left), "made"])

    schema = T.StructType([*(rows.schema[i] for i in left), T.StructField("made", T.BinaryType())])
    return rows.mapInArrow(tidied(run, shares=True), schema).toDF(*(df.columns[i] for i in left), name)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Adds `ids` to the documents."""
    shared, name = docs.sparkSession.sparkContext.broadcast(ranks), uuid.uuid4().hex

    def convert() -> Callable[[pa.Array], list[bytes]]:
        encoder = _encoder(name, shared, pattern)
        return lambda texts: encoder.encode_all(t.as_py() or "" for t in texts)

    return _mapped(docs, "text", "ids", convert)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds `decoded`, the bytes that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def convert() -> Callable[[pa.Array], list[bytes]]:
        tokens = [b""] * (max(shared.value.values(), default=-1) + 1)
        for token, rank in shared.value.items():
            tokens[rank] = token
        return lambda ids: [b"".join(map(tokens.__getitem__, np.frombuffer(x.as_py() or b"", dtype="<u4").tolist())) for x in ids]

    return _mapped(encoded, "ids", "decoded", convert)
