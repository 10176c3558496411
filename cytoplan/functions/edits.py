"""Edit distances of many reads against stretches of a reference that begin at a given place, and how they come about."""

from __future__ import annotations

import numpy as np

#: Cells whose origins are held at once.
CELLS = 1 << 22
_FAR = 1 << 20
# where a cell's value comes from
MATCH, INSERTED, DELETED = 0, 1, 2


def _padded(texts: list[bytes], filler: int) -> np.ndarray:
    sizes = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(sizes.max(initial=0))), filler, dtype=np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return out


def fits(reads: list[bytes], stretches: list[bytes], errors: int) -> tuple[np.ndarray, list[str]]:
    """Fewest edits of each read against the stretch's beginning (`errors` + 1 if there are more), and the CIGAR.

    The read is used up, the stretch as far as it is best; of equal ends the one nearest the beginning.  A letter of both
    comes before one that is inserted, and that before one that is deleted.
    """
    edits, cigars = np.full(len(reads), errors + 1, dtype=np.int64), [""] * len(reads)
    order = sorted((i for i in range(len(reads)) if reads[i]), key=lambda i: len(reads[i]))
    while order:
        longest = len(reads[order[-1]])
        n = max(1, min(len(order), CELLS // ((longest + 1) * (2 * errors + 1))))
        order, part = order[:-n], order[-n:][::-1]
        found, texts = _block([reads[i] for i in part], [stretches[i] for i in part], errors)
        edits[part] = found
        for i, text in zip(part, texts, strict=True):
            cigars[i] = text
    return edits, cigars


def _block(reads: list[bytes], stretches: list[bytes], errors: int) -> tuple[np.ndarray, list[str]]:
    """Reads stand longest first; cell j of row i is letter i of the read and place i + j - errors of the stretch."""
    sizes = np.array([len(r) for r in reads])
    longest, width, n = int(sizes[0]), 2 * errors + 1, len(reads)
    read = _padded(reads, 1)
    held = np.full((n, longest + 2 * errors + 1), 0, dtype=np.uint8)  # 0 stands outside
    text = _padded([s[: longest + errors] for s in stretches], 0)
    held[:, errors : errors + text.shape[1]] = text
    now = np.where(np.arange(width) >= errors, np.arange(width) - errors, _FAR) * np.ones((n, 1), dtype=np.int64)
    # places beyond a stretch's end can't be reached
    size = np.array([len(s) for s in stretches])
    now[np.arange(width) - errors > size[:, None]] = _FAR
    origin = np.zeros((longest + 1, n, width), dtype=np.uint8)
    origin[0] = DELETED
    best, at = np.full(n, _FAR, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in range(1, longest + 1):
        a = int(np.searchsorted(-sizes, -i, side="right"))
        before = now[:a]
        here = held[:a, i - 1 : i - 1 + width]
        across = before + (here != read[:a, i - 1, None])
        across[here == 0] = _FAR
        inserted = np.full((a, width), _FAR, dtype=np.int64)
        inserted[:, :-1] = before[:, 1:] + 1
        value = np.minimum(across, inserted)
        came = np.where(across <= inserted, MATCH, INSERTED)
        place = i + np.arange(width) - errors
        value[(place < 0) | (place > size[:a, None])] = _FAR
        for j in range(1, width):
            gone = value[:, j - 1] + 1
            less = (gone < value[:, j]) & (place[j] >= 0) & (place[j] <= size[:a])
            value[less, j], came[less, j] = gone[less], DELETED
        now = np.minimum(value, _FAR)
        origin[i, :a] = came
        done = np.flatnonzero(sizes[:a] == i)
        best[done], at[done] = now[done].min(axis=1), now[done].argmin(axis=1)
    cigars = []
    for r in range(n):
        if best[r] > errors:
            cigars.append("")
            continue
        i, j, ops = int(sizes[r]), int(at[r]), []
        while i > 0 or j > errors:
            came = origin[i, r, j]
            ops.append("MID"[came])
            if came == MATCH:
                i -= 1
            elif came == INSERTED:
                i, j = i - 1, j + 1
            else:
                j -= 1
        runs: list[list] = []
        for op in reversed(ops):
            if runs and runs[-1][1] == op:
                runs[-1][0] += 1
            else:
                runs.append([1, op])
        cigars.append("".join(f"{k}{op}" for k, op in runs))
    return np.minimum(best, errors + 1), cigars
