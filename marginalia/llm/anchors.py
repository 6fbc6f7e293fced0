"""Content-defined runs of windows: equal windows of `window` bytes fall into runs with one hash, wherever they stand."""

from __future__ import annotations

import numpy as np

from marginalia.llm.common import mix, ragged
from marginalia.llm.hashing import BASE, OTHER_BYTES, prefix_sums, range_hash


def _slide(values: np.ndarray, width: int, best: np.ufunc, pad: np.uint64) -> np.ndarray:
    """best over values[i : i + width] for every i, in blocks of width: a suffix scan of one block and a prefix scan of the next."""
    n = len(values)
    blocks = -(-(n + width - 1) // width) + 1
    full = np.full(blocks * width, pad, values.dtype)
    full[:n] = values
    grid = full.reshape(blocks, width)
    ahead = best.accumulate(grid, axis=1).ravel()
    back = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], ahead[width - 1 : n + width - 1])


def runs(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts the window starts of each text into runs whose windows have one least gram hash.

    Returns for each run its text, first window, number of windows, that hash, two independent hashes of all its
    bytes, and whether the gram occurs in it more than once, so that windows of the run itself may be equal.
    """
    sums = prefix_sums(raw)
    n = len(raw) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    at = np.arange(len(raw) - gram + 1)
    h = range_hash(sums, at, at + gram) | np.uint64(1)
    width = window - gram + 1
    least = _slide(h, width, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))[:n]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = text[:n] == text[window - 1 :]
    least[~whole] = 0  # windows that cross texts
    edge = np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1])))
    start = np.flatnonzero(edge)
    count = np.diff(np.append(start, n))
    keep = least[start] != 0
    number = np.cumsum(edge) - 1
    # A gram is the least of some window if it is the greatest least hash of the windows that hold it.
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(len(h) - n, np.uint64)))
    chosen = np.flatnonzero(_slide(padded, width, np.maximum, np.uint64(0))[: len(h)] == h)
    # At a distance of width the window after the last that holds one use holds the next, so the run goes on.
    again = (np.diff(chosen) <= width) & (h[chosen[1:]] == h[chosen[:-1]]) & (text[chosen[1:]] == text[chosen[:-1]])
    later = chosen[1:][again]
    double = np.zeros(len(start), bool)
    double[number[np.maximum(later - (width - 1), offsets[text[later]])]] = True
    start, count, double = start[keep], count[keep], double[keep]
    end = start + count + window - 1
    return text[start], start, count, least[start], range_hash(sums, start, end), range_hash(prefix_sums(raw, OTHER_BYTES), start, end), double


def parts(raw: np.ndarray, begin: np.ndarray, length: np.ndarray, window: int, gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts runs, given by their bytes, into parts whose windows have the first least gram at nearly one offset: within a class of `width` offsets.

    All windows of a class share `window - width + 1` bytes around the gram; equal windows are of one class and share them too.
    Returns for each part its run, first window in the run, number of windows, the hash of class and shared bytes, and two
    independent hashes of all its bytes.
    """
    none = np.zeros(0, np.int64)
    if not len(begin):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    text = raw[ragged(begin, length)]
    sums = prefix_sums(text)
    first = np.cumsum(length) - length
    grams = length - gram + 1
    at = ragged(first, grams)
    h = range_hash(sums, at, at + gram)
    least = np.minimum.reduceat(h, np.cumsum(grams) - grams)
    place = at[h == np.repeat(least, grams)]
    windows = length - window + 1
    owner = np.repeat(np.arange(len(begin)), windows)
    start = ragged(first, windows)
    anchor = place[np.searchsorted(place, start)]
    kind = (anchor - start) // width
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(kind) != 0) | (np.diff(owner) != 0))))
    count = np.diff(np.append(edge, len(start)))
    owner, start, shared, kind = owner[edge], start[edge], (anchor - kind * width)[edge], kind[edge]
    key = mix(range_hash(sums, shared, shared + window - width + 1) + kind.astype(np.uint64) * BASE)
    end = start + count + window - 1
    return owner, start - first[owner], count, key, range_hash(sums, start, end), range_hash(prefix_sums(text, OTHER_BYTES), start, end)
