"""Vectorised hashes of byte ranges and of word shingles."""

from __future__ import annotations

import numpy as np

from marginalia.llm.common import mix

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Pseudo-random words for each byte, and others for a second hash.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
OTHER_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i < n; kept and grown for each Python worker."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, b in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def prefix_sums(raw: np.ndarray, words: np.ndarray = BYTES) -> np.ndarray:
    """n + 1 sums of words[raw[i]] * BASE ** i; with them the hash of any range takes constant time."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(words[raw] * up[: len(raw)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal byte ranges have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the white-space-free words of each text, and the n + 1 numbers of words before each text."""
    gap = SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(~gap & (first[:-1] | np.concatenate(([True], gap[:-1]))))
    ends = np.flatnonzero(~gap & (first[1:] | np.concatenate((gap[1:], [True])))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles, A-Z lower-cased; with fewer words, of the whole sequence."""
    low = LOWER[raw]
    starts, ends, words = word_bounds(low, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    h = range_hash(prefix_sums(low), starts, ends)
    rolled = h[: max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        rolled = mix(rolled * BASE + h[k : len(h) - size + 1 + k])
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            one = h[a : a + 1]
            for k in range(a + 1, b):
                one = mix(one * BASE + h[k])
            out.append(mix(one + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class KeyTable:
    """Open addressing in numpy: the position of each key in a sorted array, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full((1 << self.bits) + 64, -1, np.int32)
        todo, step = np.arange(len(keys)), 0
        slot = self._slot(keys)
        while len(todo):
            free = self.slots[slot[todo] + step] < 0
            want = todo[free]
            self.slots[slot[want] + step] = want  # of several keys for a slot the last stays
            lost = self.slots[slot[todo] + step] != todo
            todo = todo[lost]
            step += 1
            if step >= 64 and len(todo):
                self.bits += 1
                self.slots = np.full((1 << self.bits) + 64, -1, np.int32)
                todo, step, slot = np.arange(len(keys)), 0, self._slot(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys) or not len(keys):
            return out
        todo, slot = None, self._slot(keys)
        for step in range(64):
            here = self.slots[slot + step]
            hit = (self.keys[np.maximum(here, 0)] == keys) & (here >= 0)
            if todo is None:
                out[hit] = here[hit]
            else:
                out[todo[hit]] = here[hit]
            more = ~hit & (here >= 0)
            if not more.any():
                break
            todo = np.flatnonzero(more) if todo is None else todo[more]
            keys, slot = keys[more], slot[more]
        return out
