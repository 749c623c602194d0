"""Word shingles of whole texts as 64-bit hashes, in numpy inside tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

#: Words in a shingle, and the share of shingles in common that makes texts near duplicates (as a fraction).
WIDTH = 5
SIMILAR = (75, 100)
#: Words remembered at most, by a task.
MEMO_WORDS = 100_000
_MULTIPLIER, _FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """word -> hash: the memory of a task, bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = h
        return h


def word_hashes(text: str | None, memory: Words | None = None) -> np.ndarray:
    """A hash for each word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map((Words() if memory is None else memory).__getitem__, words), np.uint64, len(words))


def shingle_hashes(text: str | None, width: int = WIDTH, memory: Words | None = None) -> np.ndarray:
    """A hash for each shingle in the order of the text; a shorter text is one shingle, one without words has none."""
    w = word_hashes(text, memory)
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    h = w[:n] + np.uint64(min(len(w), width))
    for i in range(1, min(len(w), width)):
        h = h * _MULTIPLIER + w[i : i + n]
    h ^= h >> np.uint64(32)
    h *= _FINAL
    h ^= h >> np.uint64(29)
    return h


def shingle_set(text: str | None, width: int = WIDTH, memory: Words | None = None) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, width, memory))


def minima(sets: Sequence[np.ndarray], registers: int, seed: int = 1) -> np.ndarray:
    """For each non-empty set, the least of each of so many hash functions over it: uint64, one row for each set."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**64 - 1, registers, dtype=np.uint64)
    out = np.empty((len(sets), registers), np.uint64)
    first = 0
    while first < len(sets):  # so many sets at a time that their hashes stay in the processor's cache
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 60_000):
            size += len(sets[last])
            last += 1
        h = np.concatenate(sets[first:last])
        h = h ^ (h >> np.uint64(31))
        at = np.cumsum([0, *map(len, sets[first : last - 1])])
        buf = np.empty_like(h)
        for i in range(registers):
            np.multiply(h, odd[i], out=buf)
            np.add(buf, add[i], out=buf)
            out[first:last, i] = np.minimum.reduceat(buf, at)
        first = last
    return out
