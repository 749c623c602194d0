"""Suffix arrays by induced sorting, in numpy, and permuted longest common prefixes.

The text's suffixes are classified as smaller (S) or larger (L) than the next one; the leftmost S of each run starts a
substring. These substrings are sorted by one round of inducing, named, and where names repeat the string of names is
sorted in turn in the same way. A second round induces all suffixes from them. Inducing by bytes goes bucket by bucket,
a whole run of a bucket's entries at a time; by names, of which there are too many for that, entry by entry.
"""

from __future__ import annotations

from array import array

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; s ends with its only 0."""
    step = np.sign(np.diff(s))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    return np.append(step[np.minimum(following, len(step) - 1)] > 0, True) if len(step) else np.array([True])


class _Inducer:
    def __init__(self, s: np.ndarray, is_s: np.ndarray) -> None:
        self.s, self.sigma = s, 257
        self.wanted = {True: is_s.copy(), False: ~is_s}
        self.wanted[True][-1] = False
        sizes = np.bincount(s, minlength=self.sigma)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.n_l = np.bincount(s[~is_s], minlength=self.sigma)

    def _place(self, sa: np.ndarray, batch: np.ndarray, to_s: bool, at: np.ndarray) -> None:
        """Puts the suffixes before those of batch, if of the wanted type, at their buckets' next places."""
        j = batch - 1  # before the first place comes the end, which is of neither wanted kind
        j = j[self.wanted[to_s][j]]
        if not len(j):
            return
        c = self.s[j]
        order = np.argsort(c, kind="stable")
        c, j = c[order], j[order]
        counts = np.bincount(c, minlength=self.sigma)
        rank = np.arange(len(c)) - (np.cumsum(counts) - counts)[c]
        if to_s:
            sa[at[c] - 1 - rank] = j
            at -= counts
        else:
            sa[at[c] + rank] = j
            at += counts

    def __call__(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, given the leftmost S suffixes in their order."""
        sa = np.full(len(self.s), -1, np.int32)
        c = self.s[lms]
        order = np.argsort(c, kind="stable")
        counts = np.bincount(c, minlength=self.sigma)
        seeds = np.split(lms[order], np.cumsum(counts)[:-1])
        head = self.start.copy()
        used = np.flatnonzero(self.end > self.start)
        for b in used.tolist():
            done = int(self.start[b])
            while done < head[b]:
                batch, done = sa[done : head[b]], int(head[b])
                self._place(sa, batch, False, head)
            if len(seeds[b]):
                self._place(sa, seeds[b], False, head)
        tail = self.end.copy()
        sa[0], tail[0] = len(self.s) - 1, 0
        for b in used[::-1].tolist():
            done = int(self.end[b])
            while tail[b] < done:
                batch, done = sa[tail[b] : done][::-1], int(tail[b])
                self._place(sa, batch, True, tail)
            larger = sa[self.start[b] : self.start[b] + self.n_l[b]][::-1]
            if len(larger):
                self._place(sa, larger, True, tail)
        return sa


class _NameInducer:
    """The same for a string of names, whose buckets are about as many as its entries: entry by entry."""

    def __init__(self, s: np.ndarray, is_s: np.ndarray) -> None:
        self.s, self.sizes = s, np.bincount(s)
        self.end = np.cumsum(self.sizes)
        # what stands before each place: its name and one, negative if S, 0 where nothing does
        before = np.where(is_s[:-1], -1 - s[:-1], s[:-1] + 1)
        self.before = array("i", np.append(0, before).astype(np.int32).tobytes())

    def __call__(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, given the leftmost S suffixes in their order."""
        c = self.s[lms]
        order = np.argsort(c, kind="stable")
        c, counts = c[order], np.bincount(c, minlength=len(self.sizes))
        seeded = np.full(len(self.s), -1, np.int32)
        seeded[(self.end - np.cumsum(counts))[c] + np.arange(len(c))] = lms[order]
        sa, before = array("i", seeded.tobytes()), self.before
        head = [0, *(self.end - self.sizes).tolist()]
        for j in sa:
            if j > 0 and (x := before[j]) > 0:
                at = head[x]
                sa[at] = j - 1
                head[x] = at + 1
        tail = [0, *self.end.tolist()]
        for i in range(len(sa) - 1, -1, -1):
            j = sa[i]
            if (x := before[j]) < 0:
                at = tail[-x] - 1
                sa[at] = j - 1
                tail[-x] = at
        return np.frombuffer(sa, np.int32)


def _names(s: np.ndarray, found: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of sorted substrings, equal ones alike; ends has the last place of each by its first."""
    a, b = found[:-1], found[1:]
    length = ends[a] - a
    same = (length == ends[b] - b) & (ends[b] < len(s)) & (ends[a] < len(s))
    live = np.flatnonzero(same)
    offset = 0
    while len(live):  # neighbours are equal substrings if equal to their ends
        live = live[offset <= length[live]]
        differ = s[a[live] + offset] != s[b[live] + offset]
        same[live[differ]] = False
        live = live[~differ]
        offset += 1
    return np.concatenate([[0], np.cumsum(~same)])


def _sorted(s: np.ndarray, inducer: type[_Inducer] | type[_NameInducer]) -> np.ndarray:
    """Start of every suffix of a string that ends with its only 0, in order."""
    is_s = _types(s)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    induce = inducer(s, is_s)
    sa = induce(lms)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    found = sa[is_lms[sa]]
    ends = np.full(len(s), len(s), np.int32)
    ends[lms[:-1]] = lms[1:]
    name = _names(s, found, ends)
    if name[-1] + 1 < len(found):
        names = np.empty(len(s), np.int32)
        names[found] = name
        found = lms[_sorted(names[lms], _NameInducer)]
    return induce(found)  # the first round has put the substrings in order alone, other suffixes only by their seeds


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start of every suffix of a byte string, in order."""
    if not len(text):
        return np.zeros(0, np.int64)
    return _sorted(np.append(text.astype(np.int16) + 1, np.int16(0)), _Inducer)[1:]


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For every suffix by its place in the text, the length it has in common with the suffix before it in sa.

    Where both are preceded by the same byte, the length is one less than that of the place before; only the others are
    compared, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    prior = np.concatenate([[0], text[:-1]]).astype(np.int16)
    prior[0] = -1
    first = (before <= 0) | (prior != prior[before])
    first[:1] = True
    own = np.flatnonzero(first)
    out = np.zeros(n, np.int64)
    live = own[before[own] >= 0]
    done = 0
    while len(live):
        i, j = live + done, before[live] + done
        inside = (i < n) & (j < n)
        equal = np.zeros((len(live), 8), bool)
        equal[inside] = words[i[inside]] == words[j[inside]]
        room = np.minimum(n - i, n - j)
        run = np.minimum(np.where(equal.all(axis=1), 8, np.argmin(equal, axis=1)), np.maximum(room, 0))
        out[live] += run
        live = live[run == 8]
        done += 8
    base = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return out[base] - (np.arange(n) - base)
