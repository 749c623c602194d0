"""Repeated byte strings removed, by suffix arrays over shards that bring equal strings together.

A string of LENGTH bytes holds a selected anchor: of its ANCHOR-byte pieces, those of least hash. Anchors that two
documents have are found by their hashes; the bytes about each (the strings whose first anchor of least hash it is)
go to the shard of the anchor's bytes. A shard's suffix array and common prefixes give its equal strings, and each
that a smaller document has too is removed. Pieces and contexts that repeat within a batch are settled there, so that
a very frequent passage reaches a shard once for each batch, not once for each document. A context that shares with no
other document any of the pieces of which each of its strings holds one isn't sorted.

An anchor with more contexts than a shard should have is hot: its contexts may all differ, and would all go to one
shard. Each of their strings that hold it goes to the shard of the string's own 128-bit hash instead, once for each
batch and row of least id, so that what comes together there are equal strings alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.llm._common import bounded, dealt, drop_stored, read, stored, text_or_empty
from pathlore.llm.suffixes import common_prefixes, suffix_array

LENGTH, ANCHOR = 50, 20
SPAN = 2 * LENGTH - ANCHOR  # bytes about an anchor that its strings can reach
#: Text of a batch, and contexts of a shard, at about so many bytes.
BATCH_BYTES, SHARD_BYTES = 4 << 20, 3 << 20
#: Text of a bucket of the table of texts, in bytes.
BUCKET_BYTES = 16 << 20
#: Occurrences in a batch from which a piece counts as shared though one row has them all, so that one entry stands for them.
MANY = 64
#: Contexts that are made at once, those whose strings are made at once, and bytes of a string's entry.
CONTEXTS_AT_ONCE, STRINGS_AT_ONCE, STRING_BYTES = 1 << 17, 1 << 14, 40
#: A byte that UTF-8 never has.
OUTSIDE = 0xFF
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w) * _M1
        h ^= h >> np.uint64(29)
    h *= _M2
    return h ^ (h >> np.uint64(32))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every window of so many places."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the selected pieces of a text."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b = np.frombuffer(data + bytes(8), np.uint8)
    n = len(data) - ANCHOR + 1
    words = np.lib.stride_tricks.as_strided(b, (len(data), 8), (1, 1))
    word = np.ascontiguousarray(words).view("<u8").ravel().astype(np.uint64)
    h = _mixed([word[o : o + n] for o in (0, 8, ANCHOR - 8)])
    width = LENGTH - ANCHOR + 1
    low = _least(h, width)
    edge = np.zeros(width - 1, np.uint64)
    high = ~_least(~np.concatenate([edge, low, edge]), width)  # the greatest of those windows' leasts that hold a place
    at = np.flatnonzero(high == h)
    return at, h[at]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows some megabytes of text at a time."""
    for batch in batches:
        sizes = np.cumsum(pa.compute.binary_length(batch["text"]).to_numpy(zero_copy_only=False)) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for c in range(a, b, 30_000):
                yield batch.slice(c, min(30_000, b - c)).to_pydict()


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _anchor_rows(parts: int):
    """(part, rid, data): anchors for a part of the hash space, or places of one row already known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches):
            rids = np.array(rows["rid"], np.int64)
            found = [anchors(t.encode()) for t in rows["text"]]
            h = np.concatenate([f[1] for f in found])
            at, doc = np.concatenate([f[0] for f in found]), np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            order = np.argsort(h, kind="stable")
            h, at, doc = h[order], at[order], doc[order]
            starts = _runs(h)
            if not len(starts):
                continue
            sizes = np.diff(np.append(starts, len(h)))
            shared = np.repeat((np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) | (sizes > MANY), sizes)
            sizes = np.repeat(sizes, sizes)
            first = np.zeros(len(h), bool)
            first[starts] = True
            out: list[tuple] = []
            known = np.flatnonzero(shared)
            known = known[np.argsort(doc[known], kind="stable")]
            for group in np.split(known, _runs(doc[known])[1:]) if len(known) else []:
                rid = int(rids[doc[group[0]]])
                out.append((rid % parts, rid, at[group].astype("<u4").tobytes()))
            keep = np.flatnonzero(~shared | first)
            part = ((h[keep] >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            keep = keep[np.argsort(part, kind="stable")]
            part = np.sort(part)
            for group, p in zip(np.split(keep, _runs(part)[1:]), part[_runs(part)].tolist(), strict=True):
                docs, own = np.unique(doc[group], return_inverse=True)
                head = np.array([len(group), len(docs)], "<u4").tobytes() + rids[docs].astype("<i8").tobytes()
                marks = (own | np.where(shared[group], 1 << 15, 0)).astype("<u2")
                low = h[group] & np.uint64((1 << 40) - 1)
                out.append((p, None, head + (low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (low >> np.uint64(32)).astype("u1").tobytes() + at[group].astype("<u4").tobytes() + marks.tobytes() + sizes[group[shared[group]]].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.binary()])], names=["part", "rid", "data"])

    return run


def _shared_anchors(homes: int, most: int):
    """(home, data): anchors of a part that two rows have, together for each group of rows; for home -1 the part's
    anchors with more than most places (by part and low hash) and how many."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[rows["rid"].notna()]
        place = [np.frombuffer(d, "<u4") for d in known["data"]]
        of = [np.full(len(x), int(r)) for r, x in zip(known["rid"], place, strict=True)]
        h, rid, at, mark, count = [], [], [], [], []
        hot, sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for data in rows.loc[rows["rid"].isna(), "data"]:
            n, d = (int(x) for x in np.frombuffer(data, "<u4", 2))
            docs = np.frombuffer(data, "<i8", d, 8)
            o = 8 + 8 * d
            h.append(np.frombuffer(data, "<u4", n, o).astype(np.uint64) | np.frombuffer(data, "u1", n, o + 4 * n).astype(np.uint64) << np.uint64(32))
            at.append(np.frombuffer(data, "<u4", n, o + 5 * n))
            marks = np.frombuffer(data, "<u2", n, o + 9 * n)
            rid.append(docs[marks & 0x7FFF])
            mark.append(marks >> 15)
            count.append(np.ones(n, np.int64))
            count[-1][mark[-1] > 0] = np.frombuffer(data, "<u4", -1, o + 11 * n)
        if h:
            h, rid, at, mark, count = map(np.concatenate, (h, rid, at, mark, count))
            order = np.argsort(h, kind="stable")
            h, rid, at, mark, count = h[order], rid[order], at[order], mark[order], count[order]
            starts = _runs(h)
            total = np.add.reduceat(count, starts)
            hot, sizes = h[starts][total > most] | np.uint64(int(rows["part"].iloc[0]) << 40), total[total > most]
            several = (np.minimum.reduceat(rid, starts) != np.maximum.reduceat(rid, starts)) | (np.maximum.reduceat(mark, starts) > 0)
            keep = np.repeat(several, np.diff(np.append(starts, len(h)))) & (mark == 0)
            of.append(rid[keep])
            place.append(at[keep])
        of, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (of, place))
        order = np.argsort(of % homes, kind="stable")
        of, place = of[order], place[order]
        out = [
            (int(of[g[0]] % homes), np.array([len(g)], "<u4").tobytes() + of[g].astype("<i8").tobytes() + place[g].astype("<u4").tobytes())
            for g in (np.split(np.arange(len(of)), _runs(of % homes)[1:]) if len(of) else [])
        ]
        if len(hot):
            out.append((-1, np.array([len(hot)], "<u4").tobytes() + hot.astype("<u8").tobytes() + sizes.astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["home", "data"])

    return run


def _by_row(rows: pd.DataFrame) -> pd.DataFrame:
    """(rid, places): all shared anchors of each row of a group; without a rid, the hot anchors and their places' number."""
    sizes = [int(np.frombuffer(d, "<u4", 1)[0]) for d in rows["data"]]
    if rows["home"].iloc[0] < 0:
        return pd.DataFrame({"rid": pd.array([None] * len(rows), "Int64"), "places": [d[4:] for d in rows["data"]]})
    rid = np.concatenate([np.frombuffer(d, "<i8", n, 4) for d, n in zip(rows["data"], sizes, strict=True)])
    at = np.concatenate([np.frombuffer(d, "<u4", n, 4 + 8 * n) for d, n in zip(rows["data"], sizes, strict=True)])
    order = np.lexsort((at, rid))
    rid, at = rid[order], at[order]
    groups = np.split(at, _runs(rid)[1:])
    return pd.DataFrame({"rid": rid[_runs(rid)], "places": [g.astype("<u4").tobytes() for g in groups]})


def _covered(rid: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple]:
    """(rid, lows, highs) with the spans of each row joined where they meet."""
    order = np.lexsort((low, rid))
    rid, low, high = rid[order], low[order], high[order]
    out = []
    for group in np.split(np.arange(len(rid)), _runs(rid)[1:]) if len(rid) else []:
        a, b = joined(low[group], high[group])
        out.append((int(rid[group[0]]), a.astype("<u4").tobytes(), b.astype("<u4").tobytes()))
    return out


def joined(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans, ascending by low, joined where they overlap or touch."""
    if not len(low):
        return low, high
    reach = np.maximum.accumulate(high)
    first = np.concatenate([[True], low[1:] > reach[:-1]])
    last = np.concatenate([first[1:], [True]])
    return low[first], reach[last]


#: Kinds of what a string's entry has: two hashes, key, rid, low and high.
_ENTRY = ("<u8", "<u8", "<i8", "<i8", "<u4", "<u4")


def _settled(context: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal contexts: which rows have a larger key than the least (all their strings go), and which stand for the
    rest (one of the least key; the others of it too, as each has its own places)."""
    padded = np.zeros((len(context), -(-SPAN // 8) * 8), np.uint8)
    padded[:, :SPAN] = context
    words = padded.view("<u8")
    h = _mixed([words[:, i] for i in range(words.shape[1])])
    order = np.lexsort((key, h))
    starts = _runs(h[order])
    of = np.repeat(starts, np.diff(np.append(starts, len(h))))
    lead = np.empty(len(h), np.int64)
    lead[order] = order[of]
    equal = (words == words[lead]).all(axis=1)  # a collision settles nothing
    gone = equal & (key > key[lead])
    return gone, ~gone


def _ranges(doc: np.ndarray, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For anchors of documents, in order of place: the first and the last start of the strings that are each one's own,
    those in which it is the first of least hash. Equal strings have equal anchors, so it is at one place in them."""
    reach = LENGTH - ANCHOR
    low, high = place - reach, place.copy()
    step = 1
    while step < len(place):
        near = np.flatnonzero((doc[step:] == doc[:-step]) & (place[step:] - place[:-step] <= reach))
        if not len(near):
            break
        later, less = near + step, h[near + step] < h[near]
        low[later[~less]] = np.maximum(low[later[~less]], place[near[~less]] + 1)
        high[near[less]] = np.minimum(high[near[less]], place[later[less]] - reach - 1)
        step += 1
    return low, high


def _met(context: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Contexts one of whose strings may be in a context of another key: each string holds one of these three pieces whole."""
    out, n = np.zeros(len(context), bool), 2 * ANCHOR
    for o in range(LENGTH - 2 * ANCHOR, LENGTH - ANCHOR + 1, ANCHOR // 2):
        piece = np.ascontiguousarray(context[:, o : o + n])
        own = np.flatnonzero((piece != OUTSIDE).all(axis=1))
        if not len(own):
            continue
        words = piece[own].view("<u8")
        h = _mixed([words[:, i] for i in range(words.shape[1])])
        order = np.argsort(h, kind="stable")
        starts = _runs(h[order])
        several = np.minimum.reduceat(key[own][order], starts) != np.maximum.reduceat(key[own][order], starts)
        out[own[order[np.repeat(several, np.diff(np.append(starts, len(h))))]]] = True
    return out


def _gone(h1: np.ndarray, h2: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the strings of these hashes have a larger key than the least of equal ones."""
    order = np.lexsort((key, h2, h1))
    a, b = h1[order], h2[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    out = np.empty(len(h1), bool)
    out[order] = key[order] > key[order][np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))]
    return out


def _strings(context: np.ndarray, rid: np.ndarray, key: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(h1, h2, key, rid, low, high), some at a time: the strings of contexts that hold the anchor, and the bytes that
    they cover; places of one row with one context that lie close together are one."""
    if not len(context):
        return
    words = np.ascontiguousarray(context).view("<u8")
    order = np.lexsort((at, _mixed([words[:, i] for i in range(words.shape[1])]), rid))
    context, words, rid, key, at = context[order], words[order], rid[order], key[order], at[order]
    more = (rid[1:] == rid[:-1]) & (words[1:] == words[:-1]).all(axis=1) & (at[1:] - at[:-1] <= LENGTH)
    first = np.flatnonzero(np.concatenate([[True], ~more]))
    last = np.append(first[1:], len(at)) - 1
    context, rid, key, low, high = context[first], rid[first], key[first], at[first], at[last] + LENGTH
    for c in range(0, len(context), STRINGS_AT_ONCE):
        part = slice(c, c + STRINGS_AT_ONCE)
        bad = np.cumsum(np.pad(context[part] == OUTSIDE, ((0, 0), (1, 0))), axis=1)
        made = []
        for o in range(LENGTH - ANCHOR + 1):
            inside = np.flatnonzero(bad[:, o + LENGTH] == bad[:, o])
            w = [np.ascontiguousarray(context[part][inside, o + i : o + i + 8]).view("<u8").ravel() for i in (*range(0, LENGTH - 8, 8), LENGTH - 8)]
            h2 = _mixed([(x ^ (x >> np.uint64(31))) * _M2 for x in w[::-1]])
            made.append((_mixed(w), h2, key[part][inside], rid[part][inside], low[part][inside] + o, high[part][inside] + o))
        yield tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _context_rows(parts: int, hot: np.ndarray, hot_parts: int, anchor_parts: int):
    """(part, rid, low, high, data): contexts for a shard, strings of hot anchors for one of the shards after these, or
    spans already known to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches):
            texts = [t.encode() for t in rows["text"]]
            edge = bytes([OUTSIDE]) * LENGTH
            data = np.frombuffer(edge[: LENGTH - ANCHOR] + b"".join(t + edge for t in texts), np.uint8)
            sizes = np.array([len(t) for t in texts], np.int64)
            base = np.cumsum(sizes + LENGTH) - sizes - LENGTH
            places = [np.frombuffer(d, "<u4") for d in rows["places"]]
            doc, at = np.repeat(np.arange(len(texts)), [len(x) for x in places]), np.concatenate(places).astype(np.int64) - (LENGTH - ANCHOR)
            starts = base[doc] + at + LENGTH - ANCHOR
            word = np.lib.stride_tricks.sliding_window_view(data, 8)
            h = _mixed([word[starts + LENGTH - ANCHOR + o].view("<u8").ravel() for o in (0, 8, ANCHOR - 8)])
            low, high = _ranges(doc, at + LENGTH - ANCHOR, h)
            low, high = np.maximum(low, 0), np.minimum(high, sizes[doc] - LENGTH)
            own = np.flatnonzero(low <= high)
            high += LENGTH
            rids, keys = np.array(rows["rid"], np.int64), np.array(rows["k1"], np.int64)
            window = np.lib.stride_tricks.sliding_window_view(data, SPAN)
            out: list[tuple] = []
            for some in np.split(own, range(CONTEXTS_AT_ONCE, len(own), CONTEXTS_AT_ONCE)):
                out += of(window[starts[some]], rids[doc[some]], keys[doc[some]], at[some], h[some], low[some], high[some])
            if out:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["part", "rid", "low", "high", "data"])

    def of(context: np.ndarray, rid: np.ndarray, key: np.ndarray, at: np.ndarray, h: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple]:
        column = np.arange(SPAN)
        context[(column < (low - at)[:, None]) | (column >= (high - at)[:, None])] = OUTSIDE
        gone, stays = _settled(context, key)
        spans, out = [(rid[gone], low[gone], high[gone])], []
        if len(hot):
            apart = stays & np.isin((h >> np.uint64(40)) % np.uint64(anchor_parts) << np.uint64(40) | h & np.uint64((1 << 40) - 1), hot)
            stays &= ~apart
            for made in _strings(context[apart], rid[apart], key[apart], at[apart]):
                least = ~_gone(*made[:3])
                spans.append(tuple(x[~least] for x in made[3:]))
                part = parts + (made[0][least] % np.uint64(hot_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                kept = [x[least][order].astype(t) for x, t in zip(made, _ENTRY, strict=True)]
                starts = _runs(part[order])
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False):
                    out.append((int(part[order[a]]), None, None, None, np.array([b - a], "<u4").tobytes() + b"".join(x[a:b].tobytes() for x in kept)))
        out += [(r % parts, r, a, b, None) for r, a, b in _covered(*(np.concatenate(x) for x in zip(*spans, strict=True)))]
        part = (h % np.uint64(parts)).astype(np.int64)
        keep = np.flatnonzero(stays)
        keep = keep[np.argsort(part[keep], kind="stable")]
        for group in np.split(keep, _runs(part[keep])[1:]) if len(keep) else []:
            docs, own = np.unique(rid[group], return_inverse=True)
            keys = np.empty(len(docs), np.int64)
            keys[own] = key[group]
            head = np.array([len(group), len(docs)], "<u4").tobytes() + docs.astype("<i8").tobytes() + keys.astype("<i8").tobytes()
            out.append((int(part[group[0]]), None, None, None, head + at[group].astype("<i4").tobytes() + own.astype("<u2").tobytes() + context[group].tobytes()))
        return out

    return run


def _repeats(rows: pd.DataFrame) -> pd.DataFrame:
    """(rid, low, high): spans of a shard's contexts that a smaller document has."""
    known = rows[rows["rid"].notna()]
    out = [(int(r), a, b) for r, a, b in zip(known["rid"], known["low"], known["high"], strict=True)]
    rid, key, at, context = [], [], [], []
    for data in rows.loc[rows["rid"].isna(), "data"]:
        n, d = (int(x) for x in np.frombuffer(data, "<u4", 2))
        own = np.frombuffer(data, "<u2", n, 8 + 16 * d + 4 * n)
        rid.append(np.frombuffer(data, "<i8", d, 8)[own])
        key.append(np.frombuffer(data, "<i8", d, 8 + 8 * d)[own])
        at.append(np.frombuffer(data, "<i4", n, 8 + 16 * d).astype(np.int64))
        context.append(np.frombuffer(data, np.uint8, n * SPAN, 8 + 16 * d + 6 * n).reshape(n, SPAN))
    if rid:
        rid, key, at, context = map(np.concatenate, (rid, key, at, context))
        gone, stays = _settled(context, key)
        inside = context != OUTSIDE
        first, last = np.argmax(inside, axis=1), SPAN - np.argmax(inside[:, ::-1], axis=1)
        spans = [(rid[gone], (at + first)[gone], (at + last)[gone])]
        stays[stays] = _met(context[stays], key[stays])
        rid, key, at, context = rid[stays], key[stays], at[stays], context[stays]
        # each context's bytes and one that ends it
        text = np.concatenate([context, np.full((len(context), 1), OUTSIDE, np.uint8)], axis=1)
        held = text != OUTSIDE
        held[:, -1] = True
        own, column = (x.astype(np.int32) for x in np.nonzero(held))
        text = text[held]
        sa = suffix_array(text)
        shared = common_prefixes(text, sa)[sa] >= LENGTH
        whole = np.zeros(len(text), bool)
        bad = np.concatenate([[0], np.cumsum(text == OUTSIDE)])
        whole[: len(text) - LENGTH + 1] = bad[LENGTH:] == bad[: len(bad) - LENGTH]
        starts = np.flatnonzero(~shared)
        if len(sa):
            least = np.minimum.reduceat(key[own[sa]], starts)
            sizes = np.diff(np.append(starts, len(sa)))
            hit = sa[whole[sa] & (key[own[sa]] > np.repeat(least, sizes))]
            low = at[own[hit]] + column[hit]
            spans.append((rid[own[hit]], low, low + LENGTH))
        out += _covered(*(np.concatenate(x) for x in zip(*spans, strict=True)))
    return pd.DataFrame(out, columns=["rid", "low", "high"])


def _equal_strings(rows: pd.DataFrame) -> pd.DataFrame:
    """(rid, low, high): spans of a shard's strings that a smaller document has."""
    columns: list[list[np.ndarray]] = [[] for _ in _ENTRY]
    for data in rows["data"]:
        n, o = int(np.frombuffer(data, "<u4", 1)[0]), 4
        for own, kind in zip(columns, _ENTRY, strict=True):
            own.append(np.frombuffer(data, kind, n, o))
            o += n * np.dtype(kind).itemsize
    h1, h2, key, rid, low, high = map(np.concatenate, columns)
    gone = _gone(h1, h2, key)
    out = _covered(rid[gone], low[gone].astype(np.int64), high[gone].astype(np.int64))
    return pd.DataFrame(out, columns=["rid", "low", "high"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final spans and what is left of each row."""
    for batch in batches:
        spans, kept, size = [], [], []
        for text, lows, highs in zip(batch["text"], batch["lows"].to_pylist(), batch["highs"].to_pylist(), strict=True):
            data = text.as_py().encode()
            low, high = (np.concatenate([np.frombuffer(x, "<u4") for x in xs]).astype(np.int64) if xs else np.zeros(0, np.int64) for xs in (lows, highs))
            order = np.argsort(low, kind="stable")
            low, high = joined(low[order], high[order])
            ends = [0, *high.tolist()]
            kept.append(b"".join(data[a:b] for a, b in zip(ends, [*low.tolist(), len(data)], strict=True)))
            spans.append([{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            size.append(len(data))
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (low, high, in bytes), kept (bytes) for each row of docs.

    A byte goes if a string of LENGTH bytes that covers it also starts in a row with a smaller id; strings are those
    of the input and never cross rows. Null ids are smaller than any other; rows of one id don't remove from each
    other. Null texts are empty; empty and short texts stay as they are. An empty table gives no rows; other columns
    aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("k1", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("digest", F.sha2("text", 256))
    # rows that are whole copies of a smaller id's text are settled by digest
    counts = rows.groupBy("digest").agg(F.min("k1").alias("least"), F.count(F.lit(1)).alias("n"))
    copied = stored(counts.where("n > 1").select("digest", "least"), "bytes-copied")
    own = stored(
        rows.join(bounded(copied), "digest", "left")
        .select("doc_id", "k1", "text", (F.coalesce(F.col("k1") > F.col("least"), F.lit(False)) & (F.octet_length("text") >= LENGTH)).alias("copy"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "bytes-rows",
    )
    whole = stored(own.where("copy").select("doc_id", F.octet_length("text").cast("long").alias("n")), "bytes-copies")
    size = own.where("NOT copy").select(F.sum(F.octet_length("text"))).first()[0] or 0
    # texts are dealt by row once: the joins with places and with spans move those alone
    rest = dealt(own.where("NOT copy").select("rid", "doc_id", "k1", "text"), "bytes-texts", "rid", max(8, size // BUCKET_BYTES))
    drop_stored(own)
    parts = max(8, size // (16 * SHARD_BYTES) * 4)
    pieces = rest.select("rid", "text").mapInArrow(_anchor_rows(parts), "part long, rid long, data binary")
    # two steps, so that a row's places come together in one row, however many parts they were found in
    shared = pieces.groupBy("part").applyInPandas(_shared_anchors(parts, SHARD_BYTES // SPAN), "home long, data binary")
    placed = stored(shared.groupBy("home").applyInPandas(lambda rows: _by_row(rows), "rid long, places binary"), "bytes-places")
    # 16 bytes for each anchor of more than SHARD_BYTES of contexts
    parted = [np.frombuffer(r.places, "<u8").reshape(2, -1) for r in placed.where("rid IS NULL").collect()]
    hot, n_hot = np.concatenate([np.zeros((2, 0), np.uint64), *parted], axis=1)
    hot_parts = max(8, int(n_hot.sum()) * (LENGTH - ANCHOR + 1) * STRING_BYTES // SHARD_BYTES)
    places = placed.where("rid IS NOT NULL")
    about = places.select(F.sum(F.octet_length("places"))).first()[0] or 0
    shards = max(8, about // 4 * SPAN // SHARD_BYTES)
    contexts = rest.select("rid", "k1", "text").join(bounded(places, placed), "rid").mapInArrow(_context_rows(shards, hot, hot_parts, parts), "part long, rid long, low binary, high binary, data binary")

    def repeats(rows: pd.DataFrame) -> pd.DataFrame:
        return (_repeats if rows["part"].iloc[0] < shards else _equal_strings)(rows)

    found = stored(contexts.groupBy("part").applyInPandas(repeats, "rid long, low binary, high binary"), "bytes-spans")
    spans = stored(found.groupBy("rid").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")), "bytes-row-spans")
    schema = "doc_id long, n_bytes long, spans array<struct<low:long,high:long>>, kept binary"
    cut = rest.join(bounded(spans), "rid", "left").select("doc_id", "text", "lows", "highs").mapInArrow(_cut, schema)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n").alias("high")))
    return cut.unionByName(whole.select("doc_id", F.col("n").alias("n_bytes"), all_of_it.alias("spans"), F.lit(b"").alias("kept")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 50 bytes in all documents."""
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, s) -> a + s.high - s.low)").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
