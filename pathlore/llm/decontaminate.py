"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the number of their shingles into classes up to 8, 16, 32, ... For each class the documents
are searched in windows of twice the class's size, overlapping by half, so that a passage as long as any of its items
lies within a window and containment there bounds the Jaccard similarity from below (0.17 at a containment of 0.75).
A window and an item that agree in any of REGISTERS least hashes make a candidate; the item's shingles are then looked
up in the whole document's set. Items of one or two shingles are too little of a window for that: they are looked up by
a shingle of their own that a text which contains them must have. An item whose shingles lie in a text scattered wider
than a window is found the same way, but only if that is asked for (``scattered``): it takes such shingles of all items.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlore.llm import shingles
from pathlore.llm._common import arrow_columns, packed, read, text_or_empty, unpacked

#: At the least similarity of a window, all of them miss once in 240,000 times.
REGISTERS = 64
#: Smallest class of items, in shingles, and items of so few are looked up by their own shingles.
SMALLEST, TINY = 8, 2
#: Items are looked for in groups of at most about so many bytes of text: what is broadcast doesn't grow with them.
GROUP_BYTES = 16 << 20
_HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("containment", T.DoubleType())]))
_BITS = 16
#: Bits of the hashes of items' own shingles by which most of a text's are told apart from all of them.
_HEAD_BITS = 22


class Items:
    """A group of items, by size class: least hashes for lookup and full sets for verification."""

    def __init__(self, rows: list[tuple[int | None, str | None]], scattered: bool = False) -> None:
        both = [(i, s) for i, s in ((i, shingles.shingle_set(t)) for i, t in rows) if len(s)]
        self.ids, self.sets = [i for i, _ in both], [s for _, s in both]
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        size = np.array([max(SMALLEST, 1 << (len(s) - 1).bit_length()) for s in self.sets], np.int64)
        tiny = np.array([len(s) <= TINY for s in self.sets], bool)
        for c in np.unique(size[~tiny]).tolist():
            own = np.flatnonzero((size == c) & ~tiny)
            least = shingles.minima([self.sets[i] for i in own], REGISTERS)
            order = np.argsort(least, axis=0, kind="stable")
            seen = np.zeros((REGISTERS, 1 << _BITS), bool)
            for r in range(REGISTERS):
                seen[r, (least[:, r] >> np.uint64(64 - _BITS - 8)).astype(np.int64) & ((1 << _BITS) - 1)] = True
            self.classes[c] = (np.take_along_axis(least, order, axis=0), own[order], seen)
        # an item of n shingles lies in a text only if the text has one of any n - ceil(0.75 n) + 1 of them
        share, of = shingles.SIMILAR
        heads = [s[: len(s) - -(-share * len(s) // of) + 1] if scattered or len(s) <= TINY else s[:0] for s in self.sets]
        head, item = np.concatenate([np.zeros(0, np.uint64), *heads]), np.repeat(np.arange(len(heads)), [len(x) for x in heads])
        order = np.argsort(head, kind="stable")
        self.heads, self.head_items = head[order], item[order]
        self.head_seen = np.zeros(1 << _HEAD_BITS, bool)
        self.head_seen[(head & np.uint64((1 << _HEAD_BITS) - 1)).astype(np.int64)] = True

    def candidates(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, item) pairs, for texts as shingle hashes in order, none empty."""
        out: set[tuple[int, int]] = set()
        if not self.classes:
            return out
        base = min(self.classes)
        blocks = [s for h in texts for s in np.split(h, range(base, len(h), base))]
        least, of = shingles.minima(blocks, REGISTERS), np.repeat(np.arange(len(texts)), [-(-len(h) // base) for h in texts])
        width = base
        for c, (values, items, seen) in sorted(self.classes.items()):
            while width < c:  # join blocks of a text by twos
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                place = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
                starts = np.flatnonzero(place % 2 == 0)
                least, of, width = np.minimum.reduceat(least, starts, axis=0), of[starts], 2 * width
            after = np.r_[of[1:] == of[:-1], False]
            windows = np.where(after[:, None], np.minimum(least, np.roll(least, -1, axis=0)), least)
            for r in range(REGISTERS):
                v = windows[:, r]
                maybe = np.flatnonzero(seen[r, (v >> np.uint64(64 - _BITS - 8)).astype(np.int64) & ((1 << _BITS) - 1)])
                low, high = np.searchsorted(values[:, r], v[maybe], "left"), np.searchsorted(values[:, r], v[maybe], "right")
                for w, a, b in zip(of[maybe].tolist(), low.tolist(), high.tolist(), strict=True):
                    out.update((w, int(items[k, r])) for k in range(a, b))
        return out

    def rest(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """All (text, item) pairs that can be hits, of the items that are looked up by their own shingles."""
        if not texts or not len(self.heads):
            return set()
        h, of = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        maybe = np.flatnonzero(self.head_seen[(h & np.uint64((1 << _HEAD_BITS) - 1)).astype(np.int64)])
        low, high = np.searchsorted(self.heads, h[maybe], "left"), np.searchsorted(self.heads, h[maybe], "right")
        hit = np.flatnonzero(high > low)
        return {(w, int(self.head_items[k])) for w, a, b in zip(of[maybe[hit]].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True) for k in range(a, b)}

    def hits(self, texts: list[str | None], memory: shingles.Words | None = None) -> list[list[dict]]:
        """For each text the items it contains, the fullest first."""
        share, of = shingles.SIMILAR
        hashes = [shingles.shingle_hashes(t, memory=memory) for t in texts]
        some = [i for i, h in enumerate(hashes) if len(h)]
        out: list[list[dict]] = [[] for _ in texts]
        sets: dict[int, np.ndarray] = {}
        found = [hashes[i] for i in some]
        for w, k in sorted(self.candidates(found) | self.rest(found)):
            i = some[w]
            if i not in sets:
                sets = {i: np.unique(hashes[i])}
            item = self.sets[k]
            both = int(np.isin(item, sets[i], assume_unique=True).sum())
            if of * both >= share * len(item):
                out[i].append({"item_id": self.ids[k], "containment": both / len(item)})
        return [sorted(own, key=lambda x: (-x["containment"], x["item_id"] is None, x["item_id"] or 0)) for own in out]


def contained_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", columns: list[str] | None = None, scattered: bool = False
) -> DataFrame:
    """docs with ``hits``: (item_id, containment) of every benchmark item of whose distinct shingles (five words, A-Z
    lower-cased, fewer words are one shingle) at least 0.75 lie in the row's whole text; an own column ``hits`` gives
    way. Ids of rows aren't read; null and tied item ids are told like others. Null or empty texts contain nothing and items without words are in nothing; repeated items are each
    told; no items, or no rows, are no hits. The benchmark is taken in groups of bounded size. columns: those of docs to return
    (all of them). scattered: items are also found whose shingles lie wider apart than twice their size class.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), text_or_empty(item_text).alias("text"))
    groups = max(1, -(-(items.select(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES))
    own = docs.columns if columns is None else columns
    rows = docs.select(packed(docs.select(*[F.col(f"`{c}`") for c in own])), text_or_empty(F.col(f"`{text}`")).alias("_text"), F.array().cast(_HITS).alias("_hits"))
    for g in range(groups):
        few = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g).collect()  # of bounded size
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in sorted(few, key=lambda r: (r.id is None, r.id or 0, r.text))], scattered))

        def found(shared=shared) -> Callable[[pa.RecordBatch], list[pa.Array]]:
            memory = shingles.Words()

            def of(batch: pa.RecordBatch) -> list[pa.Array]:
                out: list[list[dict]] = []
                for i in range(0, batch.num_rows, 200):
                    out += shared.value.hits(batch["_text"].slice(i, 200).to_pylist(), memory)
                return [pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())])))]

            return of

        more = arrow_columns(rows, found, [("_more", _HITS)], drop=["_text"] if g == groups - 1 else [])
        rows = more.withColumn("_hits", F.concat("_hits", "_more")).drop("_more")
    return unpacked(rows.withColumnRenamed("_hits", "hits"), own, ["hits"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contained_items(docs, read(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select(
        "doc_id", F.size("hits").cast("long").alias("n_items"), F.col("hits.item_id").alias("item_ids"),
        F.coalesce(F.array_max("hits.containment"), F.lit(0.0)).alias("containment"),
        (F.size("hits") > 0).alias("contaminated"), (F.size("hits") == 0).alias("kept"),
    )
