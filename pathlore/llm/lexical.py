"""Ranked lexical search: the highest-scoring documents for each item, exactly, by ball trees of sparse vectors.

A document is the vector of its terms' impacts, an item the set of its terms with their weights; a score is their inner
product. Only terms that some item has matter, so documents keep those. Each block of documents is a ball tree: a node
has the centroid of its documents and the radius about it that holds them all, so that no document below it scores
more than ``q . centroid + |q| radius``. An item goes down a tree by the highest bound first, and ends where the bound
is below the score of the last document that it has found; leaves are scored in whole numbers. Bounds are enlarged by
more than rounding can take from them, so that pruning never loses a document. Both vectors are scaled by the root of
the term's weight, which leaves the product as it is and makes the radius small.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathlore.llm._common import BROADCAST_BYTES, bounded, read, rows_of, slices, stored, text_or_empty
from pathlore.llm.divergence import pieces

#: Results of an item, documents in a leaf and in a tree at most, numbers in a tree's centroids (about), items at once.
TOP, LEAF, BLOCK, CENTROIDS, ITEMS = 10, 32, 4096, 8_000_000, 256
#: Numbers of documents' entries in a tree at most (but for one document alone).
ENTRIES = 1_000_000
#: What rounding can take from a bound, as a share: far more than sums of some million doubles lose.
SAFE = 1e-9
#: Bytes: A-Z become a-z, digits, other letters and bytes of longer characters stay, the rest parts terms.
_FOLD = bytes(c + 32 if chr(c).isupper() else c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def _term_counts(text: bytes) -> Counter:
    out: Counter = Counter()
    for words in pieces(text, _FOLD):
        out.update(words)
    return out


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every item's distinct terms."""
    for batch in batches:
        for part in slices(batch):
            at, terms = [], []
            for i, text in enumerate(part["text"].to_pylist()):
                own = list(_term_counts(text))
                at += [i] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([part["qid"].take(pa.array(at, pa.int64())), pa.array(terms, pa.binary()).cast(pa.string())], names=["qid", "term"])


def _known_terms(vocabulary: dict[bytes, int]):
    """Documents with at least one term: how many they have, and those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, n, tids, tfs = [], [], [], []
                for i, text in enumerate(part["text"].to_pylist()):
                    if counts := _term_counts(text):
                        own = [(vocabulary[t], k) for t, k in counts.items() if t in vocabulary]
                        rows.append(i)
                        n.append(counts.total())
                        tids.append([t for t, _ in own])
                        tfs.append([k for _, k in own])
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(tids, kind), pa.array(tfs, kind)], names=["doc_id", "n", "tids", "tfs"])

    return run


def _all_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with at least one term, and every term in rows of some thousand."""
    for batch in batches:
        for part in slices(batch):
            for rid, doc_id, text in zip(*(part[c].to_pylist() for c in ("rid", "doc_id", "text")), strict=True):
                counts = _term_counts(text)
                terms, n = list(counts), counts.total()
                for a in range(0, len(terms), 5_000):
                    own = terms[a : a + 5_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(rid, len(own)), pa.array([doc_id] * len(own), pa.int64()), pa.repeat(n, len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in own], pa.int64())],
                        names=["rid", "doc_id", "n", "term", "tf"],
                    )


def vectors(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """A stored table of doc_id, n, tids, tfs for the documents (doc_id, text) with at least one term; its mark is the
    sum of n. A vocabulary (term, tid) of few bytes goes to every task; a larger one is joined, term by term."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    if vocabulary.stored_bytes <= BROADCAST_BYTES:
        known = {r.term.encode(): r.tid for r in vocabulary.collect()}
        found = docs.mapInArrow(_known_terms(known), "doc_id long, n long, tids array<long>, tfs array<long>")
        return stored(found, "lexical-documents", F.sum("n"))
    # a number of each row that a repeated task gives again, as the rows are written before they are dealt
    rows = stored(docs.withColumn("rid", F.monotonically_increasing_id()), "lexical-rows")
    terms = rows.mapInArrow(_all_terms, "rid long, doc_id long, n long, term string, tf long").join(vocabulary, "term", "left")
    known = F.struct("tid", "tf")
    by_row = terms.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.collect_list(F.when(F.col("tid").isNotNull(), known)).alias("own"))
    return stored(by_row.select("doc_id", "n", F.col("own.tid").alias("tids"), F.col("own.tf").alias("tfs")), "lexical-documents", F.sum("n"))


# the trees


@dataclass
class Tree:
    """Nodes of a ball tree: the rows of a leaf or two children, a centroid and a radius."""

    rows: list[np.ndarray | None]
    children: list[list[int]]
    centroids: np.ndarray
    radii: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(nodes, queries): no row below the node has a higher product; queries are rows of scaled weights."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        return (self.centroids @ queries.T + self.radii[:, None] * norms) * (1 + SAFE)


def _chosen(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some rows, and the rows' new ends."""
    size = ends[which + 1] - ends[which]
    new = np.concatenate([[0], np.cumsum(size)])
    return np.arange(new[-1]) + np.repeat(ends[which] - new[:-1], size), new


def build(ends: np.ndarray, cols: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF) -> Tree:
    """The ball tree of sparse rows with one entry at least each: parted by the nearer of two rows that are far apart,
    until few are left."""
    norms = np.add.reduceat(values * values, ends[:-1])
    tree, centroids, radii = Tree([], [], np.zeros(0), np.zeros(0)), [], []
    todo: list[tuple[np.ndarray, int | None]] = [(np.arange(len(ends) - 1), None)]
    while todo:
        rows, parent = todo.pop()
        at, own = _chosen(ends, rows)
        c, v = cols[at], values[at]

        def apart(dense: np.ndarray, square: float) -> np.ndarray:
            """Squared distances of the rows to a point."""
            return norms[rows] - 2 * np.add.reduceat(v * dense[c], own[:-1]) + square  # noqa: B023

        def from_row(i: int) -> np.ndarray:
            dense = np.zeros(width)
            dense[c[own[i] : own[i + 1]]] = v[own[i] : own[i + 1]]  # noqa: B023
            return apart(dense, norms[rows[i]])  # noqa: B023

        centre = np.bincount(c, weights=v, minlength=width) / len(rows)
        square = float(centre @ centre)
        far = apart(centre, square)
        centroids.append(centre)
        # a difference of large squares can lose some 1e-13 of them
        radii.append(np.sqrt(max(0.0, float(far.max())) + 1e-11 * (square + float(norms[rows].max()))))
        node = len(tree.rows)
        if parent is not None:
            tree.children[parent].append(node)
        tree.rows.append(rows if len(rows) <= leaf else None)
        tree.children.append([])
        if len(rows) > leaf:
            a = from_row(int(far.argmax()))
            side = a < from_row(int(a.argmax()))
            if side.all() or not side.any():  # all alike
                side = np.arange(len(rows)) < len(rows) // 2
            todo += [(rows[~side], node), (rows[side], node)]
    tree.centroids, tree.radii = np.array(centroids), np.array(radii)
    return tree


@dataclass
class Items:
    """Items as sparse rows: their numbers, ends of rows, terms and weights."""

    qids: np.ndarray
    ends: np.ndarray
    tids: np.ndarray
    weights: np.ndarray


class Best(list):
    """(-score, document) of the best documents of an item so far, ascending: by score, then by smaller document."""

    def floor(self, top: int) -> int:
        """Documents that score less can't be among the best."""
        return -self[top - 1][0] if len(self) >= top else 1

    def take(self, found: list[tuple[int, int]], top: int) -> None:
        self.extend(found)
        self.sort()
        del self[top:]


def search_block(ends: np.ndarray, tids: np.ndarray, impacts: np.ndarray, ids: list[int], items: Items, best: list[Best], top: int = TOP, leaf: int = LEAF) -> int:
    """Brings the best of a block of documents into ``best`` (one of each item); returns how many scores were made."""
    names, cols = np.unique(tids, return_inverse=True)
    at = np.minimum(np.searchsorted(names, items.tids), len(names) - 1)
    hit = names[at] == items.tids
    weight = np.zeros(len(names), np.int64)
    weight[at[hit]] = items.weights[hit]  # a term has one weight
    root = np.sqrt(weight.astype(float))
    tree = build(ends, cols, impacts * root[cols], len(names), leaf)
    owner = np.repeat(np.arange(len(items.qids)), np.diff(items.ends))
    leaves = {n: (rows, *_chosen(ends, rows)) for n, rows in enumerate(tree.rows) if rows is not None}
    scored = 0
    for first in range(0, len(items.qids), ITEMS):
        some = hit & (owner >= first) & (owner < first + ITEMS)
        dense = np.zeros((min(ITEMS, len(items.qids) - first), len(names)))
        dense[owner[some] - first, at[some]] = root[at[some]]
        bounds = tree.bounds(dense)
        for q in np.flatnonzero(bounds[0] >= 1).tolist():
            own, mine, bound = best[first + q], np.where(dense[q] > 0, weight, 0), bounds[:, q].tolist()
            heap, floor = [(-bound[0], 0)], best[first + q].floor(top)
            while heap and -heap[0][0] >= floor:
                high, node = heapq.heappop(heap)
                if node in leaves:
                    rows, place, new = leaves[node]
                    score = np.add.reduceat(mine[cols[place]] * impacts[place], new[:-1])
                    scored += len(rows)
                    good = np.flatnonzero(score >= floor)
                    if len(good):
                        own.take([(-s, ids[r]) for s, r in zip(score[good].tolist(), rows[good].tolist(), strict=True)], top)
                        floor = own.floor(top)
                for child in tree.children[node]:
                    if bound[child] >= floor:
                        heapq.heappush(heap, (max(high, -bound[child]), child))
    return scored


#: Stands for a null id, before all others.
_NULL = -(2**63) - 1


def _search(items: Items, top: int):
    """The best documents of a task's rows for each item, a tree at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in items.qids]
        held: list[tuple[list, np.ndarray, np.ndarray, np.ndarray]] = []
        most = max(2 * LEAF, min(BLOCK, CENTROIDS * LEAF // 2 // max(1, len(np.unique(items.tids)))))

        def flush() -> None:
            if held:
                ids, sizes, tids, impacts = ([x for h in held for x in h[0]], *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3)))
                search_block(np.concatenate([[0], np.cumsum(sizes)]), tids, impacts, ids, items, best, top)
                held.clear()

        for batch in batches:
            ends = batch["tids"].offsets.to_numpy().astype(np.int64)
            tids, tfs = (batch[c].flatten().to_numpy() for c in ("tids", "tfs"))
            ends = ends - ends[0]
            sizes, m = np.diff(ends), batch["m"].to_numpy()
            impacts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, sizes))
            ids = [_NULL if i is None else i for i in batch["doc_id"].to_pylist()]
            a = 0
            while a < len(ids):
                full, entries = sum(len(h[0]) for h in held), sum(len(h[2]) for h in held)
                b = min(len(ids), a + most - full, max(a + (not held), int(np.searchsorted(ends, ends[a] + ENTRIES - entries, side="right")) - 1))
                if b > a:
                    held.append((ids[a:b], sizes[a:b], tids[ends[a] : ends[b]], impacts[ends[a] : ends[b]]))
                if b < len(ids):
                    flush()
                a = b
        flush()
        of = [(int(q), d, -s) for q, own in zip(items.qids, best, strict=True) for s, d in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in of], pa.int64()), pa.array([None if x[1] == _NULL else x[1] for x in of], pa.int64()), pa.array([x[2] for x in of], pa.int64())], names=["qid", "doc_id", "score"]
        )

    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank, doc_id, score: the ``top`` rows of docs with the highest scores above 0 for each row of items.

    Equal scores go by ascending id (a long; null before all others). Null and empty texts have no terms: such items
    have no rows, such documents are in none. Repeated documents each have a rank, repeated items have rows each, and
    an empty table gives no rows. Other columns aren't read. Items are searched some megabytes at a time, each time
    in one pass over the documents' vectors; texts are read once.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item"), text_or_empty(F.col(f"`{item_text}`")).alias("text"))
    asked = stored(asked.withColumn("qid", F.monotonically_increasing_id()), "lexical-items")
    terms = stored(asked.select("qid", F.col("text").cast("binary").alias("text")).mapInArrow(_item_terms, "qid long, term string"), "lexical-item-terms")
    vocabulary = stored(terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "lexical-vocabulary")
    found = vectors(rows, vocabulary)
    n, length = rows_of(found), found.stored_mark or 0

    df = found.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = stored(vocabulary.join(df, "tid").select("term", "tid", weight.alias("w")).where("w > 0"), "lexical-weights")
    weighted = terms.join(bounded(weights), "term").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("tid", "w"))).alias("own"))
    weighted = stored(weighted.select("qid", F.col("own.tid").alias("tids"), F.col("own.w").alias("ws")), "lexical-queries")

    m = F.expr(f"cast(10 + (90 * cast(n as decimal(20)) * {n}) div {max(1, length)} as long)")
    entries = found.where(F.size("tids") > 0).select("doc_id", m.alias("m"), "tids", "tfs")
    parts = max(1, -(-weighted.stored_bytes // BROADCAST_BYTES))
    out = None
    for part in range(parts):
        some = weighted.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).collect()
        block = Items(
            np.array([r.qid for r in some], np.int64), np.cumsum([0, *(len(r.tids) for r in some)]),
            *(np.array([x for r in some for x in r[c]], np.int64) for c in ("tids", "ws")),
        )
        hits = entries.mapInArrow(_search(block, top), "qid long, doc_id long, score long")
        out = hits if out is None else out.unionByName(hits)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return out.join(bounded(asked.select("qid", "item"), asked), "qid").select("item", "rank", "doc_id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each item of the benchmark."""
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


OP11_SQL = r"""
WITH t AS (SELECT doc_id, rid, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, row_number() OVER () AS rid, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
 n AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY rid), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM n),
 tf AS (SELECT rid, term, count(*) AS tf FROM t GROUP BY rid, term),
 w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 s AS (SELECT item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
       FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (rid), total GROUP BY item_id, rid),
 r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN n USING (rid) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""
