"""Source divergence audit: how far the term shares of each source lie from those of its language's other sources.

Each kept term of a language is a row of its nonzero counts, ordered by source. Equal rows are merged, and the rows go
into frequent-pattern trees: rows that begin with the same (source, share) items share nodes, and a node has the number
of rows below it. The sum over all terms for a pair of sources is then

* the number of kept terms times the pair's value where both have the share of count 0,
* for each source, its items with their numbers against the other source's share of count 0, and
* for terms that both have, a correction, made once for each node and ancestor of a tree, times the node's number.

No term meets sources that don't have it. Ranges of sorted rows make one tree for each slice of rows; trees are cut
between any two rows, as sums don't mind. All arithmetic is on 64-bit integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathlore.llm._common import bounded, read, slices, stored, text_or_empty

#: Documents of its language that a kept term is in at least, terms listed for a source, and the unit of shares.
LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Terms that a task counts before it hands them on, bytes of a text split at once, and pairs corrected at once.
HELD_TERMS, PIECE_BYTES, AT_ONCE = 200_000, 1 << 20, 500_000
#: Bytes: A-Z become a-z, other letters and bytes of longer characters stay, the rest parts terms.
_FOLD = bytes(c if chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(128)) + bytes(range(128, 256))


def pieces(text: bytes, fold: bytes) -> Iterator[list[bytes]]:
    """The terms of a folded text, some at a time."""
    text, at = text.translate(fold), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, of many rows together."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for a in range(0, len(terms), 50_000):
                part = terms[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(part)), pa.repeat(source, len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in batches:
        for part in slices(batch):
            for lang, source, text in zip(*(part[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for words in pieces(text, _FOLD):
                    n.update(words)
                    own.update(words)
                docs.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from told()
    yield from told()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (n + 2 v)), divided in two steps so that counts to 9 * 10^13 don't overflow; 1 without any term."""
    a, b = (count + F.lit(2)) * F.lit(100_000).cast("long"), n + F.lit(2) * v
    whole = F.lit(1).cast("long") + _div(a, b) * F.lit(UNIT // 100_000).cast("long") + _div((a % b) * F.lit(UNIT // 100_000).cast("long"), b)
    return F.when(b > 0, whole).otherwise(F.lit(1).cast("long"))


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def tree_corrections(lang: np.ndarray, ends: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(lang, source of the ancestor, source of the node, correction) of the tree of sorted rows.

    Row i has the items ends[i] to ends[i + 1] - 1 and stands for times[i] terms. A node of depth d lasts as long as
    rows agree with the row before them in their first d + 1 items.
    """
    n = np.diff(ends)
    shared = np.append(False, lang[1:] == lang[:-1])
    for d in range(int(n.max(initial=0))):
        has = n > d
        at = np.where(has, ends[:-1] + d, 0)
        shared = shared & has & np.append(False, has[:-1])
        shared[1:] &= (source[at[1:]] == source[at[:-1]]) & (p[at[1:]] == p[at[:-1]])
        begins = np.flatnonzero(~shared)
        number = np.add.reduceat(times, begins)[has[begins]]
        begins = begins[has[begins]]
        step = max(1, AT_ONCE // max(1, d))
        for a in range(0, len(begins) if d else 0, step):
            row, k = begins[a : a + step], number[a : a + step]
            node = np.repeat(ends[row] + d, d)
            above = (ends[row][:, None] + np.arange(d)).ravel()
            ps, qs, p0s, q0s = p[above], p[node], p0[above], p0[node]
            value = _distance(ps, qs) - _distance(ps, q0s) - _distance(p0s, qs) + _distance(p0s, q0s)
            yield np.repeat(lang[row], d), source[above], source[node], value * np.repeat(k, d)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the corrections of each slice's tree."""
    for batch in batches:
        for at in range(0, batch.num_rows, 5_000):
            part = batch.slice(at, 5_000)
            items = part["items"]
            ends = items.offsets.to_numpy().astype(np.int64)
            flat = items.values.slice(ends[0], ends[-1] - ends[0])
            langs, sources = part["lang"].dictionary_encode(), flat.field("source").dictionary_encode()
            code = [x.indices.to_numpy().astype(np.int64) for x in (langs, sources)]
            wide = len(sources.dictionary)
            sums: dict[str, np.ndarray] = {"key": np.zeros(0, np.int64), "value": np.zeros(0, np.int64)}
            p, p0 = (flat.field(c).to_numpy() for c in ("p", "p0"))
            for lang, a, b, value in tree_corrections(code[0], ends - ends[0], code[1], p, p0, part["times"].to_numpy()):
                key = np.concatenate([sums["key"], (lang * wide + a) * wide + b])
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                sums = {"key": key[first], "value": np.add.reduceat(np.concatenate([sums["value"], value])[order], first)}
            key = sums["key"]
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(key // (wide * wide))), sources.dictionary.take(pa.array(key // wide % wide)), sources.dictionary.take(pa.array(key % wide)), pa.array(sums["value"])],
                names=["lang", "source", "item", "value"],
            ) if wide else pa.RecordBatch.from_pylist([], pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of docs: all other sources (part ``pair``, least
    alike first) and the terms of which the source has more than its language (part ``term``, the first ``top``).

    Null texts, languages and sources are empty ones; texts without terms count for their group all the same, repeated
    rows each count, ties go by item in UTF-8 order, and an empty table gives no rows. Other columns aren't read. A term
    row holds one item for each source that has the term; a language's sources must fit in a row, as their pairs are
    what is asked for.
    """
    rows = docs.select(*[text_or_empty(c).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    schema = "lang string, source string, term string, n long, docs long"
    # dealt by term once: counts by source, then a term's row of sources
    counts = rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_counted, schema).repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("items"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = stored(of_term.where(F.col("docs") >= least_docs).drop("docs"), "divergence-terms")

    item = kept.select("lang", "term", "total", F.explode("items").alias("i")).select("lang", "term", "total", "i.*")
    number, terms = item.groupBy("lang", "source").agg(F.sum("n").alias("n_source")), kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    zero = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(number, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["n_source", "v", "n_lang"])
    groups = stored(groups.withColumn("p0", share(zero, F.col("n_source"), F.col("v"))), "divergence-groups")

    shares = item.join(bounded(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("n_source"), F.col("v")))
    more = shares.withColumn("q", share(F.col("total"), F.col("n_lang"), F.col("v"))).where("p > q")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_part = more.select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)

    paths = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("items")).groupBy("lang", "items").agg(F.count(F.lit(1)).alias("times"))
    paths = stored(paths, "divergence-paths")
    # dealt by their first items, so that what the driver samples of them is short; many rows with the same ones, by hash
    dealt = paths.where(F.size("items") > 1).repartitionByRange("lang", F.slice("items", 1, 2), F.xxhash64("items"))
    trees = dealt.sortWithinPartitions("lang", "items").mapInArrow(_trees, "lang string, source string, item string, value long")

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = groups.join(bounded(other, groups), "lang").where("source != item").select("lang", "source", "item", (F.col("v") * distance(F.col("p0"), F.col("q0"))).alias("value"))
    alone = paths.select("lang", "times", F.explode("items").alias("i")).groupBy("lang", "i.source", "i.p", "i.p0").agg(F.sum("times").alias("times"))
    gain = F.col("times") * (distance(F.col("p"), F.col("q0")) - distance(F.col("p0"), F.col("q0")))
    alone = alone.join(bounded(other, groups), "lang").where("source != item").select("lang", "source", "item", gain.alias("value"))
    pairs = base.unionByName(_both_ways(alone.unionByName(trees))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair_part = pairs.withColumn("rank", F.row_number().over(first))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(pair_part, "pair").unionByName(out(term_part, "term"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and each source's own terms, of all documents."""
    return audit(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS rid FROM documents),
 t AS (SELECT lang, source, rid, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM t GROUP BY lang, source, term),
 k AS (SELECT lang, term, sum(n)::BIGINT AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
 v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n_lang FROM k GROUP BY lang),
 g AS (SELECT lang, source, coalesce(v, 0) AS v, n_lang FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)),
 n AS (SELECT lang, source, sum(n)::BIGINT AS n_source FROM c JOIN k USING (lang, term) GROUP BY lang, source),
 s AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 2) // (coalesce(n_source, 0) + 2 * v) AS p, 1 + 1000000000 * (total + 2) // (n_lang + 2 * v) AS q
       FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN n USING (lang, source)),
 f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
 terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q),
 ranked AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
