"""Near duplicates by SetSketch registers: banding, joint likelihood estimate, exact verification, components.

A sketch register is the truncated logarithm (base B) of the least exponential variate that the shingles of a text
draw: ``min(q + 1, max(0, floor(1 - log_B(least))))``. Registers of a union are the larger of two registers, and
equal registers are about as likely as the Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlore.llm import shingles
from pathlore.llm._common import Tables, arrow_columns, bounded, packed, read, rows_of, slices, stored, text_or_empty, unpacked
from pathlore.llm.components import components

#: Parameters of the sketch: base, rate of the variates, largest register less one.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: Bands of four 16-bit registers. Texts of similarity 0.75 miss all 32 bands once in 190,000 times.
BANDS, ROWS = 32, 4
#: Pairs are verified when their estimate is at least this: five standard errors under 0.75.
LIKELY = 0.55
#: Rounds of pairs with a leading text of a bucket.
ROUNDS = 2
#: Groups of so many texts at most have the pairs of their buckets looked at one by one; larger ones are compared with
#: what most of the group has. Both find every link.
SMALL_GROUP = 32


def registers(least: np.ndarray) -> np.ndarray:
    """Least hashes (uint64, uniform) as registers."""
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(variate, 1e-300)) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def likely_jaccard(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """The similarity under which a's registers exceeding b's ``more`` and falling below ``less`` times is likeliest,
    given the sizes of both sets."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = most * np.linspace(0, 1, 201)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    over, under = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    score = more[:, None] * log(over) + less[:, None] * log(under) + (m - more - less)[:, None] * log(1 - over - under)
    return j[np.arange(len(j)), np.argmax(score, axis=1)]


def _sketch():
    memory = shingles.Words()

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [shingles.shingle_set(t.as_py(), memory=memory) for t in batch["_text"]]
        some = [s for s in sets if len(s)]
        rows = (r.tobytes() for r in registers(shingles.minima(some, BANDS * ROWS)))
        return [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([next(rows) if len(s) else None for s in sets], pa.binary()),
        ]

    return of


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each band of each text: its registers and the band's number, mixed."""
    band = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        keys = np.frombuffer(b"".join(batch["sketch"].to_pylist()), "<u8").reshape(-1, BANDS) ^ band
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        yield pa.RecordBatch.from_arrays([pa.array((keys ^ (keys >> np.uint64(29))).ravel().view(np.int64)), pa.array(np.repeat(batch["node"].to_numpy(), BANDS))], names=["key", "node"])


def _estimate():
    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
        more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
        return [pa.array(likely_jaccard(more, less, batch["n_a"].to_numpy().astype(float), batch["n_b"].to_numpy().astype(float)))]

    return of


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose full shingle sets are similar; rows of one a mostly come one after another."""
    share, of = shingles.SIMILAR
    memory = shingles.Words()
    at, own = None, None
    for batch in batches:
        ok = []
        for a, text_a, text_b in zip(batch["a"].to_pylist(), batch["text_a"], batch["text_b"], strict=True):
            if a != at:
                at, own = a, shingles.shingle_set(text_a.as_py(), memory=memory)
            other = shingles.shingle_set(text_b.as_py(), memory=memory)
            both = len(np.intersect1d(own, other, assume_unique=True))
            ok.append(of * both >= share * (len(own) + len(other) - both))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = shingles.Words()
    for batch in batches:
        for part in slices(batch):
            sets = [shingles.shingle_set(t.as_py(), memory=memory).view(np.int64) for t in part["text"]]
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([part["node"], lists], names=["node", "own"])


class _Links:
    """Finds and verifies links between the classes of equal shingle sets.

    Texts meet in buckets of equal bands. A group of copies of one text meets in many buckets, and most pairs in it
    needn't be looked at: first each text is tried with a leading text of its buckets, the one that meets most others,
    which a copy of nearly all others is. Only buckets whose texts these links don't hold together are looked at
    further. A pair of similarity 0.75 that no band holds and no group brings together is missed, once in 190,000 times.
    """

    def __init__(self, docs: DataFrame, classes: DataFrame, keep: Tables | None = None) -> None:
        self.docs, self.classes = docs, classes
        self.keep = Tables() if keep is None else keep

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """node, text for a stored table of nodes; a class's text is that of one of the rows its key names."""
        wanted = self.keep(self.classes.join(bounded(nodes), "node", "left_semi").select("node", "k1", "k2"), "near-wanted")
        found = self.docs.join(bounded(wanted), ["k1", "k2"]).select("node", "k1", "k2", "text")
        # a row that repeats both key columns gives its node once
        return self.keep(found.dropDuplicates(["node"]).select("node", "text"), "near-texts")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The links among pairs (a, b): first by likelihood from the sketches, then by full sets."""
        sketches = self.classes.select("node", "n", "sketch")
        side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        likely = self.keep(arrow_columns(both, _estimate, [("estimate", T.DoubleType())]).where(F.col("estimate") >= LIKELY).select("a", "b"), "near-likely")
        text_of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
        return self.keep(text_of("b").join(bounded(likely), "b").join(text_of("a"), "a").mapInArrow(_verify, "a long, b long").distinct(), "near-links")

    def led(self, active: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of the texts with leaders of their buckets (key, node, meets), and the bucket rows still open after them:
        those of texts that the bucket's leader isn't known to be connected with."""
        leads = active.groupBy("key").agg(F.max(F.struct("meets", "node")).alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1")
        leads = self.keep(leads.select("key", F.col("lead.node").alias("lead"), F.col("lead.meets").alias("lead_meets")), "near-leads")
        tried = self.keep(active.join(bounded(leads), "key").where("node != lead"), "near-tried")
        pairs = tried.groupBy("node").agg(F.max(F.struct("lead_meets", "lead")).alias("lead")).select(F.col("lead.lead").alias("a"), F.col("node").alias("b"))
        links = self.verified(self.keep(pairs, "near-pairs"), texts)
        # a text's label is its leader, or the leader's leader
        leader = links.select(F.col("b").alias("node"), F.col("a").alias("label"))
        upper = links.select(F.col("b").alias("label"), F.col("a").alias("upper"))
        labels = self.keep(leader.join(bounded(upper, links), "label", "left").select("node", F.coalesce("upper", "label").alias("label")), "near-labels")
        lead_labels = labels.select(F.col("node").alias("lead"), F.col("label").alias("lead_label"))
        named = self.labelled(tried, labels).join(bounded(lead_labels, labels), "lead", "left")
        return links, self.keep(named.where(F.col("label") != F.coalesce("lead_label", "lead")).select("key", "node", "meets"), "near-active")

    def labelled(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        return members.join(bounded(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))

    def labels(self) -> DataFrame:
        """node, label for all nodes with links: the same label for those that links of texts with a bucket in common connect."""
        bands = self.keep(self.classes.select("node", "sketch").mapInArrow(_bands, "key long, node long"), "near-bands")
        shared = self.keep(bands.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "near-buckets")
        members = self.keep(bands.join(bounded(shared), "key"), "near-members")
        meets = self.keep(members.groupBy("node").agg(F.sum("k").alias("meets")), "near-meets")
        texts = self.texts_of(meets)
        active = members.select("key", "node").join(bounded(meets), "node")
        links = None
        for _ in range(ROUNDS):
            found, active = self.led(active, texts)
            links = found if links is None else links.unionByName(found)
            if not rows_of(active):
                break
        labels = components(links)
        self.keep.append(labels)
        labelled = self.keep(self.labelled(members.select("key", "node"), labels), "near-labelled")
        ends = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("first")).where("low < high")
        open_ = self.keep(ends.select("key", "first"), "near-open")
        if not rows_of(open_):
            return labels
        rest = self.keep(labelled.join(bounded(open_), "key"), "near-rest")
        # texts of open buckets that have texts in common are a group
        own = rest.groupBy("node").agg(F.min("label").alias("label"))
        groups = components(rest.select(F.col("node").alias("a"), F.col("first").alias("b")))
        self.keep.append(groups)
        grouped = self.keep(own.join(bounded(groups.withColumnRenamed("label", "grp"), groups), "node").select("node", "label", "grp"), "near-grouped")
        sizes = self.keep(grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("members")), "near-sizes")
        sized = self.keep(grouped.join(bounded(sizes), "grp"), "near-sized")
        few = rest.join(bounded(sized).where(F.col("members") <= SMALL_GROUP).select("node"), "node", "left_semi").select("key", "node", "label")
        other = few.select("key", F.col("node").alias("b"), F.col("label").alias("label_b"))
        pairs = few.join(other, "key").where("node < b and label != label_b").select(F.col("node").alias("a"), "b").distinct()
        more = [self.verified(self.keep(pairs, "near-pairs"), texts)]
        many = self.keep(sized.where(F.col("members") > SMALL_GROUP), "near-many")
        if rows_of(many):
            more += self.in_groups(many, texts)
        if not sum(map(rows_of, more)):
            return labels
        for found in more:
            links = links.unionByName(found)
        labels = components(links)
        self.keep.append(labels)
        return labels

    def in_groups(self, nodes: DataFrame, texts: DataFrame) -> list[DataFrame]:
        """Links that connect all similar texts of a group, for nodes (node, label, grp, members); exact.

        The core of a group holds the shingles that most of its texts have. What a text lacks of it, or has beside it,
        is its difference D. With d = |D| and n shingles, texts are similar if ``g + g' <= 14 |D and D'|``, where
        ``g = 7 d - n``. So the text of least g is similar to every text that has no part of D in common with some
        similar text, and to all that are similar by their g alone. The others have one of the rarest of D in common: of
        a similar pair each has that overlap, and by its own size at least ``(3 g - 4 n) / 21``, so that only so many of
        D's elements are joined; edits that no other text has are in no join at all.
        """
        sets = texts.join(bounded(nodes.select("node"), nodes), "node", "left_semi").mapInArrow(_set_rows, "node long, own array<long>")
        sets = self.keep(sets.join(bounded(nodes), "node"), "near-sets")
        counts = self.keep(sets.select("grp", "members", F.explode("own").alias("x")).groupBy("grp", "x").agg(F.count(F.lit(1)).alias("c"), F.first("members").alias("members")), "near-counts")
        cores = self.keep(counts.where("2 * c > members").groupBy("grp").agg(F.collect_list("x").alias("core")), "near-cores")
        core = F.coalesce("core", F.array().cast("array<long>"))
        apart = sets.join(bounded(cores), "grp", "left").select(
            "node", "label", "grp", F.size("own").alias("n"), F.concat(F.array_except("own", core), F.array_except(core, F.col("own"))).alias("apart")
        )
        apart = self.keep(apart.withColumn("d", F.size("apart")).withColumn("g", F.expr("7 * d - n")), "near-apart")
        leads = apart.groupBy("grp").agg(F.min(F.struct("g", "node", "label")).alias("lead"))
        leads = self.keep(leads.select("grp", F.col("lead.g").alias("least_g"), F.col("lead.node").alias("lead"), F.col("lead.label").alias("lead_label")), "near-group-leads")
        led = apart.join(bounded(leads), "grp").withColumn("close", F.expr("g + least_g <= 0"))
        links = self.keep(led.where("close AND node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")), "near-led")

        # rarest first; an element's count is that of the texts whose D holds it
        common = F.expr("greatest(1, ceil((g + least_g) / 14), ceil((3 * g - 4 * n) / 21))")
        rare = counts.select("grp", "x", F.expr("if(2 * c > members, members - c, c)").alias("c")).where("c > 1")
        rare = self.keep(rare, "near-rare")
        rows = led.where(common <= F.col("d")).select(
            "node", "grp", "n", "d", "g", F.when(F.col("close"), F.col("lead_label")).otherwise(F.col("label")).alias("label"), common.alias("common"), F.explode("apart").alias("x")
        )
        ranked = rows.join(bounded(rare), ["grp", "x"], "left").groupBy("node", "grp", "n", "d", "g", "label", "common").agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "x"))).alias("all")
        )
        heads = ranked.select("node", "grp", "n", "d", "g", "label", F.posexplode(F.expr("slice(all, 1, cast(d - common + 1 AS int))")).alias("p", "s")).where("s.c > 1")
        heads = self.keep(heads.select("node", "grp", "n", "d", "g", "label", "p", F.col("s.x").alias("x")), "near-heads")
        # Texts of one label are linked: an element that only they have joins nothing, and of the others' elements the
        # texts of the label that most have meet only those of other labels, never one another.
        per_label = heads.groupBy("grp", "x", "label").agg(F.count(F.lit(1)).alias("n"))
        most = per_label.groupBy("grp", "x").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
        heads = self.keep(heads.join(bounded(most, heads), ["grp", "x"]), "near-meeting")
        few = heads.where("label != most")
        other = heads.select("grp", "x", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "d", "g", "label", "p")])
        share, of = shingles.SIMILAR
        close = F.expr(
            f"(node < node_b OR label_b = most) AND label != label_b AND {of} * least(n, n_b) >= {share} * greatest(n, n_b) AND g + g_b > 0 AND g + g_b <= 14 * least(d - p, d_b - p_b)"
        )
        pairs = self.keep(few.join(other, ["grp", "x"]).where(close).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct(), "near-rare-pairs")
        of_node = lambda x: apart.select(F.col("node").alias(x), F.col("g").alias(f"g_{x}"), F.col("apart").alias(f"apart_{x}"))
        both = pairs.join(of_node("b"), "b").join(of_node("a"), "a").where("g_a + g_b <= 14 * size(array_intersect(apart_a, apart_b))")
        return [links, self.keep(both.select("a", "b"), "near-links")]


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """_id, _text and a key (k1, k2) that rows share only with repeats of themselves."""
    rows = docs.withColumns({"_id": F.col(f"`{id_col}`").cast("long"), "_text": text_or_empty(F.col(f"`{text}`"))})
    return rows.withColumns({"k1": F.coalesce("_id", F.lit(-(2**63))), "k2": F.xxhash64("_text")})


def near_decisions(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: k1, k2 (its key), doc_id, n_shingles, component_id, kept. See near_dedup()."""
    keep = Tables()
    source = _source(docs, id_col, text).select("k1", "k2", "_id", "_text")
    sketched = arrow_columns(source, _sketch, [("n", T.LongType()), ("set", T.BinaryType()), ("sketch", T.BinaryType())], drop=["_text"])
    rows = keep(sketched, "near-rows")
    per_set = rows.where("n > 0").groupBy("set").agg(
        F.count(F.lit(1)).alias("copies"), F.min("_id").alias("least"), F.min(F.struct("k1", "k2")).alias("rep"),
        F.first("n").alias("n"), F.first("sketch").alias("sketch"),
    )
    classes = keep(per_set.select("set", "copies", "least", "rep.k1", "rep.k2", "n", "sketch", F.monotonically_increasing_id().alias("node")), "near-classes")
    labels = _Links(source.select("k1", "k2", F.col("_text").alias("text")), classes, keep).labels()
    named = keep(classes.select("set", "copies", "least", "node").join(bounded(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), "near-named")
    smallest = keep(named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1"), "near-smallest")
    of_set = keep(named.join(bounded(smallest), "label").select("set", "component_id", F.lit(True).alias("grouped")), "near-sets")
    decided = rows.join(bounded(of_set), "set", "left").withColumn("component_id", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("_id")))
    keep.drop(rows, of_set)
    return decided.select("k1", "k2", F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_shingles, component_id and kept for each row; own columns of these names give way to them.

    A text's set holds its distinct shingles of five words (A-Z lower-cased; fewer words are one shingle). Rows are
    linked when ``100 * intersection >= 75 * union``, confirmed on full sets; component_id is the smallest id that
    links reach and kept says whether it is the row's own. Rows without words (null and empty texts too) are linked
    with nothing and kept. Null ids take part, but name a component only if all its ids are null. Rows that repeat a
    kept id with a similar text are all kept. An empty table gives no rows.
    """
    new = ["n_shingles", "component_id", "kept"]
    decisions = stored(near_decisions(docs, id_col, text).select("k1", "k2", *new).dropDuplicates(["k1", "k2"]), "near-decisions")
    keys = _source(docs.select(packed(docs), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text")
    return unpacked(keys.select("_row", "k1", "k2").join(bounded(decisions), ["k1", "k2"]), docs.columns, new)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents."""
    return near_decisions(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
