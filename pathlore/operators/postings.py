"""The posting table (kind, key, id), or blocks of it: which records have an alias that is, starts with or contains a key."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pathlore.functions import text as tx


def aliases() -> Column:
    """A record's distinct names that are searched: folded, Latin without spaces, Latin initials."""
    return F.array_distinct(F.filter(F.array("normalized_name", "pinyin_compact", "pinyin_initials"), lambda x: x != ""))


#: Kinds of postings.
KINDS = ("exact", "prefix1", "prefix2", "gram2", "gram3", "char", "extension")


#: Parts a record's aliases where they stand in one string; names that have it aren't plain.
_APART = "\0"



def _plain(joined: Column, a: Column) -> Column:
    """Whether each character of the aliases a, and of them joined, is a grapheme and none is _APART."""
    return tx.ascii_only(joined) & ~joined.contains("\r\n") & (F.size(F.split(joined, _APART)) == F.size(a))


def build(catalog: DataFrame, kinds: Sequence[str] = KINDS, carry: Sequence[str] = ()) -> DataFrame:
    """Postings (of those kinds) of a catalog in long form, which no hot key makes a giant row. Columns of the catalog
    in carry come after the id.

    Duplicates of a record's aliases go without a shuffle: other keys are made distinct in its own row, and a gram of
    plain aliases (a character is a grapheme) is one at the first place where it stands in all of them, written in a
    row. So only numbers are exploded, and keys are picked and grams are cut in generated code.
    """
    row = catalog.select("id", *carry, aliases().alias("a"), F.when(~F.col("is_directory"), F.col("file_extension")).alias("ext"))
    row = row.withColumn("all", F.array_join("a", _APART))
    row = row.withColumn("plain", _plain(F.col("all"), F.col("a")))
    head = lambda n: F.transform(F.filter("a", lambda x: tx.n_graphemes(x) >= n), lambda x: tx.head(x, n))
    every = lambda n: F.when(F.col("plain"), F.array().cast("array<string>")).otherwise(F.flatten(F.transform("a", lambda x: tx.grams(x, n))))
    made = {
        "exact": lambda: F.col("a"), "prefix1": lambda: head(1), "prefix2": lambda: head(2), "gram2": lambda: every(2), "gram3": lambda: every(3),
        "char": lambda: head(1), "extension": lambda: F.filter(F.array("ext"), lambda e: e != ""),
    }
    of = lambda kind: F.transform(F.array_distinct(made[kind]()), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    # a record's numbers: first those of its keys, then those of the places of each kind of gram
    row = row.withColumn("keys", F.concat(*map(of, kinds))).withColumn("upto", F.size("keys"))
    own = F.get("keys", F.col("i") - 1)
    kind, key, at, ends = own["kind"], own["key"], F.lit(0), ["upto"]
    for gram in (k for k in kinds if k.startswith("gram")):
        n, place, ends = int(gram[-1]), F.col("i") - F.col(ends[-1]), [*ends, f"upto_{gram}"]
        row = row.withColumn(ends[-1], F.col(ends[-2]) + F.when(F.col("plain"), F.greatest(F.length("all") - (n - 1), F.lit(0))).otherwise(0))
        kind, key, at = F.when(place > 0, gram).otherwise(kind), F.when(place > 0, F.substring("all", place, F.lit(n))).otherwise(key), F.when(place > 0, place).otherwise(at)
    count = F.col(ends[-1])
    numbers = row.select("id", *carry, "all", "keys", *ends, F.explode(F.when(count > 0, F.sequence(F.lit(1), count))).alias("i"))
    told = numbers.select("id", *carry, "all", kind.alias("kind"), key.alias("key"), at.alias("at"))
    first = (F.col("at") == 0) | (~F.col("key").contains(_APART) & (F.instr("all", F.col("key")) == F.col("at")))
    return told.where(first).select("kind", "key", "id", *carry)


#: Of each kind of key that isn't whole: its characters, and whether it stands at the beginning alone.
_CUTS = {"prefix1": (1, True), "prefix2": (2, True), "char": (1, True), "gram2": (2, False), "gram3": (3, False)}


def _strings(a: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All strings of lists, with the bytes of each and the list that it is from."""
    strings = a.flatten()
    return strings, np.asarray(pc.binary_length(strings), np.int64), np.repeat(np.arange(len(a)), np.asarray(a.value_lengths(), np.int64))


def _bytes(strings: pa.Array) -> np.ndarray:
    at = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, 4 * strings.offset) if len(strings) else [0, 0]
    return np.frombuffer(strings.buffers()[2] if at[-1] else b"", np.uint8)[at[0] : at[-1]]


def _found(keys: Sequence[tuple[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of records (id, a: plain aliases, ext) those postings (kind, key, id) that are of the keys."""
    kind_of, key_of = (pa.array(list(xs), pa.string()) for xs in zip(*keys, strict=True))
    whole = {kind: (pa.array([x for k, x in keys if k == kind], pa.string()), np.array([i for i, (k, _) in enumerate(keys) if k == kind], np.int64)) for kind in ("exact", "extension")}
    # a key of n characters is a number of seven bits each; by number one more than its place in keys, 0 for the others
    slots: dict[str, np.ndarray] = {}
    for i, (kind, key) in enumerate(keys):
        n, data = _CUTS.get(kind, (0, True))[0], key.encode()
        if n and len(data) == n and key.isascii():
            slots.setdefault(kind, np.zeros(1 << 7 * n, np.int32))[sum(b << 7 * (n - 1 - j) for j, b in enumerate(data))] = i + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch["a"].cast(pa.list_(pa.string()))
            strings, lens, own = _strings(a)
            ends = np.cumsum(lens)
            data = _bytes(strings).astype(np.int32)
            hits = []  # places in keys and records
            for kind, values, record in (("exact", strings, own), ("extension", batch["ext"].cast(pa.string()), np.arange(len(a)))):
                known, places = whole[kind]
                at = np.asarray(pc.fill_null(pc.index_in(values, known), -1), np.int64)
                hits.append((places[at[at >= 0]], record[at >= 0]))
            for kind, slot in slots.items():
                n, head = _CUTS[kind]
                at = (ends - lens)[lens >= n] if head else np.arange(max(0, len(data) - n + 1))
                number = data[at]
                for i in range(1, n):
                    number = number << 7 | data[at + i]
                place = slot[number]
                at, place = at[place > 0], place[place > 0]
                string = np.searchsorted(ends, at, side="right")
                inside = at + n <= ends[string]  # and not over the end of an alias
                hits.append((place[inside].astype(np.int64) - 1, own[string[inside]]))
            # each key of a record once, whatever the number of its aliases and places
            told = np.unique(np.concatenate([r * len(keys) + p for p, r in hits]))
            place, record = pa.array(told % len(keys)), pa.array(told // len(keys))
            yield pa.RecordBatch.from_arrays([kind_of.take(place), key_of.take(place), batch["id"].take(record)], ["kind", "key", "id"])

    return find


def of_keys(catalog: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """build()'s postings of some keys (kind, key) alone, of which there are few: tasks look for them in their records a
    batch at a time, so that no other gram ever is a row. Records whose aliases aren't plain are cut by build()."""
    keys = sorted(set(keys))
    kinds = [k for k in KINDS if any(k == kind for kind, _ in keys)]
    if not keys:
        return build(catalog).where("false")
    plain = _plain(F.array_join(aliases(), _APART), aliases())
    row = catalog.where(plain).select("id", aliases().alias("a"), F.when(~F.col("is_directory"), F.col("file_extension")).alias("ext"))
    found = row.mapInArrow(_found(keys), "kind string, key string, id long")
    told = F.broadcast(catalog.sparkSession.createDataFrame(keys, "kind string, key string"))
    return found.unionByName(build(catalog.where(~plain), kinds).join(told, ["kind", "key"], "left_semi"))


#: Ids in a block of a posting list, about, and at most.
BLOCK, BLOCK_MOST = 2_048, 4_096


def bits_for(records: int, block: int = BLOCK) -> int:
    """Into 2 to the power of how many ranges ids are parted, so that about ``block`` of so many records are in each."""
    return max(0, math.ceil(math.log2(max(1, records) / block)))


def blocked(postings: DataFrame, bits: int, most: int | None = 0) -> DataFrame:
    """kind, key, block, ids, n: posting lists in blocks of the range of ids, of sorted distinct ids each.

    Ids are hashes, so ranges hold alike many: a key that all records have is a row for each range, none of which grows
    with the catalog; a rare key has a row for each id. A block that should hold more than ``most`` ids all the same
    (hashes may collide in their first bits; 0: BLOCK_MOST) goes on in a further row; with None a block is one row,
    whatever it holds.
    """
    most = BLOCK_MOST if most == 0 else most
    block = F.shiftright(F.col("id"), 64 - bits) if bits else F.lit(0).cast("long")
    groups = postings.groupBy("kind", "key", block.alias("block")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    if most is None:
        return groups.withColumn("n", F.size("ids").cast("long")).select("kind", "key", "block", "ids", "n")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / most).cast("int")), lambda i: F.slice("ids", i * most + 1, most))
    return groups.select("kind", "key", "block", F.explode(parts).alias("ids")).withColumn("n", F.size("ids").cast("long"))


def intersect(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, id: the ids that the lists of all of a query's keys (query_id, kind, key: distinct) have in common.

    Lists meet block by block. The shortest list of a query says which blocks matter: of the others only those are
    dealt, and a block that one of the lists hasn't is left out before any ids are compared, shortest block first.
    A key without a list leaves its query without rows.
    """
    asked = asked.select("query_id", "kind", "key").distinct()
    lengths = blocks.join(asked.select("kind", "key").distinct(), ["kind", "key"], "left_semi").groupBy("kind", "key").agg(F.sum("n").alias("df"))
    own = Window.partitionBy("query_id")
    told = asked.join(lengths, ["kind", "key"], "left").withColumns(
        {"need": F.count(F.lit(1)).over(own), "known": F.count("df").over(own), "place": F.row_number().over(own.orderBy("df", "kind", "key"))}
    ).where("known = need")
    hits = blocks.join(told.select("query_id", "kind", "key", "need", "place"), ["kind", "key"])
    # a block's further rows are one list again
    lists = hits.groupBy("query_id", "block", "place").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.first("need").alias("need"))
    first = hits.where("place = 1").select("query_id", "block").distinct()
    lists = lists.join(first, ["query_id", "block"], "left_semi")
    met = lists.groupBy("query_id", "block").agg(F.array_sort(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("lists"), F.first("need").alias("need"))
    common = F.aggregate(F.slice("lists", 2, 2**30), F.col("lists")[0]["ids"], lambda a, x: F.array_intersect(a, x["ids"]))
    return met.where(F.size("lists") == F.col("need")).select("query_id", F.explode(common).alias("id"))


def frequencies(postings: DataFrame) -> DataFrame:
    """How many records have each key, of postings in long form or in blocks."""
    return postings.groupBy("kind", "key").agg((F.sum("n") if "n" in postings.columns else F.count(F.lit(1))).alias("df"))


def _counted(kinds: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of records (a: aliases, ext) a task's counts of keys (kind, key, n). A key that isn't whole is a number of
    seven bits a character where a record's aliases are plain; the aliases of others are given back as they are."""
    cuts = {k: cut for k, cut in _CUTS.items() if k in kinds}
    no_alias, batch_of = pa.list_(pa.string()), pa.RecordBatch.from_arrays

    def rows(kind: str, keys: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return batch_of([pa.repeat(kind, len(keys)), keys, n, pa.nulls(len(keys), no_alias)], _COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(1 << 7 * n, np.int64) for k, (n, _) in cuts.items()}
        for batch in batches:
            a = batch["a"].cast(no_alias)
            strings, lens, own = _strings(a)
            if "exact" in kinds:
                yield rows("exact", strings, pa.repeat(1, len(strings)))
            if "extension" in kinds:
                told = batch["ext"].cast(pa.string()).drop_null().value_counts()
                yield rows("extension", told.field("values"), told.field("counts"))
            data = _bytes(strings).astype(np.int64)
            ends = np.repeat(np.cumsum(lens), lens)
            record, left = np.repeat(own, lens), ends - np.arange(len(data))  # of each byte, and how many its string has from it on
            odd = (data > 127) | (data == 0)
            odd[:-1] |= (data[:-1] == 13) & (data[1:] == 10)
            plain = np.ones(len(a), bool)
            plain[record[odd]] = False
            first = np.zeros(len(data), bool)
            first[(np.cumsum(lens) - lens)[lens > 0]] = True
            for kind, (n, head) in cuts.items():
                at = np.flatnonzero(plain[record] & (left >= n) & (first if head else True))
                key = record[at]
                for i in range(n):
                    key = key << 7 | data[at + i]
                key.sort()
                key = key[np.diff(key, prepend=-1) != 0]  # a record's keys, once each
                sums[kind] += np.bincount(key & ((1 << 7 * n) - 1), minlength=len(sums[kind]))
            if cuts and not plain.all():
                rest = a.filter(pa.array(~plain))
                none = pa.nulls(len(rest), pa.string())
                yield batch_of([none, none, pa.nulls(len(rest), pa.int64()), rest], _COUNTED)
        for kind, (n, _) in cuts.items():
            found = np.flatnonzero(sums[kind])
            text = np.stack([found >> 7 * (n - 1 - i) & 127 for i in range(n)], 1).astype(np.uint8).tobytes()
            keys = pa.Array.from_buffers(pa.string(), len(found), [None, pa.py_buffer(np.arange(0, n * len(found) + 1, n, dtype=np.int32)), pa.py_buffer(text)])
            yield rows(kind, keys, pa.array(sums[kind][found]))

    return count


#: Columns of what _counted() gives back.
_COUNTED = ["kind", "key", "n", "a"]


def key_counts(catalog: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """frequencies() of a catalog's postings, without the postings: tasks count the keys of their records, a batch at a
    time, and Spark adds the counts up. Keys of aliases that have graphemes of several characters are cut by Spark."""
    row = catalog.select(aliases().alias("a"), F.when(~F.col("is_directory") & (F.col("file_extension") != ""), F.col("file_extension")).alias("ext"))
    told = row.mapInArrow(_counted(kinds), "kind string, key string, n long, a array<string>")
    cut = {"prefix1": (1, tx.head), "prefix2": (2, tx.head), "char": (1, tx.head), "gram2": (2, tx.grams), "gram3": (3, tx.grams)}

    def of(kind: str) -> Column:
        n, by = cut[kind]
        long = F.filter("a", lambda x: tx.n_graphemes(x) >= n)
        keys = F.transform(long, lambda x: by(x, n)) if by is tx.head else F.flatten(F.transform(long, lambda x: by(x, n)))
        return F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.lit(1).cast("long").alias("n")))

    some = [k for k in kinds if k in cut]
    if some:
        counted = F.array(F.struct("kind", "key", "n"))
        told = told.select(F.explode(F.when(F.col("kind").isNotNull(), counted).otherwise(F.concat(*map(of, some)))).alias("k")).select("k.*")
    return told.groupBy("kind", "key").agg(F.sum("n").alias("df"))


def save(postings: DataFrame, folder: str, item_count: int) -> None:
    spark = postings.sparkSession
    postings.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/postings")
    spark.createDataFrame([(item_count,)], "item_count long").coalesce(1).write.mode("overwrite").json(f"{folder}/postings-manifest")


#: Records whose postings a task makes and sorts by kind when they are saved.
TASK_RECORDS = 20_000


def load_or_build(spark: SparkSession, folder: str, catalog: DataFrame) -> DataFrame:
    """Saved postings if they were made of as many records as the catalog has; else new ones, saved."""
    n = catalog.count()
    try:
        saved = spark.read.schema("item_count long").json(f"{folder}/postings-manifest").first()
        if saved and saved["item_count"] == n:
            return spark.read.parquet(f"{folder}/postings").select("kind", "key", "id")
    except AnalysisException:
        pass
    # a file of many records in one piece would be a task that sorts all of its postings
    save(build(catalog.repartition(-(-n // TASK_RECORDS)) if n > TASK_RECORDS else catalog), folder, n)
    return spark.read.parquet(f"{folder}/postings").select("kind", "key", "id")
