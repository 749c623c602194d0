"""Token ids as raw binary shards with a minimal perfect hash index over document keys.

File format (all little-endian). One shard is ``payload | tables | tail``:

* payload: the ids of all documents of the shard, unsigned, of 2 or 4 bytes (the tail says), nothing between them;
* tables, for the shard's rows in file order: key int64, key-is-null uint8, number of ids uint64; then a record for each
  hash slot: fingerprint uint32, first row uint32, number of rows uint32, first id uint64, number of ids uint64; then the
  hash itself: bits of each level in 64-bit words and the count of set bits before each word, uint32;
* tail: a JSON text with the sizes and places of the above, its length as uint32, and eight magic bytes.

``manifest.json`` beside the shards lists them in key order with their key ranges and how many ids lie before each.
A keyed read finds the shard by its range, reads a word of the hash for each level that the key passes and the record
of its slot, compares the fingerprint, and reads one slice: a few short reads, however long the shard is.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.llm import tokens
from pathlore.llm._common import new_folder, read, text_or_empty

MAGIC = b"PLORIDS1"
#: Bits of a hash level for each key that reaches it.
GAMMA = 2.0
#: Types of a shard's tables.
_SLOT = np.dtype([("print", "<u4"), ("first", "<u4"), ("rows", "<u4"), ("start", "<u8"), ("n", "<u8")])
_TABLES = {"key": np.dtype("<i8"), "null": np.dtype("u1"), "n_ids": np.dtype("<u8"), "slot": _SLOT, "bits": np.dtype("<u8"), "before": np.dtype("<u4")}
#: From one key for so many of a shard's slots on, its tables are read whole.
MANY_KEYS = 64
_STATS = "file string, n_docs long, n_ids long, n_keyed long, first_key long, last_key long"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit keys for each seed (the finalizer of a public generator)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys onto 0..n-1: on each level the keys that no other meets keep their bit, the rest go on."""

    def __init__(self, levels: list[np.ndarray], before: np.ndarray) -> None:
        self.levels, self.before = levels, before
        self.words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            bits = 64 * max(1, int(np.ceil(GAMMA * len(keys) / 64)))
            at = (_mix(keys, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        ones = np.bitwise_count(np.concatenate(levels)).astype(np.uint32) if levels else np.zeros(0, np.uint32)
        return cls(levels, (np.cumsum(ones) - ones).astype(np.uint32))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for most keys that aren't in (the fingerprint tells the others)."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, words in enumerate(self.levels):
            if not len(left):
                break
            at = _mix(keys[left], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit] + base, bit[hit]
            below = self.words[w] & ((np.uint64(1) << b) - np.uint64(1))
            out[left[hit]] = self.before[w].astype(np.int64) + np.bitwise_count(below)
            left, base = left[~hit], base + len(words)
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class _ShardWriter:
    """Streams one shard to a name of its own, then moves it to its final name, so that a repeated task does no harm."""

    def __init__(self, folder: str, shard: int, width: int) -> None:
        self.width = width
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.name = f"shard-{shard:07d}.ids"
        self.temp = f"{self.folder}/_{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.nulls.append(keys.is_null().to_numpy(zero_copy_only=False))
        self.counts.append(counts.astype(np.uint64))

    def close(self) -> tuple:
        keys, nulls, counts = np.concatenate(self.keys), np.concatenate(self.nulls), np.concatenate(self.counts)
        keyed = keys[~nulls]  # ascending, nulls before them
        distinct, first, n = np.unique(keyed, return_index=True, return_counts=True)
        hashed = PerfectHash.of(distinct)
        first = first + int(nulls.sum())
        ends = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
        slots = np.zeros(len(distinct), _SLOT)
        own = hashed(distinct)
        for name, values in (("print", fingerprint(distinct)), ("first", first), ("rows", n), ("start", ends[first]), ("n", ends[first + n] - ends[first])):
            slots[name][own] = values
        tables = {"key": keys, "null": nulls, "n_ids": counts, "slot": slots, "bits": hashed.words, "before": hashed.before}
        at, places = int(counts.sum()) * self.width, {}
        for name, kind in _TABLES.items():
            table = tables[name].astype(kind)
            self.out.write(table.tobytes())
            places[name] = [at, len(table)]
            at += table.nbytes
        tail = json.dumps({"width": self.width, "tables": places, "levels": [len(x) for x in hashed.levels]}).encode()
        self.out.write(tail + np.uint32(len(tail)).tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.temp, f"{self.folder}/{self.name}")
        ends = (int(keyed[0]), int(keyed[-1])) if len(keyed) else (None, None)
        return self.name, len(keys), int(counts.sum()), len(keyed), *ends


class Shard:
    """Reads a shard. Its tables are read when they are wanted whole, its ids by slices."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.file = fs.open_input_file(path)
        size = self.file.size()
        end = self.file.read_at(12, size - 12)
        if end[4:] != MAGIC:
            raise ValueError(f"not a shard of token ids: {path}")
        n = int(np.frombuffer(end[:4], "<u4")[0])
        tail = json.loads(self.file.read_at(n, size - 12 - n))
        self.width, self.levels, self.places = tail["width"], tail["levels"], tail["tables"]
        self.whole: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        """Number of slots."""
        return self.places["slot"][1]

    def table(self, name: str) -> np.ndarray:
        if name not in self.whole:
            at, n = self.places[name]
            self.whole[name] = np.frombuffer(self.file.read_at(n * _TABLES[name].itemsize, at), _TABLES[name])
        return self.whole[name]

    def _one(self, name: str, i: int) -> np.ndarray:
        """One value of a table, by a read of its own."""
        size = _TABLES[name].itemsize
        return np.frombuffer(self.file.read_at(size, self.places[name][0] + i * size), _TABLES[name])[0]

    def entry(self, key: int) -> tuple[int, int]:
        """First id and number of ids of a key, by single reads; (-1, 0) for a key that isn't in."""
        base, one = 0, np.array([key], np.int64)
        for level, words in enumerate(self.levels):
            at = int(_mix(one, level)[0]) % (64 * words)
            word, bit = int(self._one("bits", base + at // 64)), at % 64
            if word >> bit & 1:
                slot = self._one("slot", int(self._one("before", base + at // 64)) + (word & ((1 << bit) - 1)).bit_count())
                ok = slot["print"] == fingerprint(one)[0] and self._one("key", int(slot["first"])) == key
                return (int(slot["start"]), int(slot["n"])) if ok else (-1, 0)
            base += words
        return -1, 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots' records of many keys and which keys are in."""
        slots = self.table("slot")
        if not len(slots):
            return np.zeros(len(keys), _SLOT), np.zeros(len(keys), bool)
        at = PerfectHash(np.split(self.table("bits"), np.cumsum(self.levels)[:-1]), self.table("before"))(keys)
        own = slots[np.maximum(at, 0)]
        return own, (at >= 0) & (own["print"] == fingerprint(keys)) & (self.table("key")[own["first"]] == keys)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id and number of ids of every row in file order, each by its key's slot, and which were found there.

        Rows of one key follow each other from the slot's first id on; null keys have no slot and lie before the rest.
        """
        keys, nulls, counts = self.table("key"), self.table("null") > 0, self.table("n_ids").astype(np.int64)
        slots, found = self.find(keys)
        here, first = np.arange(len(keys)), slots["first"].astype(np.int64)
        found &= (first <= here) & (here < first + slots["rows"])
        ends = np.concatenate([[0], np.cumsum(counts)])
        lead = np.where(found, first, here)
        start = np.where(nulls, ends[:-1], slots["start"].astype(np.int64) + ends[here] - ends[lead])
        n = np.where(nulls | (slots["rows"] > 1), counts, slots["n"].astype(np.int64))
        return start, n, found | nulls

    def ids(self, start: int, n: int) -> bytes:
        """n ids from a place on as unsigned 32-bit, little-endian."""
        data = self.file.read_at(self.width * n, self.width * start)
        return data if self.width == 4 else np.frombuffer(data, f"<u{self.width}").astype("<u4").tobytes()


def write_ids(
    docs: DataFrame, folder: str, vocab: Callable[[], str], end: int, drops_space: bool,
    key: str = "doc_id", text: str = "text", shard_bytes: int = 64 << 20,
) -> dict:
    """Writes the ids of every whole text, in ascending key order, as shards and a manifest; returns the manifest.

    docs has an integer key and a text; other columns aren't read. Null or empty text: the end id alone. Null keys come
    first and have no entry in the index; rows that repeat a key lie side by side and are read together. An empty table
    gives a manifest without shards. Shards are ranges of (key, hash of the text), so that rows of a repeated key can be
    dealt to several tasks; shard_bytes is the size of text that a shard aims at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    ranged = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "key", "tie").sortWithinPartitions("key", "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encode = None, tokens.encoder(vocab(), end, drops_space)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                writer = writer or _ShardWriter(folder, TaskContext.get().partitionId(), 2 if max(encode.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4)
                writer.add(part["key"], *encode(part["text"].to_pylist()))
        if writer:
            names = [x.split()[0] for x in _STATS.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, writer.close(), strict=True))], pa.schema([("file", pa.string()), *[(n, pa.int64()) for n in names[1:]]]))

    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    done = sorted(ranged.drop("tie").mapInArrow(write, _STATS).collect())  # a row for each shard
    start, out = 0, []
    for r in done:
        out.append(r.asDict() | {"start": start})
        start += r["n_ids"]
    manifest = {"end": end, "n_ids": start, "shards": out}
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def scan_ids(spark: SparkSession, folder: str, block: int = 4 << 20) -> DataFrame:
    """Every stored document in file order, read from the files: key, start, n_ids, ids (bytes), found. Place and number
    of its ids are what its key's slot of the index says (null keys, which the index leaves out: the rows' own counts);
    a row that the index doesn't lead to is not found and has nulls there."""
    shards = read_manifest(folder)["shards"]
    files = spark.createDataFrame([(s["file"], s["start"]) for s in shards], "file string, start long")
    schema = "key long, start long, n_ids long, ids binary, found boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(folder)
                shard = Shard(fs, f"{path}/{file}")
                keys, nulls = shard.table("key"), shard.table("null") > 0
                starts, counts, found = shard.rows()
                block_of = np.cumsum(np.where(found, counts, 0)) // block
                cuts = [0, *(np.flatnonzero(np.diff(block_of)) + 1).tolist(), len(keys)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    own, lost = slice(a, b), ~found[a:b]
                    here = list(zip(starts[own].tolist(), counts[own].tolist(), found[own].tolist(), strict=True))
                    low = min((at for at, _, ok in here if ok), default=0)
                    data = memoryview(shard.ids(low, max((at + n for at, n, ok in here if ok), default=low) - low))
                    ids = pa.array([bytes(data[4 * (at - low) : 4 * (at - low + n)]) if ok else None for at, n, ok in here], pa.binary())
                    columns = [pa.array(keys[own], mask=nulls[own]), pa.array(starts[own] + start, mask=lost), pa.array(counts[own], mask=lost), ids, pa.array(found[own])]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_ids", "ids", "found"])

    return files.repartition(max(1, len(shards)), "file").mapInArrow(scan, schema)


def get_ids(spark: SparkSession, folder: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed access: the ids (bytes) of each distinct key that is stored, by hash slot and one slice read.

    Keys are dealt to tasks by the shard whose range holds them; a key that lies in several shards gives a row for each.
    """
    shards = [s for s in read_manifest(folder)["shards"] if s["n_keyed"]]
    lows, highs, files = [s["first_key"] for s in shards], [s["last_key"] for s in shards], [s["file"] for s in shards]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(k, i) for k in batch["key"].to_pylist() for i in range(bisect.bisect_left(highs, k), bisect.bisect_right(lows, k))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["key", "shard"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        at, shard = None, None
        for batch in batches:
            own, of = batch["key"].to_numpy(), batch["shard"].to_numpy()
            for group in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1) if len(of) else []:
                if of[group[0]] != at:
                    at = int(of[group[0]])
                    shard = Shard(fs, f"{path}/{files[at]}")
                wanted = own[group]
                if MANY_KEYS * len(wanted) > len(shard):
                    slots, found = shard.find(wanted)
                    places = zip(slots["start"][found].tolist(), slots["n"][found].tolist(), wanted[found].tolist(), strict=True)
                else:
                    places = ((*shard.entry(k), k) for k in wanted.tolist())
                for start, n, key in places:
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([shard.ids(start, n)], pa.binary())], names=["key", "ids"])

    wanted = keys.select(F.col(key).cast("long").alias("key")).dropna().distinct()
    return wanted.mapInArrow(place, "key long, shard long").repartition("shard").sortWithinPartitions("shard").mapInArrow(fetch, "key long, ids binary")


def op7_keyed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' byte-level ids with end id 2, written as shards and read back by the places that the index gives."""
    folder = new_folder(spark, "op7-ids")
    write_ids(read(spark, sf_dir, "documents"), folder, lambda: tokens.vocabulary("byte_bpe_50k.json"), end=2, drops_space=False, shard_bytes=16 << 20)
    return scan_ids(spark, folder).select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.col("found").alias("keyed")
    )
