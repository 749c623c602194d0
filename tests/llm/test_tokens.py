import zlib
from collections import defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from pathlore.llm import tokens
from pathlore.llm._common import new_folder
from pathlore.llm.keyed_ids import PerfectHash, Shard, fingerprint, get_ids, op7_keyed_ids, scan_ids, write_ids
from pathlore.llm.packing import op1_packing, pack, place

from .conftest import SF

VOCABULARIES = [("word_bpe_49k.json", 1, True), ("byte_bpe_50k.json", 2, False)]
TEXTS = [
    "", " ", "  a", "a\n\n b\t\tc  ", "don't's 's é̀ x<|endoftext|> y <|endoftext|>", "a\x1cb c", "　x\xa0y z\x85q",
    "İ ΑΣ ΟΔΟΣ'll", "a  b", " \n 's", "½ ª µ², 漢字かな 🙂", "x\x00y", "ÀÉ'S won'T", "12 345", "\r\n\r\n x",
]


@pytest.mark.parametrize(("name", "end", "drops_space"), VOCABULARIES)
def test_encoder_equals_whole_texts(spark, name, end, drops_space, monkeypatch):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    want = [e.ids + [end] for e in Tokenizer.from_file(tokens.vocabulary(name)).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "MEMO_PARTS", 2000)  # so that it starts anew now and then
    encode = tokens.Encoder(tokens.vocabulary(name), end, drops_space)
    got = []
    for i in range(0, len(texts), 20):
        ids, counts = encode(texts[i : i + 20])
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == want


def crcs(spark, name, end):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    ids = [e.ids + [end] for e in Tokenizer.from_file(tokens.vocabulary(name)).encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    return {r.doc_id: np.array(x, "<u4") for r, x in zip(rows, ids, strict=True)}


def test_op7_equals_brute_force(spark):
    start, want = 0, []
    for key, ids in crcs(spark, "byte_bpe_50k.json", 2).items():
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = op7_keyed_ids(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    assert all(r.keyed for r in got)


def byte_ids(docs, folder, **kw):
    return write_ids(docs, folder, lambda: tokens.vocabulary("byte_bpe_50k.json"), end=2, drops_space=False, **kw)


def test_keyed_access_and_odd_rows(spark, odd):
    folder = new_folder(spark, "ids")
    byte_ids(odd, folder, shard_bytes=1000)
    rows = scan_ids(spark, folder).collect()
    assert len(rows) == odd.count() and all(r.found for r in rows)
    assert [r.key for r in sorted(rows, key=lambda r: r.start)] == [None, None, 1, 1, 2, 3, 4, 5, 6]
    encode = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), 2, False)
    got = {r.key: r.ids for r in get_ids(spark, folder, spark.createDataFrame([(1,), (2,), (6,), (77,), (None,)], "doc_id long")).collect()}
    one = encode(["One two three four five six seven"])[0].tobytes()
    assert got == {1: one * 2, 2: np.uint32(2).tobytes(), 6: encode(["long " * 60_000])[0].tobytes()}


def test_single_reads_equal_whole_tables(spark):
    docs = spark.createDataFrame([(3 * (i // 2), f"text {i} " * (i % 5)) for i in range(400)] + [(None, "x"), (None, None)], "doc_id long, text string")
    folder = new_folder(spark, "ids")
    manifest = byte_ids(docs, folder, shard_bytes=2000)
    fs, path = pafs.FileSystem.from_uri(folder)
    held = {}
    for shard in (Shard(fs, f"{path}/{x['file']}") for x in manifest["shards"]):
        keys = np.arange(-5, 700)
        got = [shard.entry(k) for k in keys.tolist()]
        assert not shard.whole  # no table was read whole
        slots, found = shard.find(keys)
        assert got == [(int(a), int(n)) if ok else (-1, 0) for a, n, ok in zip(slots["start"], slots["n"], found, strict=True)]
        for k, (start, n) in zip(keys.tolist(), got, strict=True):
            held[k] = held.get(k, b"") + shard.ids(start, n) if n else held.get(k, b"")
    rows = scan_ids(spark, folder).collect()
    want = {}
    for r in sorted((r for r in rows if r.key is not None), key=lambda r: r.start):
        want[r.key] = want.get(r.key, b"") + r.ids
    assert {k: v for k, v in held.items() if v} == want and len(rows) == 402


def test_places_of_rows_come_from_the_index(spark):
    docs = spark.createDataFrame([(i // 2 if i < 20 else i, f"text {i}") for i in range(50)], "doc_id long, text string")
    folder = new_folder(spark, "ids")
    file = byte_ids(docs, folder)["shards"][0]["file"]
    fs, path = pafs.FileSystem.from_uri(folder)
    right = Shard(fs, f"{path}/{file}").rows()
    assert right[2].all() and (np.diff(right[0]) == right[1][:-1]).all()
    for column in ("start", "print"):
        shard = Shard(fs, f"{path}/{file}")
        slots = shard.table("slot").copy()
        slots[column] += 1
        shard.whole["slot"] = slots
        start, _, found = shard.rows()
        assert (start == right[0] + 1).all() if column == "start" else not found.any()


def test_ids_of_an_empty_table(spark, empty):
    folder = new_folder(spark, "ids")
    assert byte_ids(empty, folder)["shards"] == []
    assert scan_ids(spark, folder).count() == 0
    assert get_ids(spark, folder, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20_000))
    hashed = PerfectHash.of(keys)
    assert sorted(hashed(keys).tolist()) == list(range(len(keys)))
    assert sum(len(x) for x in hashed.levels) * 64 < 5 * len(keys)
    assert len(np.unique(fingerprint(keys))) > 19_990
    assert (PerfectHash.of(np.zeros(0, np.int64))(keys[:3]) == -1).all()


def check_pieces(rows, docs, end_total):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= end_total and len(pieces) <= 256
    for key, ids in docs.items():
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert set(by_doc) == set(docs)
    return sum(r.length for r in rows) / (end_total * len(by_sequence))


def test_op1_packs_every_id_once(spark):
    assert check_pieces(op1_packing(spark, SF).collect(), crcs(spark, "word_bpe_49k.json", 1), 2048) > 0.995


def words(docs, **kw):
    return pack(docs, lambda: tokens.vocabulary("word_bpe_49k.json"), end=1, drops_space=True, **kw)


def test_packing_odd_rows(spark, odd, empty):
    rows = words(odd, max_tokens=64, max_segments=4).collect()
    encode = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), 1, True)
    assert sum(r.length for r in rows) == sum(encode([r.text])[1][0] for r in odd.collect())
    assert b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == 6), key=lambda r: r.start)) == encode(["long " * 60_000])[0].tobytes()
    assert words(empty).count() == 0


def test_limits_on_segments_and_loss(spark):
    data = [(i, "prompt " * (i % 50), "answer " * (1 + i % 30)) for i in range(500)]
    rows = words(spark.createDataFrame(data, "doc_id long, ask string, text string"), prompt="ask", max_tokens=128, max_segments=3, max_loss=40).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for pieces in by.values():
        assert len(pieces) <= 3 and sum(r.length for r in pieces) <= 128 and sum(r.loss for r in pieces) <= 40
    for i, ask, text in data:
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.length for r in own) == len((ask + text).split()) + 1
        assert sum(r.loss for r in own) == len(text.split()) + 1


def test_place_takes_the_largest_dot_product():
    """Each piece that is placed whole has, of those that fit, the largest product of its demands and the room that is left."""
    rng = np.random.default_rng(5)
    others = 0
    for _ in range(30):
        n, limits = 40, (100, 6, 40)
        sizes = rng.integers(1, 60, n)
        losses = np.minimum(sizes, rng.integers(0, 40, n) * rng.integers(0, 2, n))
        most = np.array(limits, float)
        weight = np.array([sizes.mean() / 100, 1 / 6, losses.mean() / 40])
        demand = np.stack([sizes / 100, np.full(n, 1 / 6), losses / 40], axis=1)
        left, room, now = set(range(n)), np.array(limits), 0
        for sequence, piece, start, length, offset in place(sizes, losses, limits):
            if sequence != now:
                room, now = np.array(limits), sequence
            assert offset == limits[0] - room[0]
            fits = [i for i in left if sizes[i] <= room[0] and losses[i] <= room[2]]
            if start or not fits:
                break  # pieces are cut from here on, which changes what they ask for
            worth = demand @ (weight * room / most)
            assert length == sizes[piece] and worth[piece] >= max(worth[i] for i in fits) - 1e-12
            others += sizes[piece] < max(sizes[i] for i in fits)
            left.discard(piece)
            room = room - (length, 1, losses[piece])
    assert others > 20
