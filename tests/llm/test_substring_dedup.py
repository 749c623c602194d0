import hashlib
import itertools
import random

import numpy as np
import pytest

from pathlore.llm import substring_dedup as sd
from pathlore.llm.substring_dedup import op6_substring_dedup, remove_repeats
from pathlore.llm.suffixes import common_prefixes, suffix_array

from .conftest import SF


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_common_prefixes(seed):
    rng = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abcdefgh \xff"
    data = b"".join(bytes(rng.choices(letters, k=rng.randrange(1, 40))) * rng.choice([1, 1, 3]) for _ in range(60))
    text = np.frombuffer(data, np.uint8)
    sa = suffix_array(text)
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    plcp = common_prefixes(text, sa)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        n = 0
        while a + n < len(data) and b + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        assert plcp[b] == n
    assert plcp[sa[0]] == 0


def test_suffix_arrays_of_small_and_plain_texts():
    for data in (b"", b"a", b"aaaaaaaa", b"abababab", b"zyx", b"mississippi"):
        assert suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_suffix_arrays_of_all_short_texts():
    for n in range(1, 9):
        for letters in itertools.product(b"ab", repeat=n):
            data = bytes(letters)
            assert suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(n), key=lambda i: data[i:]), data


def test_suffix_arrays_of_random_texts():
    rng = random.Random(11)
    for _ in range(3000):
        data = bytes(rng.choices(rng.choice([b"ab", b"abc", bytes(range(256))]), k=rng.randrange(1, 60)))
        assert suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:]), data


def brute(rows):
    """[(id, text)] -> sorted [(id, bytes, removed, spans, digest)]."""
    key = lambda i: -(2**63) if i is None else i
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            if key(i) < least.get(s, 2**63):
                least[s] = key(i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < key(i):
                gone[p + 1 : p + 51] = True
        left = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(
        ((r.doc_id, r.n_bytes, sum(s.high - s.low for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str
    )


def test_op6_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op6_substring_dedup(spark, SF).collect()), key=str) == brute(docs)


def test_shared_passages_ties_and_batches(spark, monkeypatch):
    monkeypatch.setattr(sd, "BATCH_BYTES", 2000)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé ", k=7))
    pool = ["".join(word() for _ in range(rng.randrange(3, 20))) for _ in range(8)]
    rows = [(rng.randrange(80), "".join(rng.choice(pool) if rng.random() < 0.5 else word() for _ in range(rng.randrange(12)))) for _ in range(150)]
    rows += [(200 + i, "x" * (45 + i)) for i in range(10)] + [(300, "ab" * 200), (301, "ab" * 150)] + rows[:3]
    assert digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))) == brute(rows)


@pytest.mark.parametrize("seed", range(5))
def test_tables_of_eight_rows(spark, seed):
    """So few anchors that all names of a shard's substrings are distinct, now and then."""
    rng = random.Random(seed)
    rows = []
    for table in range(20):  # each with letters of its own, so that the tables don't meet
        letters = chr(0x4E00 + table) + chr(0x5E00 + table) + "ab"[table % 2]
        own = lambda n, letters=letters: "".join(rng.choices(letters, k=n))
        pool = [own(rng.randrange(20, 60)) for _ in range(3)]
        rows += [(8 * table + i, "".join(rng.choice([rng.choice(pool), own(rng.randrange(9))]) for _ in range(rng.randrange(1, 6)))) for i in range(8)]
    assert digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))) == brute(rows)


def test_a_long_text_of_one_character(spark):
    """Every place of it is an anchor and all its strings are equal."""
    tail = "".join(random.Random(4).choices("abcdefgh ", k=300))
    rows = [(1, "a" * 1_000_000), (2, "a" * 400_000 + tail), (3, tail + "a" * 49), (4, tail[:200])]
    got = {r.doc_id: [(s.low, s.high) for s in r.spans] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(0, 400_000)], 3: [(0, 300)], 4: [(0, 200)]}


def test_odd_rows(spark, odd, empty):
    assert digest(remove_repeats(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert remove_repeats(empty).count() == 0
