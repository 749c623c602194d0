import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlore.llm import pii
from pathlore.llm.pii import KINDS, LABELS, base_spans, find_personal, op13_pii

from .conftest import SF

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    """The patterns as they are stated, one after the other."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            doubled = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": lambda: 9 <= len(digits) <= 15}
            if ok[kind]():
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    cards = ["4845168114407329", "4417744280351547", "0000000000000"]
    for _ in range(4000):
        text = "".join(rng.choice([rng.choice("a%.@-+ 019(é\n"), rng.choice(cards), "1.2.3.4", "a@b.c", "+1 (555)", "256", "007."]) for _ in range(rng.randrange(1, 30)))
        assert base_spans(text) == brute(text), text


def test_long_runs_take_no_long_time():
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1 " * 500_000, "+1" + " " * 1_000_000, "1." * 500_000, "a@" * 300_000, "-" * 1_000_000 + "@a.b"):
        found = base_spans(text)
        assert found == ([(0, "email", len(text))] if text.endswith(".b") else [] if "." not in text else found)


def test_paths_equal_all_paths():
    rng = np.random.default_rng(0)
    k = len(LABELS)
    moves, sizes = rng.normal(size=(k, k)) * 2, [1, 3, 0, 2, 4, 1]
    ends = np.cumsum([0, *sizes])
    emit = rng.normal(size=(ends[-1], k)) * 2
    got = pii.viterbi(emit, ends, moves)
    for a, n in zip(ends[:-1].tolist(), sizes, strict=True):
        value = lambda p, a=a: sum(emit[a + i, y] for i, y in enumerate(p)) + sum(moves[x, y] for x, y in zip((0, *p), (*p, 0), strict=True))
        if n:
            assert tuple(got[a : a + n].tolist()) == max(itertools.product(range(k), repeat=n), key=value)


def test_held_out_rows_and_skipped_words(field):
    """Right labels for rows that it wasn't trained on; the words it skips have the labels of whole paths."""
    rows = pii.labelled(2000, seed=99)
    reader = pii.Reader(field)
    assert reader.depth is not None
    got = reader.labels([t.split() for t, _ in rows])
    right = sum(pii._row(*r)[1] == g.tolist() for r, g in zip(rows, got, strict=True))
    assert right >= 0.99 * len(rows)
    rng = random.Random(1)
    texts = [" ".join(rng.choice([t for t, _ in rows] + ["lorem ipsum dolor sit amet"] * 3000) for _ in range(rng.randrange(12))).split() for _ in range(60)]
    short = reader.labels(texts)
    reader.depth = None
    assert all((a == b).all() for a, b in zip(short, reader.labels(texts), strict=True))


def test_added_spans(field):
    """Two cards in one run of digits, addresses spelt out, numbers without a plus; and what must stay clean."""
    reader = pii.Reader(field)
    texts = [
        "of the 7536784127813050 4845168114407329 in", "write to anna.b(at)mail[dot]com, today", "please call (555) 123-4567 now", "lorem 2353820953013749 ipsum", "version 1.2.3 of 2024-01-02, 12.50",
        'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" |', "plain words, at the dot of it", "", "300.1.2.3 was seen 1234 5678 9012 3456 times", "mail a@b.example.com or +1 (826) 555-4081 190.137.223.204 x",
    ]
    found = [[(s["kind"], t[s["start"] : s["end"]]) for s in spans if not s["base"]] for t, spans in zip(texts, pii.all_spans(texts, reader), strict=True)]
    assert pii.luhn("7536784127813050")
    assert found[0] == [("card", "7536784127813050"), ("card", "4845168114407329")]
    assert found[1] == [("email", "anna.b(at)mail[dot]com")] and found[2] == [("phone", "(555) 123-4567")]
    assert found[3:9] == [[]] * 6 and all(k != "email" for k, _ in found[9])


def test_op13_equals_the_patterns(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        told = [f"{k}:{a}:{b}" for a, k, b in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(told) <= set(spans) and len(spans) == len(told) + r.n_added


def test_odd_rows(spark, odd, empty, field):
    rows = find_personal(odd.withColumn("found", F.lit(1)), field).collect()
    assert len(rows) == odd.count() and all(r.found == [] for r in rows)
    assert find_personal(empty, field).count() == 0
    docs = spark.createDataFrame([(1, "x a@b.cd 1.2.3.4"), (1, "x a@b.cd 1.2.3.4"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.found]) for r in find_personal(docs, field).collect())
    assert got == [(1, [("email", 2, 8, True), ("ip", 9, 16, True)])] * 2 + [(2, [])]


def test_a_table_of_ones_own(spark):
    rows = [(t, [{"start": a, "kind": k, "end": b} for a, k, b in s]) for t, s in pii.labelled(300, seed=3)] + [(None, None)]
    own = pii.train(spark.createDataFrame(rows, "text string, spans array<struct<start:long,kind:string,end:long>>"))
    got = pii.Reader(own).labels([t.split() for t, _ in pii.labelled(300)])
    assert sum(pii._row(*r)[1] == g.tolist() for r, g in zip(pii.labelled(300), got, strict=True)) > 280
