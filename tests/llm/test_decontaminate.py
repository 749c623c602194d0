import random

from pathlore.llm import decontaminate as dc
from pathlore.llm.decontaminate import Items, contained_items, op5_decontaminate

from .conftest import SF
from .test_near_dedup import sets_of


def brute(docs, items):
    sets = [(i, sets_of(t)) for i, t in items]
    out = {}
    for key, text in docs:
        own = sets_of(text)
        out[key] = sorted(i for i, s in sets if s and 100 * len(s & own) >= 75 * len(s))
    return out


def test_op5_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute(docs, items)
    rows = op5_decontaminate(spark, SF).collect()
    assert {r.doc_id: sorted(r.item_ids) for r in rows} == want
    assert all(r.contaminated == bool(want[r.doc_id]) != r.kept for r in rows)
    assert sum(map(bool, want.values())) > 5


def test_items_of_all_sizes_in_long_documents():
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(10**6)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 7, 12, 13, 20, 40, 70, 150, 400, 1000])]
    docs = []
    for i, text in items:
        words = text.split()
        if len(words) > 12:  # some words changed, so that about 0.8 of the shingles are left
            for _ in range(max(1, len(words) // 30)):
                words[rng.randrange(len(words))] = word()
        docs.append((i, " ".join([word() for _ in range(rng.randrange(20_000))] + words + [word() for _ in range(rng.randrange(3000))])))
    docs.append((100, " ".join(word() for _ in range(3000))))
    found = Items(items).hits([t for _, t in docs])
    want = brute(docs, items)
    assert {k: sorted(h["item_id"] for h in hits) for (k, _), hits in zip(docs, found, strict=True)} == want


def test_scattered_and_very_short_items():
    """Items whose shingles lie all over a long text, and items of one or two shingles, are found without exception."""
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(10**6)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 5, 6, 40, 120] * 20)]
    docs = []
    for i, text in items:
        words = text.split()
        parts = [words[j : j + 5] for j in range(max(1, len(words) - 4))]
        gone = set(rng.sample(range(len(parts)), len(parts) * (22 + i % 6) // 100))
        docs.append((i, " ".join(w for j, p in enumerate(parts) if j not in gone for w in [*p, *[word() for _ in range(rng.randrange(20, 60))]])))
    found = Items(items, scattered=True).hits([t for _, t in docs])
    want = brute(docs, items)
    assert {k: sorted(h["item_id"] for h in hits) for (k, _), hits in zip(docs, found, strict=True)} == want
    assert 60 < sum(map(bool, want.values())) < 120


def test_windows_alone_find_passages():
    """Recall of the search by windows, of passages with a few words changed; only tiny items are looked up otherwise."""
    rng = random.Random(10)
    word = lambda: "w%d" % rng.randrange(10**6)
    items, docs = [], []
    for i in range(400):
        words = [word() for _ in range(rng.choice([7, 8, 12, 20, 35, 70, 140]))]
        items.append((i, " ".join(words)))
        if len(words) > 12:
            words[rng.randrange(len(words))] = word()
        docs.append((i, " ".join([word() for _ in range(rng.randrange(3000))] + words + [word() for _ in range(rng.randrange(500))])))
    few = Items(items)
    assert not len(few.heads)
    want, found = brute(docs, items), few.hits([t for _, t in docs])
    right = sum(sorted(h["item_id"] for h in hits) == want[k] for (k, _), hits in zip(docs, found, strict=True))
    assert sum(map(bool, want.values())) > 350 and right >= 399


def test_odd_rows_and_groups(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame([(1, "ONE two three four five six"), (2, None), (3, ""), (4, "long " * 7), (5, "absent words are not here at all")], "item_id long, text string")
    want = brute([(i, r.text) for i, r in enumerate(odd.collect())], [tuple(r) for r in items.collect()])
    for size in (dc.GROUP_BYTES, 30):
        monkeypatch.setattr(dc, "GROUP_BYTES", size)
        out = contained_items(odd.withColumnRenamed("score", "hits").withColumnRenamed("kept", "_more"), items)
        assert out.columns == ["doc_id", "text", "_more", "hits"]
        assert sorted(str(sorted(h.item_id for h in r.hits)) for r in out.collect()) == sorted(map(str, want.values()))
    assert contained_items(empty, items).count() == 0
    assert {len(r.hits) for r in contained_items(odd, items.limit(0)).collect()} == {0}
