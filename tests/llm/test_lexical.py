import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from pathlore.llm import lexical
from pathlore.llm.lexical import OP11_SQL, Best, Items, op11_lexical, ranked

from .conftest import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=10):
    """[(id, text)], [(item, text)] -> sorted [(item, rank, id, score)], every document against every item."""
    terms = lambda text: TERM.findall((text or "").translate(UPPER))
    known = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n, length = len(known), sum(c.total() for _, c in known)
    df = Counter(t for _, c in known for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in known:
            m = 10 + 90 * c.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, rank, i if there else None, -s) for rank, (s, there, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_op11_equals_sql_and_brute_force(spark):
    own = got(op11_lexical(spark, SF).select("item_id", "rank", "doc_id", "score"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({OP11_SQL})").fetchall(), key=str) == own
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()]
    assert own == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


@pytest.mark.parametrize("seed", range(3))
def test_small_tables(spark, monkeypatch, seed):
    """Many ties, copies and small trees; for one seed a vocabulary that isn't broadcast, and items in several parts."""
    for name, value in (("BLOCK", 16), ("LEAF", 2), ("ENTRIES", 60), ("ITEMS", 3)):
        monkeypatch.setattr(lexical, name, value)
    if seed == 2:
        monkeypatch.setattr(lexical, "BROADCAST_BYTES", 400)
    rng = random.Random(seed)
    words = [w + str(i) for w in ("a", "B", "é", "日本", "ß") for i in range(8)]
    text = lambda n: " -".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(n)))
    docs = [(rng.choice([None, *range(90)]), text(30)) for _ in range(200)]
    docs += [(i, docs[0][1]) for i in range(300, 330)] + docs[:5] + [(1, None), (2, ""), (3, "?! "), (4, "a0 " * 20_000)]
    items = [(i, text(12)) for i in range(20)] + [(30, None), (31, "nowhere"), (0, "A0 b1")]
    left = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, qid int, tids string").repartition(3)
    assert got(ranked(left, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_bounds_hold_and_prune():
    """Documents near to one another: most are never scored, and the best are those of all scores."""
    rng = np.random.default_rng(3)
    n, groups = 4000, 80
    own = [np.sort(rng.choice(2000, 40, replace=False)) for _ in range(groups)]
    rows = [own[i % groups] for i in range(n)]
    tids = np.concatenate(rows)
    impacts = np.concatenate([900_000 - 100 * (i // groups) - np.arange(40) for i in range(n)]).astype(np.int64)
    ends = np.arange(n + 1) * 40
    weight = rng.integers(1000, 8000, 2000)
    asked = [own[i][:30] for i in range(0, groups, 9)]
    items = Items(np.arange(len(asked)), np.arange(len(asked) + 1) * 30, np.concatenate(asked), weight[np.concatenate(asked)])
    best = [Best() for _ in asked]
    scored = lexical.search_block(ends, tids, impacts, list(range(n)), items, best)
    for q, terms in enumerate(asked):
        score = np.add.reduceat(np.where(np.isin(tids, terms), weight[tids], 0) * impacts, ends[:-1])
        assert best[q] == sorted((-int(s), i) for i, s in enumerate(score) if s > 0)[:10]
    assert scored < 0.1 * n * len(asked)


def test_empty(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [ranked(docs, items).count(), ranked(some, items).count(), ranked(docs, some.withColumnRenamed("doc_id", "item_id")).count()] == [0, 0, 0]
