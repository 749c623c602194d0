"""Long repeated lines against a brute force that asks only whether a long line has an earlier copy."""

import random
from collections import Counter

import corpus_pipeline
from pathlore.llm.line_dedup import LEAST_CHARS, line_dedup, op10_line_dedup

from .conftest import SF


def split(texts):
    return Counter(x.rstrip(" ") for t in texts for x in (t or "").split("\n"))


def check(before, after):
    """Of every long line one copy is left, and of any other at least one; before and after: {id: text}."""
    had, has = split(before.values()), split(after.values())
    assert {x: 1 for x in had if len(x) >= LEAST_CHARS} == {x: n for x, n in has.items() if len(x) >= LEAST_CHARS}
    assert {x for x in had if x} - has.keys() == set()
    seen = set()
    for k in sorted(before):  # the copy that is left is the earliest
        new = split([before[k]]).keys() - seen
        assert {x for x in new if x} <= split([after[k]]).keys()
        seen |= new


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, after = texts(docs), texts(line_dedup(docs.select("doc_id", "text"), long_lines=True))
    check(before, after)
    lines = {k: len((t or "").split("\n")) for k, t in before.items()}
    gone = {r.doc_id: (r.n_lines, r.n_removed) for r in op10_line_dedup(spark, SF).collect()}
    assert {k: n for k, (n, _) in gone.items()} == lines
    kept = {k: sum(split([t]).values()) if t or lines[k] != gone[k][1] else 0 for k, t in after.items()}
    assert {k: n - m for k, (n, m) in gone.items()} == kept


def test_pipeline_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(texts(docs), texts(corpus_pipeline.drop_repeated_lines(spark, docs, SF)))


def test_single_lines_and_short_runs(spark):
    rng = random.Random(5)
    own = lambda: "%020x" % rng.getrandbits(80)
    pool = ["line number %d of the pool, of length enough to go alone" % i for i in range(8)]
    rows = [(i, "\n".join(rng.choice(pool) + " " * rng.randrange(3) if rng.random() < 0.4 else own() for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    rows += [(100, pool[0]), (101, pool[0] + "  "), (102, own()), (103, None), (104, "x" * 49 + " "), (105, "x" * 49 + " "), (106, "y" * 50), (107, "y" * 50)]
    after = texts(line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), long_lines=True))
    check(dict(rows), after)
    assert after[100] == after[101] == after[107] == "" and after[105] == rows[-3][1] and after[103] is None
