import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from pathlore.llm import divergence
from pathlore.llm.divergence import OP12_SQL, audit, op12_divergence

from .conftest import SF

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    """[(text, lang, source)] -> sorted rows of the audit, every term against every pair."""
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(UPPER))) for text, lang, source in rows]
    n, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        n[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {x[0] for x in docs}:
        kept = [t for t, k in df[lang].items() if k >= least]
        sources = sorted({s for x, s, _ in docs if x == lang})
        share = {}
        total = sum(n[lang, s][t] for s in sources for t in kept)
        for s in sources:
            size = sum(n[lang, s][t] for t in kept)
            share[s] = {t: 1 + 10**9 * (n[lang, s][t] + 2) // (size + 2 * len(kept)) for t in kept}
        whole = {t: 1 + 10**9 * (sum(n[lang, s][t] for s in sources) + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = sorted((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(share[s][t], whole[t]), t.encode()) for t in kept if n[lang, s][t] and share[s][t] > whole[t])
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_op12_equals_sql_and_brute_force(spark):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    own = got(op12_divergence(spark, SF))
    assert own == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(OP12_SQL)
    order = [[c[0] for c in found.description].index(c) for c in ("lang", "source", "part", "item", "value", "rank")]
    assert sorted(tuple(r[i] for i in order) for r in found.fetchall()) == own


@pytest.mark.parametrize("seed", range(3))
def test_small_tables(spark, monkeypatch, seed):
    """Few and many sources, counts that many terms have in common, groups without terms, pieces of texts and of trees."""
    monkeypatch.setattr(divergence, "AT_ONCE", 7)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 11)
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    rng = random.Random(seed)
    words = [w + x for w in ("a", "Bc", "é", "日本", "straße") for x in ("", "x", "Y", "zz")]
    rows = [
        (" 1.".join(rng.choices(words[: rng.choice([2, 20])], k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", None, "é", "é"] if seed else ["one"]))
        for _ in range(150)
    ]
    rows += [("123 !!", "xx", "a"), (None, "xx", "b"), ("once only", "yy", "c"), (rows[0][0], "en", "s1")]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "text string, lang string, source string, p double, term string").repartition(5)
    for least in (1, 10):
        assert got(audit(docs, least_docs=least)) == brute(rows, least)


def test_shares_of_large_counts(spark):
    big = [(10**13, 3 * 10**13, 10**12), (0, 0, 5), (7, 9 * 10**12, 1), (0, 0, 0)]
    df = spark.createDataFrame(big, "c long, n long, v long")
    from pyspark.sql import functions as F

    found = [r.p for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()]
    assert found == [1 + 10**9 * (c + 2) // (n + 2 * v) if n + v else 1 for c, n, v in big]


def test_empty(spark):
    assert audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
