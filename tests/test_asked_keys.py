"""Postings of few keys are looked for in the records: the same rows, without any other gram as a row."""

from pathlore.operators import postings as ps
from pathlore.operators import search
from pathlore.plans import queries
from pathlore.sources import catalog as ct

NAMES = ["rering ring.pdf", "été жр.pdf", "re", "r.x", "", ".re", "a\0b ring", "a\r\nring.PDF", "产品 ring.pdf", "ring ring", "rr", "ri ng", "ringr.pdf"]


def records(spark):
    extra = spark.createDataFrame([(f"/a{i}/{n}", i % 5 == 4) for i, n in enumerate(NAMES)], "path string, is_directory boolean")
    extra = extra.selectExpr("path", "1L AS size", "is_directory", "null AS created_at", "null AS modified_at")
    return queries.catalog(spark, "/root/testdata/sf0.001").unionByName(ct.records(extra)).repartition(3).localCheckpoint()


def test_postings_of_few_keys_equal_those_of_all(spark):
    cat = records(spark)
    whole = {tuple(r) for r in ps.build(cat).collect()}
    every = sorted({r[:2] for r in whole})
    absent = [("gram3", "zzq"), ("gram2", "ring"), ("prefix1", "ri"), ("exact", "zzzq"), ("extension", "zzz"), ("gram3", "r\0r"), ("gram2", "\r\n")]
    for keys in (every + absent, [("gram3", "rin"), ("extension", "pdf")], []):
        want = {r for r in whole if r[:2] in set(keys)}
        got = [tuple(r) for r in ps.of_keys(cat, keys).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_other_gram_is_a_row(spark, monkeypatch):
    """Few keys: build() sees the records that aren't plain alone. Many: all of them."""
    cat, seen, real = records(spark), [], ps.build

    def build(catalog, *a, **k):
        seen.append(catalog.count())
        return real(catalog, *a, **k)

    monkeypatch.setattr(ps, "build", build)
    monkeypatch.setattr(search, "build", build)
    keys = real(cat).where("kind = 'gram3' and key in ('rin', 'ing') or key = 'pdf'").select("kind", "key").distinct()
    few = {tuple(r) for r in search.asked_postings(cat, keys).collect()}
    assert len(seen) == 1 and seen[0] < 10
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 1)
    assert few and few == {tuple(r) for r in search.asked_postings(cat, keys).collect()} and seen[1:] == [cat.count()]
