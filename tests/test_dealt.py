"""Files of one row group are dealt to even tasks, and a batch makes only the postings that its queries can ask for."""

from pathlore.functions import query as qy
from pathlore.operators import postings as ps
from pathlore.operators import search
from pathlore.plans import queries
from pathlore.sources import catalog as ct


def test_a_file_of_one_row_group_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ct, "TASK_RECORDS", 50)
    listing = queries.files(spark, "/root/testdata/sf0.01", "files_part")  # one row group
    sizes = lambda df: [r[0] for r in df.groupBy(queries.F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes(listing)) == listing.count()
    got = queries.catalog(spark, "/root/testdata/sf0.01")
    assert max(sizes(got)) < listing.count() / 8 and got.count() == listing.count()
    even = listing.repartition(8)
    assert ct.dealt(even) is even
    assert ct.dealt(listing.where("false")).count() == 0


def test_postings_of_asked_keys_answer_like_all(spark):
    raw = [(i, r) for i, r in enumerate(["ring", "red widget", "r", "re", "ext:pdf", ".pdf plate", "zz", "zzzq", "é", "été", "ж р", " ", "promo  a", "kind:image", "rr"])]
    q = qy.parse(spark.createDataFrame(raw, "query_id int, raw string"), queries.now())
    cat = queries.catalog(spark, "/root/testdata/sf0.001")
    extra = spark.createDataFrame([("/a/été жр.pdf",), ("/a/re",), ("/b/r.x",)], "path string").selectExpr("path", "1L AS size", "false AS is_directory", "null AS created_at", "null AS modified_at")
    cat = cat.unionByName(ct.records(extra)).localCheckpoint()
    whole = ps.build(cat).localCheckpoint()
    some = search.only(whole, search.asked(q)).localCheckpoint()
    assert 0 < some.count() < whole.count() / 4
    for rarest in (True, False):
        every = {tuple(r) for r in search.candidates(q, whole, rarest).collect()}
        assert every and every == {tuple(r) for r in search.candidates(q, ps.blocked(some, 2), rarest).collect()}
    assert {tuple(r) for r in search.routes(q, whole).collect()} == {tuple(r) for r in search.routes(q, some).collect()}


def test_key_counts_equal_frequencies(spark):
    cat = queries.catalog(spark, "/root/testdata/sf0.001")
    for kinds in (ps.KINDS, ["exact"], ["gram3"]):
        assert sorted(map(tuple, ps.key_counts(cat, kinds).collect())) == sorted(map(tuple, ps.frequencies(ps.build(cat, kinds)).collect()))
