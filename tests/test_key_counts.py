"""Counts of keys, made a batch at a time, against the postings; the catalog is read once."""

from pyspark.sql import functions as F

from pathlore.operators import postings as ps

from .test_postings import ODD, names
from .test_search_cases import catalog

MORE = ["aaaa aaaa.aaa", "a", "ab", "abc", "Ⅷ.PDF", "été été.été", "a\r\nb\r\nb", "x y z 1.tar.gz", "~\x7f!.é", "a\0a\0a"]


def test_counts_equal_postings(spark):
    cat = catalog(spark, *names(300), *ODD, *MORE)
    cat = cat.unionByName(cat.limit(40).withColumns({"is_directory": F.lit(True)})).repartition(3).localCheckpoint()
    for kinds in (ps.KINDS, ["exact"], ["extension"], ["prefix2", "gram3"], ["gram2", "exact"], ["char"]):
        want = sorted(map(tuple, ps.build(cat, kinds).groupBy("kind", "key").count().collect()))
        assert want and sorted(map(tuple, ps.key_counts(cat, kinds).collect())) == want
    assert ps.key_counts(cat.where("false")).count() == 0


def test_counts_read_the_catalog_once(spark):
    cat = catalog(spark, *names(20)).localCheckpoint()
    plan = ps.key_counts(cat)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 1
