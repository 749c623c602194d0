"""Posting blocks, intersections, caps and stored catalogs against their plain forms."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathlore.functions import text as tx
from pathlore.operators import delta
from pathlore.operators import postings as ps
from pathlore.operators import search
from pathlore.sources import catalog as ct

from .test_search_cases import catalog, queries

ODD = ["a b.txt", "zz\r\nx", "ẍé日本.md", "nul\0name.txt", "x", "..", "产品报告.pdf", "aaaa aaaa", "👩‍👩‍👧 family.png"]


def names(n, seed=0):
    rng = random.Random(seed)
    return [f"/v/{''.join(rng.choices('ab c', k=rng.randrange(1, 9))).strip() or 'q'}{i}.{rng.choice(['txt', 'pdf', 'glb'])}" for i in range(n)]


def test_postings_equal_those_by_graphemes(spark):
    cat = catalog(spark, *names(200), *ODD)
    want = set()
    graphemes = lambda s: [r.g for r in spark.createDataFrame([(s,)], "s string").select(F.explode(tx.graphemes(F.col("s"))).alias("g")).collect()] if re.search(r"[^\x00-\x7f]|\r\n", s) else list(s)
    for r in cat.collect():
        for alias in {r.normalized_name, r.pinyin_compact, r.pinyin_initials} - {""}:
            g = graphemes(alias)
            want |= {("exact", alias, r.id), ("prefix1", g[0], r.id), ("char", g[0], r.id)} | ({("prefix2", "".join(g[:2]), r.id)} if len(g) > 1 else set())
            want |= {(f"gram{n}", "".join(g[i : i + n]), r.id) for n in (2, 3) for i in range(len(g) - n + 1)}
        if r.file_extension:
            want.add(("extension", r.file_extension, r.id))
    got = [tuple(r) for r in ps.build(cat).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_blocks_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(ps, "BLOCK_MOST", 8)
    long = ps.build(catalog(spark, *names(300)))
    for bits in (0, 3, 9):
        blocks = ps.blocked(long, bits)
        assert blocks.agg(F.max("n")).first()[0] <= 8
        assert sorted(tuple(r) for r in blocks.select("kind", "key", F.explode("ids").alias("id")).collect()) == sorted(tuple(r) for r in long.collect())
        assert sorted(tuple(r) for r in ps.frequencies(blocks).collect()) == sorted(tuple(r) for r in ps.frequencies(long).collect())
    assert [ps.bits_for(n, 10) for n in (0, 1, 10, 11, 100)] == [0, 0, 0, 1, 4]


def test_intersections_equal_counting(spark):
    cat = catalog(spark, *names(300), *ODD)
    q = queries(spark, "产 chan", "b c a", "abc", "aab", "x y", "cab.txt", ".glb", "bb", "c", "q1")
    long = ps.build(cat)
    want = sorted(tuple(r) for r in search.candidates(q, long, rarest=False).collect())
    assert {r[0] for r in want} >= {0, 2, 3, 6}
    for bits in (0, 4):
        assert sorted(tuple(r) for r in search.candidates(q, ps.blocked(long, bits), rarest=False).collect()) == want
    none = spark.createDataFrame([(1, "gram3", "abc"), (1, "gram3", "nowhere"), (2, "gram3", "none")], "query_id int, kind string, key string")
    assert ps.intersect(none, ps.blocked(long, 2)).count() == 0


def test_plans_agree_on_random_queries(spark, tmp_path):
    """Long postings, blocks over a bucketed catalog, and the scan give the same rows."""
    rng = random.Random(1)
    paths = names(250, 1)
    cat = catalog(spark, *paths, *ODD)
    pieces = [p.rpartition("/")[2] for p in paths] + ODD
    raw = []
    for _ in range(25):
        name = rng.choice(pieces)
        a = rng.randrange(len(name))
        raw.append(rng.choice(["", "", "ext:txt ", "kind:document ", 'path:"/v" ', "size:<1kb "]) + rng.choice([name[a : a + rng.randrange(1, 6)], name, "".join(rng.choices("abc 1.", k=3))]))
    q = queries(spark, *raw)
    rows = lambda df: sorted((r.query_id, r.rank, r.score, r.path) for r in df.collect())
    want = rows(search.search_scan(q, cat, limit=7))
    assert rows(search.search(q, cat, ps.build(cat), limit=7)) == want
    table = ct.save_bucketed(cat, f"file://{tmp_path}/catalog", 4)
    assert rows(search.search(q, table, ps.blocked(ps.build(table), 3), limit=7)) == want


def test_a_bucketed_catalog_is_not_dealt(spark, tmp_path):
    """Beyond broadcasts, the plan has no exchange between the catalog's scan and the join."""
    table = ct.save_bucketed(catalog(spark, *names(300)), f"file://{tmp_path}/catalog", 4)
    blocks = ps.blocked(ps.build(table), 3)
    blocks.write.parquet(f"file://{tmp_path}/blocks")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = search.candidates(queries(spark, "abc", "b c"), spark.read.parquet(f"file://{tmp_path}/blocks"))
        plan = found.join(table, "id")._jdf.queryExecution().executedPlan()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

    def above(node, path):
        """Names of the nodes over the catalog's scan, nearest first."""
        name = node.nodeName()
        if "Scan" in name and "catalog_" in node.toString():
            return path
        kids = node.children()
        return next((found for i in range(kids.size()) if (found := above(kids.apply(i), [name, *path])) is not None), None)

    path = above(plan, [])
    join = next(i for i, name in enumerate(path) if "Join" in name)
    assert not any("Exchange" in name for name in path[:join])


def test_caps_equal_a_window(spark):
    cat = catalog(spark, *names(400))
    q = queries(spark, ".txt", "a", "b", "abc", "zzz")
    found = search.candidates(q, ps.build(cat), rarest=False)
    for cap in (7, 1000):
        own = Window.partitionBy("query_id")
        plain = found.join(cat.select("id", "path"), "id").withColumns({"rn": F.row_number().over(own.orderBy("path")), "truncated": F.count(F.lit(1)).over(own) > cap}).where(F.col("rn") <= cap)
        want = sorted(tuple(r) for r in plain.select("query_id", "id", "truncated").collect())
        assert sorted(tuple(r) for r in search.capped(found, cat, cap).collect()) == want


def test_a_hot_query_is_capped_in_many_tasks(spark):
    """A query that meets all records: no task ranks more than its range of paths."""
    cat = spark.range(40_000).select(F.xxhash64("id").alias("id"), F.format_string("/v/%06d", "id").alias("path"))
    found = cat.select(F.lit(1).alias("query_id"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task's anyway
    try:
        out = search.capped(found, cat, 25_000)
        sizes = [r.n for r in out.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.path for r in out.join(cat, "id").collect()) == [f"/v/{i:06d}" for i in range(25_000)]
    assert max(sizes) < 20_000


def test_numbers_of_any_length_sort_by_value(spark):
    values = [0, 1, 9, 10, 99, 10**19, 10**20 - 1, 10**20, 123456789012345678901234, 123456789012345678909999, 10**120]
    rows = [(f"/a/{'0' * (i % 3)}{v}{s}",) for i, v in enumerate(values) for s in ("", ".txt", "-2")]
    got = [r.p for r in spark.createDataFrame(rows, "p string").orderBy(tx.natural_key(F.col("p")), "p").collect()]
    assert got == sorted((r[0] for r in rows), key=lambda p: (int(re.match("/a/([0-9]+)", p)[1]), re.sub("/a/[0-9]+", "", p), p))
    keys = spark.createDataFrame([("/a/123456789012345678901234",), ("/a/123456789012345678909999",)], "p string").select(tx.natural_key(F.col("p")).alias("k")).collect()
    assert keys[0].k < keys[1].k


def test_removing_a_catalog(spark, tmp_path):
    at = f"file://{tmp_path}/own"
    ct.save(catalog(spark, "a.txt"), at, ["/tmp"])
    ct.remove(spark, at)
    assert not (tmp_path / "own").exists() and ct.manifest(spark, at) is None
    ct.remove(spark, at)


def test_many_roots_are_joined(spark, monkeypatch):
    paths = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d/e",), (None,), ("/x",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/c/d",), (None,), ("/a",)], "root string")
    want = ["/a", "/a/b", "/c/d/e"]
    assert sorted(r.path for r in delta.under_roots(paths, roots).collect()) == want
    monkeypatch.setattr(delta, "FEW_ROOTS", 1)
    assert sorted(r.path for r in delta.under_roots(paths, roots).collect()) == want
