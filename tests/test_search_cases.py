"""Small catalogs with hand-written answers, and the agreement of plans, deltas and streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pathlore.functions import score
from pathlore.functions import text as tx
from pathlore.functions.query import parse
from pathlore.operators import delta, postings, search
from pathlore.plans.queries import changes, folder
from pathlore.sources import catalog as ct
from pathlore.streaming import events as ev

NOW = dt.datetime(2024, 12, 31)


def catalog(spark, *paths, size=100):
    rows = [(p if p.startswith("/") else f"/tmp/{p}", size, False) for p in paths]
    df = spark.createDataFrame(rows, "path string, size long, is_directory boolean").withColumns({c: F.lit(None).cast("timestamp") for c in ("created_at", "modified_at")})
    return ct.records(df)


def queries(spark, *raw):
    return parse(spark.createDataFrame(list(enumerate(raw)), "query_id int, raw string"), F.lit(NOW))


def found(spark, cat, *raw, **kw):
    """For each query its (score, name) by the scan plan, which must agree with the posting plan."""
    q = queries(spark, *raw)
    rows = search.search_scan(q, cat, **kw).orderBy("query_id", "rank").collect()
    if "mode" not in kw:
        other = search.search(q, cat, postings.build(cat), **kw).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.rank, r.score, r.path) for r in rows] == [(r.query_id, r.rank, r.score, r.path) for r in other]
    return [[(r.score, r.name) for r in rows if r.query_id == i] for i in range(len(raw))]


def test_fuzzy_scores(spark):
    rows = [("pdrpt", "productreport"), ("zzzz", "productreport"), ("", "x"), ("abc", "abc"), ("ab", "abcd"), ("rep", "my-report"), ("epo", "my-report")]
    df = spark.createDataFrame(rows, "q string, c string").select(score.fuzzy(F.col("q"), F.col("c")).alias("s"))
    assert [r.s for r in df.collect()] == [552, None, 1, 10000, 8998, 7997, 7496]


def test_ranking_tokens_and_paths(spark):
    assert found(spark, catalog(spark, "annual-report.pdf", "report.pdf", "old_report_backup.pdf"), "report") == [
        [(8996, "report.pdf"), (6968, "old_report_backup.pdf"), (6944, "annual-report.pdf")]
    ]
    assert found(spark, catalog(spark, "product report.pdf"), "prd rpt", "product report.pdf") == [[(8172, "product report.pdf")], []]
    got = found(spark, catalog(spark, "/tmp/report-folder/invoice.pdf"), "report", "invoice", "invoice path:report-folder")
    assert got == [[], [(8996, "invoice.pdf")], [(8996, "invoice.pdf")]]
    re_, repos, r = found(spark, catalog(spark, "report.pdf", "repository.txt", "photo.jpg"), "re", "repos", "r")
    assert len(re_) == 2 and repos[0][1] == "repository.txt" and r


def test_other_scripts(spark):
    cat = catalog(spark, "产品报告.pdf", "Привет.txt", "Café ÀÇÑ.TXT", "straße.md")
    row = cat.where(F.col("name").startswith("产")).first()
    assert (row.pinyin_name, row.pinyin_compact, row.pinyin_initials) == ("chan pin bao gao.pdf", "chanpinbaogao.pdf", "cpbg")
    got = found(spark, cat, "产品", "chanpin", "cpbg", "privet", "cafe", "straße")
    assert [g[0][0] if g else None for g in got] == [8994, 6500, 6200, 6500, 8992, 8997]


def test_parser(spark):
    raw = ["dashboard ext:fig path:work size:>10mb", '"red  widget" kind:Nope', "size:>1gb size:>x", "ext:.tar.gz.", ".glb", "modified:today a", "modified:<0d b", "modified:<7d", '"open quote  runs', "size:<1.5kb kind:FOLDER"]
    rows = [r.asDict() for r in queries(spark, *raw).orderBy("query_id").collect()]
    pick = lambda i, *c: tuple(rows[i][x] for x in c)
    assert pick(0, "text", "ext", "path_contains", "min_size") == ("dashboard", "fig", "work", 10_000_000)
    assert pick(1, "text", "kind") == ("red  widget kind:nope", None)
    assert pick(2, "min_size") == (None,)
    assert pick(3, "ext") == ("tar.gz",) and pick(4, "ext", "text") == ("glb", "")
    assert pick(5, "modified_after") == (NOW,) and pick(6, "modified_after", "text") == (None, "b")
    assert pick(7, "modified_after") == (NOW - dt.timedelta(days=7),)
    assert pick(8, "text") == ("open quote  runs",) and pick(9, "max_size", "kind") == (1500, "folder")


def test_ids_and_graphemes(spark):
    paths = ["", "a", "/tmp/report.pdf", "/tmp/模型.glb"]
    ids = [r.h for r in spark.createDataFrame([(p,) for p in paths], "p string").select(F.hex(tx.stable_id("p")).alias("h")).collect()]
    assert ids[:3] == ["CBF29CE484222325", "AF63DC4C8601EC8C", "9CA6B8A3E1007D4E"]
    n = spark.createDataFrame([("👨‍👩‍👧x",), ("abc",), ("é",)], "s string").select(tx.n_graphemes(F.col("s")).alias("n")).collect()
    assert [r.n for r in n] == [2, 3, 1]


def test_extension_routes(spark):
    cat = catalog(spark, "body.glb", "body.gltf", "notes.txt")
    assert found(spark, cat, ".glb") == [[(8000, "body.glb")]]
    many = catalog(spark, *[f"file{i}.doc" for i in range(1500)])
    got = search.extension_early(queries(spark, ".doc"), many, 200)
    assert got.count() == 200 and got.orderBy("rank").first().name == "file0.doc"


def test_routing_rules(spark):
    cat = catalog(spark, "report.pdf", "red ring.txt", "hot ring.txt", "xyz")
    q = queries(spark, "xyz", "rr", "r", "hot rng", "kind:image", "ab", "zzz", "zz", "hot ring.txt", "q w", "repo")
    routes = {r.query_id: r.route for r in search.routes(q, postings.build(cat)).collect()}
    assert [routes[i] for i in range(11)] == ["exact", "exact", "exact", "tokens", "empty", "prefix-2", "no-gram", "prefix-2", "exact", "tokens-none", "trigram"]
    reference = found(spark, cat, "hot rng", "kind:document", "rr")
    assert reference[0] == [] and reference[1] == [] and [n for _, n in reference[2]] == ["red ring.txt"]
    wide = found(spark, cat, "hot rng", "kind:document", mode="exhaustive")
    assert [n for _, n in wide[0]] == ["hot ring.txt"] and len(wide[1]) == 3


def test_round_trips(spark):
    at, cat = folder(spark, "trip"), catalog(spark, "body.glb", "模型.glb", "report.doc")
    assert ct.manifest(spark, at) is None
    ct.save(cat, at, ["/tmp", "/data"])
    row = ct.manifest(spark, at).first()
    assert (row.item_count, row.root_path, row.root_paths) == (3, "/tmp", ["/tmp", "/data"])
    assert sorted(ct.load(spark, at).collect()) == sorted(cat.collect())
    first = postings.load_or_build(spark, at, cat)
    assert sorted(postings.load_or_build(spark, at, cat).collect()) == sorted(first.collect()) == sorted(postings.build(cat).collect())
    assert ct.storage_bytes(spark, at).first().bytes > 0
    old = folder(spark, "old")
    cat.write.json(f"{old}/records-json")
    assert sorted(r.path for r in ct.load(spark, old).collect()) == sorted(r.path for r in cat.collect())
    assert spark.read.parquet(f"{old}/records").count() == 3


def test_delta_equals_rebuild(spark):
    cat = catalog(spark, "/d/old.glb", "/d/模型.obj", "/d/sub/a.txt", "/d/sub/deep/b.txt", "/d/subway.txt")
    new = catalog(spark, "/d/new.glb", "/d/sub/a.txt", size=7).withColumn("seq", F.lit(1))
    path = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    after = delta.apply_changes(cat, path("/d/old.glb"), path("/d/sub"), new)
    assert sorted((r.path, r.size) for r in after.collect()) == [("/d/new.glb", 7), ("/d/sub/a.txt", 7), ("/d/subway.txt", 100), ("/d/模型.obj", 100)]
    gone = cat.join(after.select("id"), "id", "left_anti").select("id").unionByName(new.select("id"))
    moved = delta.apply_to_postings(postings.build(cat), gone, new.drop("seq"))
    assert sorted(moved.collect()) == sorted(postings.build(after).collect())
    assert delta.stats(cat, after, path("/d")).first().asDict() == {"anchors": 1, "before_count": 5, "after_count": 4, "delta": -1}
    cover = delta.cover(spark.createDataFrame([("/d/sub", True), ("/d/sub/deep/b.txt", False), ("/e/x.txt", False)], "path string, is_directory boolean"))
    assert sorted(r.path for r in cover.collect()) == ["/d/sub", "/e"]


def test_listings(spark):
    rows = [("/r/a.app/in.txt", False), ("/r/a.app", False), ("/r/link", True), ("/r/x.txt", None)]
    listing = spark.createDataFrame(rows, "path string, is_symlink boolean").withColumns({"size": F.lit(-5), "is_directory": F.lit(None).cast("boolean"), "created_at": F.lit(None).cast("timestamp"), "modified_at": F.lit(None).cast("timestamp")})
    got = ct.records(ct.skip_packages(ct.scan(listing)))
    assert sorted((r.path, r.size, r.is_directory, r.file_extension) for r in got.collect()) == [("/r/a.app", 0, False, "app"), ("/r/x.txt", 0, False, "txt")]


EVENTS = [  # event, milliseconds, monitor, group, path, flags
    (1, 0, "m", 1, "/a", 0), (2, 100, "m", 1, "/b", 0), (3, 700, "m", 2, "/a", 0), (4, 800, "m", 3, "/c", 2), (5, 900, "m", 4, "/d", 0), (6, 100, "n", 1, "/x", None), (7, 300, "n", 2, "/x", 0),
]


def event_rows(spark):
    rows = [(i, NOW + dt.timedelta(milliseconds=t), m, g, p, f) for i, t, m, g, p, f in EVENTS]
    return spark.createDataFrame(rows, ev.SCHEMA)


def runs_of(rows):
    out = {}
    for r in rows:
        out.setdefault((r.monitor, r.start), []).append(r.path)
    return sorted((m, sorted(paths)) for (m, _), paths in out.items())


def test_debounce_and_latch(spark):
    assert runs_of(ev.debounce(event_rows(spark)).collect()) == [("m", ["/a", "/b"]), ("m", ["/a", "/c", "/d"]), ("n", ["/x"])]
    assert sorted(r.event_id for r in ev.latch(event_rows(spark)).collect()) == [1, 2, 3, 6, 7]


def test_streams_equal_batches(spark):
    at = folder(spark, "events")
    ev.state_store(spark)
    for g in range(1, 5):
        event_rows(spark).where(f"batch_id = {g}").coalesce(1).write.mode("append").parquet(f"{at}/in")
    out = []
    ev.run(ev.latch_stream(ev.source(spark, f"{at}/in", 1)), lambda df, _: out.extend(r.event_id for r in df.collect()), f"{at}/latch")
    assert sorted(out) == [1, 2, 3, 6, 7]
    later = spark.createDataFrame([(99, NOW + dt.timedelta(hours=1), "z", 9, None, 0)], ev.SCHEMA)
    later.coalesce(1).write.mode("append").parquet(f"{at}/in")
    runs = ev.drained(ev.debounce_stream(ev.source(spark, f"{at}/in", 1)), f"{at}/runs", f"{at}/state")
    assert runs_of(runs.collect()) == runs_of(ev.debounce(event_rows(spark)).collect())


def test_runs_out_of_order_late_events_and_freed_state(spark):
    """Events that come out of order join their run, those behind the watermark don't count, and ended runs leave no state."""
    at = folder(spark, "late")
    ev.state_store(spark)
    rng = random.Random(3)
    times = [t for run in range(12) for t in (run * 3000 + i * 100 for i in range(rng.randrange(1, 12)))]
    rows = [(i, NOW + dt.timedelta(milliseconds=t), "m", 1, f"/p{i % 7}", 0) for i, t in enumerate(times)]
    make = lambda some: spark.createDataFrame(some, ev.SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
    mixed = rows[:]
    for i in range(0, len(mixed), 5):  # out of order by less than the watermark's delay
        mixed[i : i + 5] = rng.sample(mixed[i : i + 5], len(mixed[i : i + 5]))
    third = len(mixed) // 3 // 5 * 5
    for some in (mixed[:third], mixed[third : 2 * third], mixed[2 * third :]):
        make(some)
    make([(98, NOW + dt.timedelta(minutes=5), "z", 2, None, 0)])
    make([(99, NOW + dt.timedelta(milliseconds=50), "m", 3, "/too/late", 0), (100, NOW + dt.timedelta(minutes=6), "z", 3, None, 0)])
    query = ev.debounce_stream(ev.source(spark, f"{at}/in", 1), 250, "2 seconds")
    out = query.writeStream.outputMode("append").format("parquet").option("path", f"{at}/runs").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    want = runs_of(ev.debounce(spark.createDataFrame(rows, ev.SCHEMA)).collect())
    assert len(want) == 12 and runs_of(spark.read.schema(ev.RUNS).parquet(f"{at}/runs").collect()) == want
    progress = out.recentProgress
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 1
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 4  # of the last monitor alone


def test_restarts_and_state_of_monitors(spark):
    """A stale monitor ignores events until a restart; its last event and the totals go on."""
    rows = [
        (1, 0, "m", 1, "/a", 0, None), (None, None, "m", 1, None, None, 2), (2, 5, "m", 2, "/b", 4, None), (3, 9, "m", 3, "/c", 0, None), (5, 7, "m", 4, None, ev.RESTART, None), (4, 8, "m", 4, "/d", 0, None),
        (None, None, "m", 5, None, None, -3), (None, None, "m", 5, None, None, 0), (6, 10, "n", 1, "/x", None, None),
    ]
    events = spark.createDataFrame([(i, None if t is None else NOW + dt.timedelta(seconds=t), m, g, p, f, d) for i, t, m, g, p, f, d in rows], ev.SCHEMA + ", delta long")
    at = folder(spark, "states")
    ev.state_store(spark)
    for g in (1, 3, 5):
        events.where(f"batch_id in ({g}, {g + 1})").coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    got = sorted((r.monitor, r.batch_id, r.stale, r.last_event_id, (r.last_ts - NOW).seconds, r.added, r.removed, r.changed, r.batches) for r in ev.drained(ev.monitor_stream(stream), f"{at}/out", f"{at}/s1").collect())
    assert got == [
        ("m", 1, False, 1, 0, 2, 0, 0, 1), ("m", 2, True, 2, 5, 2, 0, 0, 1), ("m", 3, True, 3, 9, 2, 0, 0, 1), ("m", 4, False, 5, 9, 2, 0, 0, 1), ("m", 5, False, 5, 9, 2, 3, 1, 3), ("n", 1, False, 6, 10, 0, 0, 0, 0),
    ]
    passed = ev.drained(ev.latch_stream(stream.drop("delta")), f"{at}/events", f"{at}/s2")
    assert sorted(r.event_id for r in passed.collect()) == [1, 4, 5, 6] == sorted(r.event_id for r in ev.latch(events.drop("delta").where("event_id is not null")).collect())


def test_live_create_rename_delete(spark):
    state = {"cat": catalog(spark, "/live/keep.txt")}
    path = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    none = path().limit(0)

    def step(gone, *fresh):
        up = (catalog(spark, *fresh) if fresh else state["cat"].limit(0)).withColumn("seq", F.lit(1))
        state["cat"] = delta.apply_changes(state["cat"], path(*gone) if gone else none, none, up)
        return [bool(x) for x in found(spark, state["cat"], "realtime", "汽车")]

    assert step([], "/live/realtime-test.glb") == [True, False]
    assert step(["/live/realtime-test.glb"], "/live/汽车模型.glb") == [False, True]
    assert step(["/live/汽车模型.glb"]) == [False, False]


def test_counters_and_entry(spark):
    got = ev.counters(spark.createDataFrame([(1, 3), (2, -2), (3, 0), (4, 1)], "batch_id int, delta long")).first()
    assert (got.added, got.removed, got.changed, got.batches) == (4, 2, 1, 4)
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert json.dumps(sorted(entry.oracle_sql())) and set(entry.oracle_sql()) <= set(entry.queries())


def test_last_upsert_wins(spark):
    cat = catalog(spark, "/u/a.txt")
    up = catalog(spark, "/u/a.txt", size=1).withColumn("seq", F.lit(1)).unionByName(catalog(spark, "/u/a.txt", size=2).withColumn("seq", F.lit(2)))
    none = spark.createDataFrame([], "path string")
    assert [r.size for r in delta.apply_changes(cat, spark.createDataFrame([("/u/a.txt",)], "path string"), none, up).collect()] == [2]


@pytest.mark.parametrize("raw", ["10tb", "1.5gb", "3kb", "7b", "12", "-1", "x", "1e3mb", "gb"])
def test_byte_sizes(spark, raw):
    want = {"10tb": 10**13, "1.5gb": 1_500_000_000, "3kb": 3000, "7b": 7, "12": 12, "1e3mb": 10**9}.get(raw)
    assert spark.createDataFrame([(raw,)], "s string").select(tx.byte_size(F.col("s")).alias("b")).first().b == want
