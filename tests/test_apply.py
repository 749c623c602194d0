"""The store of applied changes: against a plain replay of all events, over streams, crashes and compaction."""

import random

import pytest

from pathlore.operators import postings
from pathlore.sources import catalog as ct
from pathlore.streaming import apply as ap

LISTING = "path string, size long, is_directory boolean, created_at timestamp, modified_at timestamp"


def begun(spark, tmp_path, paths, roots=()):
    rows = [(p.rstrip("/"), i, p.endswith("/"), None, None) for i, p in enumerate(paths)]
    ap.start(ct.records(spark.createDataFrame(rows, LISTING)), f"file://{tmp_path}/out", roots)
    return f"file://{tmp_path}/out"


def batch(spark, *events):
    """(event_id, path, size): a path with / at its end is a directory, without a size it is gone."""
    rows = [(e, p and p.rstrip("/"), s is None, s, p.endswith("/") if p and s is not None else None, None, None) for e, p, s in events]
    return spark.createDataFrame(rows, ap.SCHEMA)


def state(spark, at):
    """{path: size} of the last version, whose postings and counts must agree with it."""
    records, posted = ap.latest(spark, at)
    key = lambda df: sorted(tuple(r) for r in df.select("kind", "key", "id").collect())
    assert key(posted) == key(postings.build(records))
    got = {r.path: r.size for r in records.collect()}
    assert ap.version(spark, at).count == len(got)
    return got


def test_late_events_and_batches_that_run_again(spark, tmp_path):
    at = begun(spark, tmp_path, [f"/vol/dir/file-{i}.txt" for i in range(6)])
    batches = [
        batch(spark, (10, "/vol/dir/file-0.txt", None), (11, "/vol/dir/new.glb", 50), (12, None, None)),
        batch(spark, (5, "/vol/dir/file-0.txt", 99), (20, "/vol/dir/new.glb", 60), (21, "/vol/dir/file-1.txt", None), (22, "/vol/dir/file-1.txt", 7)),
    ]
    want = {**{f"/vol/dir/file-{i}.txt": i for i in range(2, 6)}, "/vol/dir/file-1.txt": 7, "/vol/dir/new.glb": 60}
    for turn in range(2):  # the second time with a new checkpoint: both batches run again
        source = f"file://{tmp_path}/in-{turn}"
        for i, rows in enumerate(batches):
            rows.coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(ap.SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
        ap.apply_batches(stream, at, f"file://{tmp_path}/state-{turn}")
        ap.apply_batches(stream, at, f"file://{tmp_path}/state-{turn}")  # nothing new
        assert state(spark, at) == want
    told = ap.totals(spark, at).first()
    assert (told.added, told.removed, told.changed, told.batches) == (0, 0, 4, 4)


def test_directories_take_what_is_under_them(spark, tmp_path):
    at = begun(spark, tmp_path, ["/v/d/", "/v/d/a.txt", "/v/d/sub/", "/v/d/sub/b.txt", "/v/dx.txt", "/v/e/", "/v/e/c.txt", "/w/f.txt"], ["/v/"])
    ap.apply_batch(batch(spark, (1, "/v/d", None), (2, "/w/f.txt", None)), at, "s", 0)  # gone, and outside the roots
    assert set(state(spark, at)) == {"/v/dx.txt", "/v/e", "/v/e/c.txt", "/w/f.txt"}
    assert (ap.version(spark, at).anchors, ap.version(spark, at).delta) == (1, -4)
    ap.apply_batch(batch(spark, (3, "/v/e/", 0), (3, "/v/e/new.txt", 8)), at, "s", 1)  # listed anew
    assert state(spark, at) == {"/v/dx.txt": 4, "/v/e": 0, "/v/e/new.txt": 8, "/w/f.txt": 7}
    # a folder that a file replaced leaves its children; when the file goes, nothing else does
    ap.apply_batch(batch(spark, (4, "/v/e", 5)), at, "s", 2)
    ap.apply_batch(batch(spark, (5, "/v/e", None)), at, "s", 3)
    assert state(spark, at) == {"/v/dx.txt": 4, "/v/e/new.txt": 8, "/w/f.txt": 7}
    # a stream with another checkpoint tells of the time before
    ap.apply_batch(batch(spark, (0, "/v/d/a.txt", 9), (6, "/v/g.txt", 1)), at, "t", 0)
    assert state(spark, at) == {"/v/dx.txt": 4, "/v/e/new.txt": 8, "/v/g.txt": 1, "/w/f.txt": 7}


def test_versions_crashes_and_vacuum(spark, tmp_path, monkeypatch):
    at = begun(spark, tmp_path, ["/v/a.txt", "/v/b.txt", "/v/c.txt", "/v/d.txt", "/v/e.txt"])
    monkeypatch.setattr(ap, "SHARE", 10)

    def broken(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(ap, "_point", broken)
        with pytest.raises(OSError):
            ap.apply_batch(batch(spark, (1, "/v/a.txt", None)), at, "s", 0)
    assert len(state(spark, at)) == 5  # the delta is there, the pointer isn't
    v = ap.apply_batch(batch(spark, (1, "/v/a.txt", None)), at, "s", 0)
    assert len(state(spark, at)) == 4 and v.number == 1
    with pytest.raises(RuntimeError):
        ap._point(spark, at, v)  # another writer's version stands
    monkeypatch.setattr(ap, "SHARE", 0.1)
    v = ap.apply_batch(batch(spark, (2, "/v/b.txt", 9)), at, "s", 1)
    assert v.deltas == () and v.number == 3
    ap.apply_batch(batch(spark, (1, "/v/b.txt", 4), (0, "/v/a.txt", 1)), at, "t", 0)  # late, after compaction
    want = {"/v/b.txt": 9, "/v/c.txt": 2, "/v/d.txt": 3, "/v/e.txt": 4}
    assert state(spark, at) == want
    ap.vacuum(spark, at, keep=1)
    assert state(spark, at) == want and len(ap._pointers(spark, at)) == 1
    assert sorted(f.name[:5] for f in (tmp_path / "out").iterdir()) == ["base-", "versi"]


def test_a_batch_reads_only_its_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ap, "SHARD_ROWS", 10)
    at = begun(spark, tmp_path, [f"/v/{i}.txt" for i in range(400)])
    asked = []
    found = ap._state
    monkeypatch.setattr(ap, "_state", lambda spark, folder, v, shards=None: asked.append(shards) or found(spark, folder, v, shards))
    ap.apply_batch(batch(spark, (1, "/v/7.txt", None), (2, "/v/8.txt", 3)), at, "s", 0)
    assert all(len(s) <= 2 for s in asked) and ap.version(spark, at).count == 399
    plan = ap._state(spark, at, ap.version(spark, at), [3]).base._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan[plan.index("PartitionFilters:") :].split("]")[0]


def test_random_events_equal_a_replay_in_order(spark, tmp_path):
    """Batches in any order and of two streams give what a plain replay of the events by id gives."""
    rng = random.Random(0)
    dirs = ["/v/a", "/v/a/b", "/v/c"]
    paths = [f"{d}/{i}.txt" for d in dirs for i in range(3)]
    start = [f"{d}/" for d in dirs] + paths
    live = {p.rstrip("/"): (i, p.endswith("/")) for i, p in enumerate(start)}
    at = begun(spark, tmp_path, start)
    events = []
    for e in range(60):
        p = rng.choice(paths if rng.random() < 0.8 else dirs)
        events.append((e, p, None if rng.random() < 0.5 else 100 + e) if p in paths or rng.random() < 0.5 else (e, f"{p}/", 100 + e))
        p, size = events[-1][1].rstrip("/"), events[-1][2]
        under = [q for q in live if q == p or q.startswith(p + "/")]
        if events[-1][1].endswith("/") or size is None and live.get(p, (0, False))[1]:
            for q in under:
                del live[q]
        else:
            live.pop(p, None)
        if size is not None:
            live[p] = (size, events[-1][1].endswith("/"))
    groups = [events[i::4] for i in range(4)]
    rng.shuffle(groups)
    for i, group in enumerate(groups):
        ap.apply_batch(batch(spark, *group), at, "st"[i % 2], i)
    assert state(spark, at) == {p: s for p, (s, _) in live.items()}
