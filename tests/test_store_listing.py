"""Listings of folders that are told of by other names than file: paths, or lie in another store."""

from collections import Counter

from pathlore.plans import queries
from pathlore.sources import listing as ls
from tests.test_listing import walked


def test_src_listing_in_any_shared_folder(spark, tmp_path, monkeypatch):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.tree.link./in", f"file://{tmp_path}")
    asked = []
    for top in (f"file://{tmp_path}", str(tmp_path), "viewfs://tree/in"):
        monkeypatch.setattr(queries, "folder", lambda spark, name, top=top: f"{top}/{name}-{len(asked)}")
        asked.append(Counter(tuple(r) for r in queries.QUERIES["src_listing"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(ls, "mounted", lambda spark, root: None)  # a store that no machine has mounted
    monkeypatch.setattr(queries, "folder", lambda spark, name: f"viewfs://tree/in/{name}-store")
    asked.append(Counter(tuple(r) for r in queries.QUERIES["src_listing"](spark, "/root/testdata/sf0.001").collect()))
    assert asked[0] == asked[1] == asked[2] == asked[3] and len(asked[0]) > 10


def test_store_listing_equals_a_walk_but_for_what_is_hidden(spark, tmp_path):
    for at in ("a/b/x.txt", "a/Box.app/in/y.txt", "a/.app/z.txt", "c d/é.txt"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(at)
    got = {(r.path.removeprefix("file:"), r.size, r.is_directory, r.is_symlink) for r in ls.store_listing(spark, f"file://{tmp_path}").collect()}
    assert got == {w for w in walked(tmp_path) if "/.app" not in w[0]}
    assert ls.store_listing(spark, f"file://{tmp_path}/gone").count() == 0
