"""Listings of a made tree against a plain walk."""

import os
import random

from pathlore.sources import listing as ls


def walked(root, packages=ls.PACKAGES):
    out = []
    for e in os.scandir(root):
        inside = e.is_dir(follow_symlinks=False)
        out.append((e.path, 0 if inside else e.stat(follow_symlinks=False).st_size, inside, e.is_symlink()))
        if inside and not (e.name.rpartition(".")[2] in packages and "." in e.name[1:]):
            out += walked(e.path, packages)
    return out


def made(root):
    """Folders within folders, hidden ones, packages, links to files, folders and nowhere, and one very deep branch."""
    rng = random.Random(4)
    dirs = [root]
    for i in range(120):
        at = rng.choice(dirs) / rng.choice([f"d{i}", f".hidden{i}", f"Box{i}.app", f"x.{i}", ".app"])
        at.mkdir(exist_ok=True)
        dirs.append(at)
        for j in range(rng.randrange(4)):
            (at / rng.choice([f"f{j}.txt", f".h{j}", f"é{j}", f"_u{j}"])).write_text("x" * rng.randrange(50))
    deep = root
    for i in range(25):
        deep = deep / f"deep{i}"
        deep.mkdir()
        (deep / "file").write_text("y")
    (root / "link-file").symlink_to(root / "nowhere")
    (deep / "link-up").symlink_to(root)
    (root / "link-dir").symlink_to(dirs[3])


def test_a_made_tree_equals_a_walk(spark, tmp_path):
    made(tmp_path)
    want = sorted(walked(tmp_path))
    for levels, partitions in ((1, 3), (3, 8), (50, 1)):
        rows = ls.local_listing(spark, f"file://{tmp_path}", levels=levels, partitions=partitions).collect()
        assert sorted((r.path, r.size, r.is_directory, r.is_symlink) for r in rows) == want
        assert all(r.modified_at is not None for r in rows)
    assert any("/.hidden" in w[0] for w in want) and any(w[3] for w in want)
    none = [(p, s, d, k) for p, s, d, k in walked(tmp_path, ())]
    assert len(ls.local_listing(spark, str(tmp_path), packages=()).collect()) == len(none) > len(want)


def test_what_cannot_be_read_is_left_out(spark, tmp_path):
    assert list(ls.entries(str(tmp_path / "gone"), 3)) == []
    assert ls.local_listing(spark, str(tmp_path / "gone")).count() == 0
    odd = os.fsencode(str(tmp_path)) + b"/\xff\xfe.txt"
    with open(odd, "w") as f:
        f.write("z")
    assert [r.path for r in ls.local_listing(spark, str(tmp_path)).collect()] == [f"{tmp_path}/��.txt"]


def test_the_driver_stops_at_enough_directories(tmp_path):
    made(tmp_path)
    reader = ls.ListingReader({"path": str(tmp_path), "levels": "2", "partitions": "5"})
    parts = reader.partitions()
    assert len(parts) == 5 and sum(len(p.found) for p in parts) < 60
