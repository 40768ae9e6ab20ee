import os
import zlib

import pytest
from pyspark.errors import StreamingQueryException

from vellum.sources import feed, snapshots, tree


def make(root, files):
    for f in files:
        path = os.path.join(root, f)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as out:
            out.write(f)


@pytest.fixture
def library(tmp_path):
    root, other = str(tmp_path / "lib"), str(tmp_path / "other")
    make(root, ["a.arw", "x/b.nef", "x/y/c.jpg", "x/y/d.txt", ".cache/e.arw", "z/.f.arw", "skip/g.arw", "skip/sub/h.arw", "deep/" + "/".join("abcdefg") + "/i.dng", "é/k.arw"])
    make(other, ["one/o.arw", "one/in/p.arw"])
    os.symlink(root, f"{root}/x/loop")
    os.symlink(f"{root}/x/y", f"{root}/z/again")
    os.symlink(f"{root}/skip/sub", f"{root}/z/into_excluded")
    os.symlink(f"{other}/one", f"{root}/z/out")
    os.symlink(f"{other}/one", f"{root}/x/out")
    os.symlink(f"{other}/one", f"{other}/one/in/self")
    os.symlink(f"{root}/a.arw", f"{root}/z/file_link.arw")
    os.link(f"{root}/x/b.nef", f"{root}/z/hard.nef")
    os.makedirs(f"{root}/empty")
    return root


def own_files(root):
    out = []
    for at, folders, files in os.walk(root):
        rel = os.path.relpath(at, root)
        folders[:] = [d for d in folders if not d.startswith(".") and not (rel == "." and d == "skip")]
        out += [os.path.normpath(os.path.join(rel, f)) for f in files if not f.startswith(".")]
    return out


def test_tree_is_what_a_walk_finds(spark, library):
    rows = tree.scan(spark, library, excluded=["skip"], tasks=3)
    got = {r["path"]: r for r in rows.collect()}
    files = {p for p, r in got.items() if r["kind"] == "file"}
    assert files == {*own_files(library), "x/out/o.arw", "x/out/in/p.arw", "z/into_excluded/h.arw"}
    assert {p for p, r in got.items() if r["kind"] == "folder"} >= {"empty", "x", "x/y", "x/out", "x/out/in", "z/into_excluded"}
    assert not {"x/loop", "z/again", "z/out"} & set(got)
    assert (got["z/hard.nef"]["dev"], got["z/hard.nef"]["ino"]) == (got["x/b.nef"]["dev"], got["x/b.nef"]["ino"]) and got["x"]["ino"] == os.stat(f"{library}/x").st_ino
    assert got["x/b.nef"]["size"] == 7 and got["x/b.nef"]["modified"] == os.stat(f"{library}/x/b.nef").st_mtime_ns // 1_000_000
    assert tree.is_complete(rows).first()["complete"]
    assert {r["path"] for r in tree.importable(rows).collect()} == {f for f in files if not f.endswith(".txt")}
    for tasks in (1, 64):
        assert {r["path"] for r in tree.scan(spark, library, excluded=["skip"], tasks=tasks).collect()} == set(got)


def test_a_prefix_prunes_the_walk(spark, library):
    whole = {r["path"] for r in tree.scan(spark, library).collect()}
    for prefix in ("x/", "x", "deep/a/b/", "x/y/c", "nothing"):
        assert {r["path"] for r in tree.scan(spark, library, prefix=prefix, tasks=2).collect()} == {p for p in whole if p.startswith(prefix)}
    reader = tree.PrunedTreeReader({"path": library})
    list(reader.pushFilters([tree.StringStartsWith(("path",), "x/y/")]))
    assert {p.path for p in reader.partitions()} == {"", "x", "x/y"}


def test_removals_wait_while_a_listing_has_gaps(spark, library):
    known = spark.createDataFrame([("a.arw", 1), ("gone.arw", 2)], "path string, id int")
    rows = tree.scan(spark, library)
    assert [r["id"] for r in tree.removals(known, rows).collect()] == [2]
    os.symlink(f"{library}/nowhere", f"{library}/x/broken")
    os.symlink("circle", f"{library}/z/circle")
    rows = tree.scan(spark, library)
    assert {r["path"] for r in rows.filter("kind = 'gap'").collect()} == {"x/broken", "z/circle"}
    assert not tree.is_complete(rows).first()["complete"] and tree.removals(known, rows).count() == 0
    assert [r["kind"] for r in tree.scan(spark, library + "/none").collect()] == ["gap"]
    if os.geteuid():
        os.chmod(f"{library}/x/y", 0)
        assert "x/y" in {r["path"] for r in tree.scan(spark, library).filter("kind = 'gap'").collect()}
        os.chmod(f"{library}/x/y", 0o755)


def test_originals_anywhere(spark, library):
    got = {r["path"] for r in tree.originals_anywhere(spark, library).collect()}
    assert got == {"a.arw", "x/b.nef", ".cache/e.arw", "z/.f.arw", "skip/g.arw", "skip/sub/h.arw", "deep/a/b/c/d/e/f/g/i.dng", "é/k.arw", "z/hard.nef"}


SCHEMA = "stamp string, entity string, row_id string, value long"


def feed_rows(n, of=0):
    return [(f"{i // 3:012x}0000{'ab'[i % 2] * 16}", "photo" if i % 5 else "shoot", str(zlib.crc32(str(i).encode()) % 50), i) for i in range(of, of + n)]


@pytest.mark.parametrize("page,pages", [(1, 1), (7, 1), (5, 3), (1000, 1)])
def test_feed_gives_every_change_once_over_restarts(spark, tmp_path, page, pages):
    order, log = ["stamp", "entity", "row_id"], str(tmp_path / "log")
    rows = feed_rows(20 if page == 1 else 90)
    feed.append(spark.createDataFrame(rows, SCHEMA), log, order, 3)
    seen, batches = [], []

    def take(df, batch_id):
        got = [tuple(r) for r in df.collect()]
        if len(batches) == stop_at:
            raise RuntimeError("killed")
        batches.append(len({r[:3] for r in got}))
        seen.extend(got)

    for stop_at in (2, 3, None, None):
        if stop_at is None and len(rows) == 90:
            more = feed_rows(30, 300)
            rows = rows + more
            feed.append(spark.createDataFrame(more, SCHEMA), log, order)
        run = feed.read_feed(spark, log, SCHEMA, order, page, pages).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "progress")).start()
        try:
            run.processAllAvailable()
        except StreamingQueryException:
            assert len(batches) == stop_at
        run.stop()
    assert sorted(seen) == sorted(rows)
    assert max(batches) <= page * pages


def test_feed_leaves_out_what_is_held(spark, tmp_path):
    order, log, rows = ["stamp", "entity", "row_id"], str(tmp_path / "log"), feed_rows(60)
    feed.append(spark.createDataFrame(rows, SCHEMA), log, order, 2)
    held = {"a" * 16: rows[30][0]}
    run = feed.read_feed(spark, log, SCHEMA, order, 10, 2, held).writeStream.format("memory").queryName("held_feed").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("held_feed").collect())) == sorted(r for r in rows if not (r[0].endswith("a") and r[0] <= rows[30][0]))


def test_snapshots_are_whole_or_not_there(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.read("t")
    one = store.save({"t": spark.range(3), "u": spark.range(7)}, "daily")
    pinned = store.read("t", one)
    store.write({"t": spark.range(99), "u": spark.range(99)})  # killed before the manifest
    assert store.read("t").count() == 3 and store.versions() == [1]
    two = store.save({"t": spark.range(4)}, "daily", carry=True)
    assert store.read("t").count() == 4 and store.read("u").count() == 7 and pinned.count() == 3
    three = store.save({"t": spark.range(5).limit(0)}, "manual")
    assert store.read("t").count() == 0
    assert store.rotate({"daily": 1}, grace=3_600_000) == [one] and store.versions() == [two, three]
    assert len(store._names("data")) == 6  # young folders stay
    assert store.rotate({"daily": 1}, grace=-1000) == [] and len(store._names("data")) == 3
    assert store.read("u", two).count() == 7 and store.read("t", two).count() == 4
    assert store.rotate({"daily": 0, "manual": 0}, grace=-1000) == [two] and store.versions() == [three]


def test_a_version_has_one_writer(spark, tmp_path, monkeypatch):
    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    store.save({"t": spark.range(1)})
    monkeypatch.setattr(store, "versions", list)  # a second writer that has not seen the first
    with pytest.raises(FileExistsError):
        store.save({"t": spark.range(2)})
    monkeypatch.undo()
    assert store.read("t").count() == 1 and not [n for n in store._names("manifests") if n.startswith(".") and not n.endswith(".crc")]
