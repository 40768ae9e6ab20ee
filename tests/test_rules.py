"""Cases worked out by hand, where SQL would only repeat the rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import backup, descriptor, links, rendition, scan, sessions, similarity


def flat(luma=0, red=0, green=0, coarse=0, cells=()):
    """A descriptor of two equal views of 8 by 8 cells; ``cells``: those of the 4 by 4 in the middle that are 255."""
    grid = np.full((8, 8), luma)
    for at in cells:
        grid[2 + at // 4, 2 + at % 4] = 255
    view = np.concatenate([np.full(16, coarse), grid.ravel(), np.full(64, red), np.full(64, green)])
    return np.concatenate([view, view])


@pytest.mark.parametrize(
    "other,score",
    [
        (flat(), 1.0),
        (flat(luma=30, red=10, green=20), 0.7),  # 0.7 * (1 - 90/255) + 0.3 * (1 - 45/255)
        (flat(red=85, green=85), 0.7),  # colour says nothing in common
        (flat(cells=range(4)), 1.0),  # a quarter of the cells may differ
        (flat(cells=range(8)), 0.3),  # of the twelve best four are 255 off: structure is nothing
        (flat(luma=255, red=255, green=255), 0.0),
    ],
)
def test_how_alike_two_descriptors_are(other, score):
    assert descriptor.alike(flat(), other, 8, 4) == pytest.approx(score, abs=1e-12)
    assert descriptor.alike(other, flat(), 8, 4) == pytest.approx(score, abs=1e-12)


def test_the_closer_view_is_78_hundredths(spark):
    inside = spark.range(100).select("id", descriptor.cell(F.col("id"), 100, descriptor.CLOSER_VIEW, 78).alias("c")).filter("c IS NOT NULL")
    assert [(r["id"], r["c"]) for r in inside.orderBy("id").collect()] == [(i, i - 11) for i in range(11, 89)]


def test_bins_are_followed_by_a_lone_identity_in_the_root(spark):
    ident = "library_id long, path string, dev int, ino long"
    bins = [(1, "bin", 1, 7), (2, "bin", 1, 0), (3, "bin", 1, 8), (4, "bin", 1, 9), (5, "bin", None, 5), (6, "bin", 1, 6), (7, "bin", 1, 3)]
    dirs = [(1, "trash", 1, 7), (2, "trash", 1, 0), (3, "deep/trash", 1, 8), (4, "bin", 1, 9), (5, "trash", 1, 5), (6, "a", 1, 6), (6, "b", 1, 6), (7, "trash", 1, 3)]
    held = [(i, "bin/x.arw") for i in range(1, 8)]
    files = [(i, "trash/x.arw") for i in (1, 2, 5)] + [(3, "deep/trash/x.arw")]
    of = lambda rows: spark.createDataFrame(rows, "library_id long, path string")
    got = scan.bin_by_identity(spark.createDataFrame(dirs, ident), spark.createDataFrame(bins, ident), of(files), of(held))
    assert {r["library_id"]: (r["became"], r["target"]) for r in got.collect()} == {1: ("renamed", "trash"), 2: ("kept", None), 3: ("ambiguous", None), 4: ("kept", None), 5: ("kept", None), 6: ("ambiguous", None), 7: ("stranger", None)}
    assert scan.bin_by_identity(spark.createDataFrame([], ident), spark.createDataFrame([], ident), of([]), of([])).count() == 0


def test_vouching_counts_a_composites_placement_and_built_copies_alone(spark):
    of = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    edits = of([("a", "5"), ("b", "3"), ("k", "2")], "photo_id string, stamp string")
    sources = of([("c", "a"), ("c", "b"), ("k", "b")], "composed_id string, photo_id string")
    placements = of([("c", "4"), ("a", "9")], "photo_id string, stamp string")  # a is no composite
    copies = [("a", "1", "t"), ("a", "1", None), ("a", "2", "t"), ("b", "3", "t"), ("c", "4", "t"), ("c", "3", "t"), ("k", "3", "t"), ("z", None, "t")]
    got = sessions.vouch(of(copies, "photo_id string, built_from string, built_at string"), of([("a", "1")], "photo_id string, stamp string"), sources, edits, placements)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", "5", "t"), ("a", "1", None), ("a", "2", "t"), ("b", "3", "t"), ("c", "5", "t"), ("c", "3", "t"), ("k", "3", "t"), ("z", None, "t")], key=repr)


def rows_of(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_backup_states_of_unknown_and_repeated_things(spark):
    photos = rows_of(spark, [("a", "file", "p/a", False, None, None), ("b", "file", "p/b", False, "h", 1), ("c", "file", "p/c", True, "h", 1), ("d", "file", "p/d", True, "h", 1), ("e", "merge", "p/e", False, "h", 1), ("f", "file", "p/f", False, "h", None), (None, "file", "p/n", False, None, None)], "photo_id string, kind string, path string, is_missing boolean, content_hash string, file_size long")
    copies = rows_of(spark, [(1, "a", "q/a", "held", "x", 9), (1, "b", "p/b", "held", "other", 1), (1, "c", "p/c", None, "h", 1), (1, "f", "p/f", None, "h", 1), (1, "f", "p/z", "changed", "h", 1), (2, "d", "p/d", "held", "h", 1), (1, None, "p/n", "held", None, None)], "peer_id int, photo_id string, rel_path string, health string, content_hash string, size long")
    got = {r["photo_id"]: tuple(r)[1:5] for r in backup.backup_states(photos, copies, 1).collect()}
    assert got == {"a": (False, False, True, False), "b": (True, False, False, False), "c": (False, False, False, True), "d": (False, True, False, False), "f": (False, False, False, False), None: (True, False, False, False)}
    assert tuple(backup.backup_coverage(photos, copies, 1).first()) == (6, 1, 2, 0, 0, 0, 1)
    assert tuple(backup.backup_coverage(photos.limit(0), copies.limit(0), 1).first()) == (0,) * 7


def test_collapsed_stacks_leave_out_who_was_taken_out(spark):
    members = rows_of(spark, [("s1", "p", "1"), ("s1", "q", "5"), ("s2", "p", None), ("s2", "r", "2"), ("s3", "r", "2"), ("s3", "q", "1"), ("s4", "z", "1"), ("s5", "y", "1"), ("s6", "y", "1")], "stack_id string, photo_id string, stamp string")
    stacks = rows_of(spark, [("s1", "3"), ("s2", "9"), ("s3", None), ("s4", "1"), ("s5", "1"), ("s6", "1")], "stack_id string, created_stamp string")
    graves = rows_of(spark, [("s2", "q", "3"), ("s4", "z", "9")], "stack_id string, photo_id string, stamp string")
    left, gone = links.collapse_stacks(members, stacks, graves, "now")
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([("s2", "p", None), ("s2", "r", "2"), ("s2", "q", "now"), ("s4", "z", "1"), ("s6", "y", "1")], key=repr)
    assert {r["stack_id"] for r in gone.collect()} == {"s1", "s3", "s5"}
    left, gone = links.collapse_stacks(members.limit(0), stacks, graves, "now")
    assert left.count() == gone.count() == 0


def test_copies_that_are_put_off_wait_for_a_later_edit(spark):
    ddl = "photo_id string, built_at string, built_from string, deferred_from string, needs_build boolean"
    copies = rows_of(spark, [("a", "t", "1", None, True), ("b", None, None, None, True), ("c", "t", "1", None, True)], ddl)
    touched = rows_of(spark, [("a", "2"), ("a", "3"), ("b", "3"), ("c", "3"), ("d", "3"), ("e", None)], "photo_id string, stamp string")
    after = rendition.put_off(copies, touched.filter("photo_id <> 'e'"), "c")
    assert {tuple(r) for r in after.collect()} == {("a", "t", "1", "3", False), ("b", None, None, "3", True), ("c", "t", "1", None, True), ("d", None, None, "3", False)}
    owed = lambda t, c: {r["photo_id"] for r in rendition.queue_edited(t, c).collect()}
    assert owed(touched, copies) == {"a", "b", "c", "d"} and owed(touched, after) == {"c"}
    assert owed(rows_of(spark, [("a", "4")], "photo_id string, stamp string"), after) == {"a"}


def test_paired_points_against_all_correlations(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 8))
    v[20:30] = v[:10] + rng.normal(size=(10, 8)) * 0.1
    v[30] = v[31] = v[0]  # two alike: nothing is distinct
    v /= np.linalg.norm(v, axis=1)[:, None]
    of = lambda i: "abc"[i // 20] if i < 59 else "one"
    points = rows_of(spark, [(of(i), i, row.tolist()) for i, row in enumerate(v)] + [("a", 99, None)], "picture string, point long, v array<double>")
    pairs = [("a", "b"), ("b", "a"), ("a", "one"), ("one", "a"), ("a", "none"), (None, "a")]
    want = set()
    for a, b in pairs[:4]:
        mine, theirs = ([i for i in range(60) if of(i) == p] for p in (a, b))
        for i in mine if len(theirs) > 1 else []:
            alike = sorted(((float(v[i] @ v[j]), -j) for j in theirs), reverse=True)
            (best, j), (second, _) = alike[:2]
            if best > 0 and (max(0, 1 - best) / (1 - second) if 1 - second > 1e-9 else 1) <= 0.8:
                want.add((a, b, i, -j))
    for rows in (512, 3):
        got = similarity.paired_points(points, rows_of(spark, pairs, "a string, b string"), 0.8, rows)
        assert {tuple(r)[:4] for r in got.collect()} == want and len(want) > 8
