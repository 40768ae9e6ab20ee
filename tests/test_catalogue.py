import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry, validity
from vellum.operators import arrays, changes, descriptor, graph, links, listing, projection, rendition, scan, sessions, similarity
from vellum.streaming.change_log import MergedTable


def ids(df, c="id"):
    return sorted((r[c] for r in df.collect()), key=repr)


def plain_cliques(rows, threshold, alike):
    """The rule, row by row: (run, id) -> first position of its group, or -1."""
    out, open_ = {}, {}
    for run in dict.fromkeys(r for r, _, _ in rows):
        group, start = [], 0

        def close(run=run):
            for i, _ in group:
                out[run, i] = start if len(group) > 1 else -1
            group.clear()

        for at, (_, i, v) in enumerate(sorted(((r, i, v) for r, i, v in rows if r == run), key=lambda x: x[1])):
            if v is None:
                close()
                out[run, i] = -1
                continue
            if group and min(alike(w, v) for _, w in group) < threshold:
                close()
            if not group:
                start = at
            group.append((i, v))
        close()
    return out


def test_cliques_against_the_rule_in_long_runs_with_nulls(spark):
    rng = random.Random(1)
    rows = [(run, i, None if rng.random() < 0.05 else [rng.choice([1.0, 0.9]), rng.choice([0.0, 0.2, 1.0])]) for run in (1, 2, None) for i in range(400)]
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    df = spark.createDataFrame(rows, "run int, id int, v array<double>")
    got = {(r["run"], r["id"]): r["clique"] for r in similarity.clique_groups(df, ["run"], ["id"], "v", "id", 0.9).collect()}
    assert got == plain_cliques(rows, 0.9, cosine)
    assert similarity.clique_groups(df.limit(0), ["run"], ["id"], "v", "id", 0.9).count() == 0


def test_a_group_named_like_a_single_row_stays_apart(spark):
    df = spark.createDataFrame([(5, None, 1), (6, "#5", 2), (7, "5", 3), (8, "5", 1)], "id int, stack string, v int")
    assert {r["id"]: r["group_size"] for r in listing.collapse(df, "stack", [F.desc("v")], F.col("id")).collect()} == {5: 1, 6: 1, 7: 2}


def test_rectangles_of_cells_far_apart(spark):
    far = 10**12
    rows = [(1, 0, 0, True), (1, far, far, True), (1, far + 1, far, True), (1, far, far, True), (2, 0, 0, False), (2, 3, 1, None)]
    got = {r["g"]: tuple(r)[1:] for r in arrays.largest_rectangle(spark.createDataFrame(rows, "g int, x long, y long, on boolean"), ["g"], "x", "y", "on").collect()}
    assert got == {1: (far, far, 2, 1, 2), 2: (0, 0, 0, 0, 0)}


@pytest.mark.parametrize("most", [1, 10, 10**6])
def test_components_by_rounds_and_in_one_task_are_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "EDGES_PER_TASK", most)
    rng = random.Random(5)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(40)] + [("hub", f"leaf{i}") for i in range(60)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_no_cluster_without_a_shared_folder():
    class Context:
        master, getCheckpointDir = "spark://host:7077", lambda self: None

    class Conf:
        get = staticmethod(lambda *a: None)

    class Frame:
        class sparkSession:
            sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="share"):
        graph.checkpointed(Frame())


def test_facts_of_rows_without_any(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    facts = projection.row_facts(none("photo_id int, cursor int, stamp string"), none("composed_id int, photo_id int"), none("photo_id int, health string"), none("photo_id int, peer_id int"), none("peer_id int, kind string, address string"), 0)
    row = projection.with_facts(spark.createDataFrame([(1, True)], "id int, is_missing boolean"), facts).withColumns({"gone": projection.is_gone(), "off": projection.is_offloaded()}).first()
    assert (row["gone"], row["off"], row["is_edited"], row["frame_count"], row["own_stamp"]) == (True, False, False, 0, None)


def test_original_elsewhere_three_ways(spark):
    rows = [(1, False, False, True, True), (2, True, True, True, True), (3, True, False, False, True), (4, True, False, True, True), (5, True, False, True, False)]
    df = spark.createDataFrame(rows, "id int, is_missing boolean, is_held boolean, is_elsewhere boolean, holder_active boolean")
    got = {r["id"]: r["e"] for r in df.select("id", projection.original_elsewhere(F.lit(None).cast("boolean")).alias("e")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "reachable", 5: "unreachable"}


def test_rendition_promises(spark):
    names = "mode string, last_rendition string, row_rendition string, library_source string, is_raw boolean, is_edited boolean, frames_edited boolean, has_embedded boolean, composes boolean, built_is_exact boolean, built array<string>"
    cases = [
        (("max", None, None, "embedded", False, False, False, True, False, True, []), ("embedded", None)),  # a finished picture has one
        (("max", None, None, "embedded", True, False, False, True, False, True, []), ("embedded", "max")),
        (("max", None, None, "render", True, False, False, True, False, True, ["max"]), ("full", "max")),
        (("best_available", None, None, "embedded", True, False, False, True, False, True, ["max"]), ("max", None)),
        (("best_available", None, None, "embedded", True, False, False, True, False, False, ["max"]), ("embedded", "max")),
        (("camera", None, None, "render", True, False, False, True, False, True, []), ("full", None)),
        (("remember", None, None, "embedded", True, False, False, True, True, True, []), ("embedded", "embedded")),  # a composed view is a file to build
        (("full", None, None, "embedded", True, True, False, True, True, True, ["embedded"]), ("embedded", "full")),
        ((None, None, None, None, True, None, None, None, None, None, None), ("full", None)),
    ]
    df = spark.createDataFrame([c for c, _ in cases], names)
    assert [tuple(r) for r in df.select(rendition.shown(), rendition.to_build()).collect()] == [w for _, w in cases]


def test_marks_and_labels_of_links(spark):
    members = spark.createDataFrame([(1, "a", True, "x", "s1"), (1, "b", False, "y", "s2"), (1, "c", True, "z", None), (2, "d", True, "q", "s1"), (2, "e", False, "r", "s1")], "group int, id string, is_raw boolean, mark string, stamp string")
    assert {r["id"]: r["mark"] for r in links.newest_marks(members, ["mark"], "stamp").collect()} == {"a": "y", "c": "y", "e": "q"}
    labels = spark.createDataFrame([("a", "L", "s5"), ("a", "M", "s5"), ("d", "L", "s1"), ("e", "L", "s1")], "id string, label string, stamp string")
    removals = spark.createDataFrame([("b", "L", "s4"), ("b", "M", "s6")], "id string, label string, stamp string")
    got = {(r["id"], r["label"], r["action"]) for r in links.shared_labels(members.select("group", "id"), labels, removals).collect()}
    assert got == {("b", "L", "add"), ("c", "L", "add"), ("a", "M", "remove")}


def test_sessions_descend_or_park(spark):
    schema = "photo_id int, session string, stamp string, chain array<struct<session:string,stamp:string>>, doc string"
    held = [(1, "s1", "t3", [], "A"), (2, "s1", "t5", [], "B"), (3, "s1", "t3", None, "C"), (4, None, "t1", [], "D"), (5, "s1", "t9", [("s2", "t4")], "E")]
    new = [(1, "s2", "t4", [("s1", "t3")], "a"), (2, "s2", "t6", [("s1", "t3")], "b"), (3, "s2", "t4", [], "c"), (4, "s2", "t4", [], "d"), (5, "s2", "t4", [], "e")]
    got = sorted(tuple(r) for r in sessions.parked(spark.createDataFrame(held, schema), spark.createDataFrame(new, schema)).collect())
    assert got == [(2, "s1", "t5", "B"), (2, "s2", "t6", "b"), (3, "s1", "t3", "C"), (3, "s2", "t4", "c")]


def test_revisions_that_moved_on_are_refused(spark):
    new = spark.createDataFrame([(1, 2, 1), (1, 2, 2), (2, 0, 3), (3, 1, 4)], "id int, rev int, order int")
    ok, no = sessions.at_revision(new, spark.createDataFrame([(1, 2), (3, 5)], "id int, revision int"), "id", "rev", "revision")
    assert ids(ok, "order") == [1, 3] and ids(no, "order") == [2, 4]


def test_three_peers_agree_in_any_order_of_arrival(spark):
    rng = random.Random(7)
    log = [(f"p{rng.randint(0, 3)}", rng.choice(["mark", "place"]), rng.randint(0, 9), peer, rng.random() < 0.3, rng.random()) for peer in "abc" for _ in range(30)]
    seen = set()
    for _ in range(3):
        rng.shuffle(log)
        state = spark.createDataFrame([], "id string, unit string, stamp int, peer string, by_user boolean, v double")
        for part in (log[:40], log[40:55], log[55:]):  # pages, one after the other
            both = state.unionByName(spark.createDataFrame(part, state.schema))
            best = both.groupBy("id", "unit").agg(F.max_by(F.struct(*state.columns), F.struct(F.col("by_user").cast("int"), "stamp", "peer", "v")).alias("r")).select("r.*")
            state = spark.createDataFrame(best.collect(), state.schema)
        whole = changes.merge_edits(spark.createDataFrame(log, state.schema), ["id", "unit"], "by_user", ["stamp", "peer", "v"], "v")
        seen.add(tuple(sorted((r["id"], r["unit"], r["v"]) for r in state.collect())))
        seen.add(tuple(sorted((r["id"], r["unit"], r["v"]) for r in whole.collect())))
    assert len(seen) == 1


def test_collectable_needs_every_peer(spark):
    stones = spark.createDataFrame([("a", 3), ("a", 5), ("b", 1), ("c", 1)], "origin string, s int")
    vectors = spark.createDataFrame([("p", "a", 4), ("q", "a", 9), ("p", "b", 7), ("q", "a", 2), ("p", "c", 1), ("q", "c", 1)], "peer string, origin string, held int")
    assert sorted(map(tuple, changes.collectable(stones, vectors, "origin", "s", "peer").collect())) == [("a", 3), ("c", 1)]
    assert changes.collectable(stones, vectors.limit(0), "origin", "s", "peer").count() == 0


def test_orphans_and_their_grace(spark):
    files = spark.createDataFrame([("d/1.avif", 0.0, 5), ("d/1.jpg", 0.0, 5), ("d/9.avif", 0.0, 5), ("d/9.avif.part", 95.0, 5), ("d/8.avif.part", 5.0, 5), ("d/x", 0.0, 1)], "path string, modified double, bytes int")
    live = spark.createDataFrame([("1",)], "id string")
    assert ids(scan.orphans(files, live, ".avif", ".part", F.lit(100.0), 60), "path") == ["d/1.jpg", "d/8.avif.part", "d/9.avif", "d/x"]


def test_bracket_merges_are_checked(spark):
    frames = [(1, "a", 7, "bracket", "exposure", 2, 5), (1, "b", 7, "bracket", "exposure", 1, 9), (2, "a", 7, "bracket", "focus", None, 5), (2, "b", 7, "bracket", "focus", 1, 4), (3, "a", 7, "bracket", "focus", 1, 1), (3, "b", 8, "bracket", "focus", 2, 2), (4, "a", None, "bracket", "focus", 1, 1), (5, "a", 7, "bracket", "pixelShift", 1, 1), (6, "a", 7, "bracket", None, 1, 1)]
    got = {r["merge"]: (r["problem"], r["ids"]) for r in scan.bracket_orders(spark.createDataFrame(frames, "merge int, id string, stack int, origin string, kind string, index int, taken int"), 4).collect()}
    assert got[1] == (None, ["b", "a"]) and got[2] == (None, ["b", "a"])
    assert got[3][0] == got[4][0] == "not one bracket stack" and got[5][0] == "not all frames of a pixel shift" and got[6][0] == "not one capture"


def test_values_from_outside(spark):
    cases = {"a/b.arw": True, "/a": False, "a//b": False, "a/../b": False, "./a": False, "C:/a": False, "a\\b": False, "": False, "x" * 4096: True, "x" * 4097: False}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "p string")
    assert [r[0] for r in df.select(validity.is_replicated_path(F.col("p"))).collect()] == [*cases.values(), False]
    offsets = spark.createDataFrame([("+11:00",), ("-08:30",), ("      ",), ("+1:00",), ("+11:00\n",), (None,)], "o string")
    assert [r[0] for r in offsets.select(validity.offset_minutes(F.col("o"))).collect()] == [660, -510, None, None, None, None]


def test_canvas_and_rays_are_inverse(spark):
    rows = [(k, x, y) for k in ("rectilinear", "cylindrical", "equirectangular") for x in (0.0, 40.0, 99.0) for y in (10.0, 50.0)]
    df = spark.createDataFrame([*rows, ("other", 1.0, 1.0)], "k string, x double, y double")
    c = (F.lit(50.0), F.lit(50.0), F.lit(0.01))
    got = df.select("k", "x", "y", geometry.ray_to_canvas(F.col("k"), geometry.canvas_to_ray(F.col("k"), F.col("x"), F.col("y"), *c), *c).alias("b")).collect()
    assert all(abs(r["b"][0] - r["x"]) < 1e-9 and abs(r["b"][1] - r["y"]) < 1e-9 for r in got[:-1]) and got[-1]["b"] is None
    turn = [0.0, np.sin(np.pi / 4), 0.0, np.cos(np.pi / 4)]  # a quarter about y
    row = spark.range(1).select(geometry.rotate_back(F.array(*map(F.lit, turn)), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("d")).first()
    assert np.allclose(row["d"], [0, 0, 1])
    m = geometry.primaries_to_xyz([(0.64, 0.33), (0.30, 0.60), (0.15, 0.06)], (0.3127, 0.3290))
    assert np.allclose(m[3:6], [0.2126, 0.7152, 0.0722], atol=1e-3)
    inverse = spark.range(1).select(geometry.inverse3(F.array(*map(F.lit, m))).alias("i")).first()["i"]
    assert np.allclose(np.reshape(inverse, (3, 3)) @ np.reshape(m, (3, 3)), np.eye(3))


def picture(rng, side=24):
    small = rng.uniform(0, 200, (6, 6, 3))
    return np.kron(small, np.ones((side // 6, side // 6, 1))) + rng.uniform(0, 3, (side, side, 3))


def test_descriptors_hold_through_exposure_and_tell_scenes_apart(spark):
    rng = np.random.default_rng(2)
    one, two = picture(rng), picture(rng)
    pictures = {1: one, 2: one * 1.25, 3: one * [1.2, 1.0, 0.9], 4: two, 5: np.full_like(one, 90.0)}
    rows = [(k, x, y, *map(float, p[y, x])) for k, p in pictures.items() for y in range(24) for x in range(24)]
    found = descriptor.descriptors(spark.createDataFrame(rows, "id int, x int, y int, r double, g double, b double"), ["id"], 24, 24, 12)
    d = {r["id"]: np.array(r["descriptor"]) for r in found.collect()}
    assert len(d[1]) == 2 * (36 + 3 * 144) and set(d[5]) == {128}
    s = lambda a, b: descriptor.alike(d[a], d[b], 12, 8)
    assert s(1, 1) == 1 and s(1, 2) > 0.95 and s(1, 3) > 0.85 and s(1, 4) < 0.6 and s(1, 4) == s(4, 1)
    assert descriptor.alike(None, d[1], 12, 8) == descriptor.alike(d[1][:9], d[1], 12, 8) == 0.0


def test_alike_against_plain_loops():
    rng = np.random.default_rng(3)
    side, window, half, cw = 8, 6, 4, 3
    view = half * half + 3 * side * side

    def part(d, v, k):
        at = v * view + (0 if k == 0 else half * half + (k - 1) * side * side)
        n = half if k == 0 else side
        return [[int(d[at + y * n + x]) for x in range(n)] for y in range(n)]

    def directed(a, i, b, j):
        pad, cp = (side - window) // 2, (half - cw) // 2
        far = lambda ox, oy: sum(abs(part(a, i, 0)[cp + y][cp + x] - part(b, j, 0)[oy + y][ox + x]) for y in range(cw) for x in range(cw))
        best = (far(cp, cp), cp, cp)
        for oy in range(2 * cp + 1):
            for ox in range(2 * cp + 1):
                if far(ox, oy) < best[0]:
                    best = (far(ox, oy), ox, oy)
        _, ox, oy = best
        kept = int(window * window * descriptor.AGREEING_CELLS)
        t = [sum(sorted(abs(part(a, i, k)[pad + y][pad + x] - part(b, j, k)[2 * oy + y][2 * ox + x]) for y in range(window) for x in range(window))[:kept]) / kept / 255 for k in (1, 2, 3)]
        w = descriptor.COLOUR_PART
        return (1 - w) * (1 - 3 * t[0]) + w * (1 - 1.5 * (t[1] + t[2]))

    for _ in range(12):
        a, b = (rng.integers(0, 256, 2 * view) // 64 * 40 for _ in range(2))
        b = np.where(rng.random(2 * view) < 0.7, a, b)
        want = max(max(directed(a, i, b, j), directed(b, j, a, i)) for i, j in ((0, 0), (0, 1), (1, 0)))
        assert abs(descriptor.alike(a, b, side, window) - min(1, max(0, want))) < 1e-9


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = MergedTable(f"{tmp_path}/t", ["k"], "s", buckets=8)
    table.apply(spark.createDataFrame([(k, 1, "a") for k in range(40)], "k int, s int, v string"), 0)
    table.apply(spark.createDataFrame([(3, 2, "b"), (100, 1, "c")], "k int, s int, v string"), 1)
    rows = {r["k"]: r["v"] for r in table.read(spark, 1).collect()}
    assert len(rows) == 41 and rows[3] == "b" and rows[100] == "c" and rows[4] == "a"
    assert len(list((tmp_path / "t/rows/v=1").glob("bucket=*"))) <= 2
    assert {r["k"] for r in table.read(spark, 0).collect()} == set(range(40))
