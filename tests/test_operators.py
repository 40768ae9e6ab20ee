import random

from pyspark.sql import functions as F

from vellum.functions import clock, paths
from vellum.operators import changes, filters, graph, listing, lookup, ordering, sequence, similarity


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


ROWS = [("a", "2024-01-02", "2024-01-05"), ("b", None, "2020-01-01"), ("c", "2024-01-03", "2024-01-03"), ("d", "2024-01-02", "2024-01-04")]


def photos(spark):
    return spark.createDataFrame(ROWS, "id string, taken string, added string")


def test_undated_rows_come_last_both_ways(spark):
    df = photos(spark)
    got = {o: ids(ordering.page(df, ordering.order_by(o, "taken", "added", "id"))) for o in ("taken_asc", "taken_desc", "added_asc", "added_desc")}
    assert got == {"taken_asc": ["a", "d", "c", "b"], "taken_desc": ["c", "d", "a", "b"], "added_asc": ["b", "c", "d", "a"], "added_desc": ["a", "d", "c", "b"]}


def test_seek_walks_the_order(spark):
    df = photos(spark)
    order = ["a", "d", "c", "b"]
    at = {r[0]: r[1] for r in ROWS}
    for i, x in enumerate(order):
        assert ids(ordering.seek(df, "taken", "id", (at[x], x), True, 9)) == order[i + 1 :]
        assert ids(ordering.seek(df, "taken", "id", (at[x], x), False, 9)) == order[:i][::-1]


def test_positions_match_a_plain_sort(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(40)])) for i in range(500)]
    got = {r["id"]: r["position"] for r in ordering.positions(spark.createDataFrame(rows, "id long, v long"), ["v", "id"], buckets=7).collect()}
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])))}
    assert got == want


def test_chips_match_any_or_all(spark):
    df = spark.createDataFrame([(1, True, 5), (2, False, 5), (3, True, 0), (4, None, 0)], "id int, hidden boolean, rating int")
    chips = [F.col("hidden"), filters.rated(F.col("rating"), True)]
    assert ids(df.filter(filters.Conditions([], chips, "any").column()).orderBy("id")) == [1, 2, 3]
    assert ids(df.filter(filters.Conditions([F.col("id") > 0], chips).column())) == [1]
    assert ids(df.filter(filters.one_of_or_null(F.col("hidden"), [False], True)).orderBy("id")) == [2, 4]
    assert ids(df.filter(filters.Conditions().column()).orderBy("id")) == [1, 2, 3, 4]


def test_search_keeps_wildcards_and_ignores_case(spark):
    df = spark.createDataFrame([(1, "IMG_01.jpg"), (2, "imgX01.JPG"), (3, None)], "id int, p string")
    assert ids(df.filter(filters.search("img_0", F.col("p"))).orderBy("id")) == [1, 2]


def test_last_day_is_included(spark):
    df = spark.createDataFrame([(1, "2024-03-31 23:59:59"), (2, "2024-04-01 00:00:00")], "id int, t string").withColumn("t", F.to_timestamp("t"))
    assert ids(df.filter(filters.between_days(F.col("t"), None, "2024-03-31"))) == [1]


def test_gap_runs(spark):
    df = spark.createDataFrame([("a", 0, None), ("b", 10, None), ("c", 21, None), ("d", 10, "s")], "id string, t long, shoot string")
    got = {r["id"]: r["run"] for r in sequence.gap_runs(df, ["shoot"], F.col("t"), ["t", "id"], 10).collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 1}


def test_brackets(spark):
    frames = [("p1", 0, 1, 4), ("p2", 1, 2, 4), ("p3", 2, 3, 4), ("p4", 3, 4, 4), ("q1", 10, 1, 3), ("q2", 11, 2, 3), ("r1", 20, 2, None), ("r2", 21, 3, None), ("s1", 30, 1, None), ("s2", 31, 2, None), ("t1", 1000, 1, 2), ("t2", 1700, 2, 2)]
    df = spark.createDataFrame([(i, t, k, c, None, "L") for i, t, k, c in frames], "id string, t long, k int, c int, g int, lane string")
    got = sorted(ids(sequence.brackets(df, ["lane"], F.col("t"), "k", "c", "g", "id", 600)))
    assert got == ["p1", "p2", "p3", "p4", "s1", "s2"]


def test_rank_with_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, 1)], "id int, v int").withColumn("g", F.lit(0))
    got = {r["id"]: r["level"] for r in df.select("id", sequence.rank_to_255("v", ["g"]).alias("level")).collect()}
    assert got == {4: 0, 1: 128, 2: 128, 3: 255}


def test_collapse_gives_one_row_a_group(spark):
    df = spark.createDataFrame([(1, "s", 3), (2, "s", 9), (3, None, 1), (4, None, 2)], "id int, stack string, v int")
    got = {r["id"]: r["group_size"] for r in listing.collapse(df, "stack", [F.desc("v")], F.col("id")).collect()}
    assert got == {2: 2, 3: 1, 4: 1}


def test_prefix_joins(spark):
    rows = spark.createDataFrame([("a/b/x.jpg",), ("a/bc/x.jpg",), ("a/x.jpg",)], "path string")
    folders = spark.createDataFrame([("a/b",), ("a",)], "folder string")
    assert sorted(ids(lookup.at_or_below(rows, "path", folders.filter("folder = 'a/b'"), "folder"), "path")) == ["a/b/x.jpg"]
    assert {r["path"]: r["owner"] for r in lookup.longest_prefix(rows, "path", folders, "folder", "owner").collect()} == {"a/b/x.jpg": "a/b", "a/bc/x.jpg": "a", "a/x.jpg": "a"}


def test_snapshot_diff_and_moves(spark):
    old = spark.createDataFrame([("p1", "h1", False), ("p2", "h2", False), ("p3", None, False), ("p4", "h4", True), ("p5", "h5", False)], "path string, h string, gone boolean")
    new = spark.createDataFrame([("p2", "h9"), ("p3", None), ("p4", "h4"), ("p6", "h1"), ("p7", "h5"), ("p8", "h2")], "path string, h string")
    got = {r["path"]: r["change"] for r in changes.snapshot_diff(old, new, "path", "h", "gone").collect()}
    assert got == {"p1": "removed", "p2": "modified", "p4": "reappeared", "p5": "removed", "p6": "added", "p7": "added", "p8": "added"}
    moves = {(r["from_id"], r["to_id"]) for r in changes.detect_moves(old, new, "path", "h").collect()}
    assert moves == {("p1", "p6"), ("p5", "p7")}


def test_merge_is_the_same_in_any_order(spark):
    rng = random.Random(2)
    log = [(rng.randint(0, 5), rng.choice("xy"), i, rng.random()) for i in range(80)]
    want = None
    for _ in range(3):
        rng.shuffle(log)
        df = spark.createDataFrame(log, "k int, unit string, stamp int, v double")
        got = sorted((r["k"], r["unit"], r["v"]) for r in changes.merge_units(df, ["k"], "unit", ["stamp"], "v").collect())
        assert want in (None, got)
        want = got


def test_upsert_keeps_what_stands_on_ties(spark):
    base = spark.createDataFrame([(1, 5, "old"), (2, 5, "old")], "k int, s int, v string")
    new = spark.createDataFrame([(1, 5, "new"), (2, 6, "new"), (3, 1, "new")], "k int, s int, v string")
    assert sorted(map(tuple, changes.upsert(base, new, ["k"], "s").collect())) == [(1, 5, "old"), (2, 6, "new"), (3, 1, "new")]


def test_version_vector_stays_below_what_is_deferred(spark):
    applied = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "origin string, s int")
    waiting = spark.createDataFrame([("a", 3)], "origin string, s int")
    assert {r["origin"]: r["held"] for r in changes.version_vector(applied, waiting, "origin", "s").collect()} == {"a": 1, "b": 2}


def test_clock_rises_and_refuses_the_future(spark):
    c = clock.Clock("peer000000000001")
    stamps = [c.mint(1000), c.mint(1000), c.mint(900), c.mint(2000)]
    assert stamps == sorted(set(stamps))
    c.count = clock.MAX_COUNTER
    assert c.mint(2000) > stamps[-1]
    c.observe(f"{9000:012x}0007other", 8000)
    assert c.mint(100).startswith(f"{9000:012x}0008")
    try:
        c.observe(f"{9000 + 2 * clock.MAX_SKEW_MS:012x}0000other", 8000)
        raise AssertionError
    except ValueError:
        pass
    row = spark.createDataFrame([(stamps[1],)], "s string").select(clock.millis(F.col("s")).alias("m"), clock.counter(F.col("s")).alias("c"), clock.origin(F.col("s")).alias("o")).first()
    assert tuple(row) == (1000, 1, "peer000000000001")


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(400, 400), (None, 3)] + [(i, i + 1) for i in range(500, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cliques_need_every_member(spark):
    v = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.1, 1.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in v], "id long, v array<double>, run int")
    got = {r["id"]: r["clique"] for r in similarity.clique_groups(df, ["run"], ["id"], "v", "id", 0.8).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: -1}


def test_distinct_matches_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(20, 4)), rng.normal(size=(50, 4))
    b[:10] = a[:10] + 0.01
    frame = lambda m: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, v array<double>")
    got = {(r["left_id"], r["right_id"]) for r in similarity.distinct_matches(frame(a), frame(b), "id", "v", 0.7, block=16).collect()}
    want = {}
    for i, x in enumerate(a):
        d = np.sqrt(((b - x) ** 2).sum(axis=1))
        j, k = np.argsort(d)[:2]
        if d[j] < 0.7 * d[k] and (j not in want or d[j] < want[j][1]):
            want[j] = (i, d[j])
    assert got == {(i, j) for j, (i, _) in want.items()}


def test_paths(spark):
    df = spark.createDataFrame([("lib/2024/IMG.1.ARW",)], "p string")
    p = F.col("p")
    row = df.select(paths.folder(p), paths.stem(p), paths.extension(p), paths.format_class(p), paths.moved(p, "lib/2024", "x"), paths.prefixes(p)).first()
    assert tuple(row) == ("lib/2024", "IMG.1", "arw", "raw", "x/IMG.1.ARW", ["lib", "lib/2024", "lib/2024/IMG.1.ARW"])


def test_rank_select_matches_a_sort(spark):
    from vellum.operators import arrays

    rng = random.Random(6)
    v = [rng.choice([rng.gauss(0, 1), 0.25, -3.0]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    for rank in (0, 3, 250, 499):
        assert arrays.rank_select(df, F.col("v"), rank, min(v), max(v), bins=4, rounds=2) == sorted(v)[rank]
    assert arrays.rank_select(df, F.col("v"), 500, min(v), max(v)) is None


def test_largest_rectangle_against_brute_force(spark):
    from vellum.operators import arrays

    rng = random.Random(7)
    rows = [(g, x, y, rng.random() < 0.75) for g in range(4) for x in range(7) for y in range(6)]
    got = {r["g"]: r for r in arrays.largest_rectangle(spark.createDataFrame(rows, "g int, x int, y int, on boolean"), ["g"], "x", "y", "on").collect()}
    for g in range(4):
        on = {(x, y) for k, x, y, v in rows if k == g and v}
        full = lambda a, b, w, h: all((x, y) in on for x in range(a, a + w) for y in range(b, b + h))
        best = max(w * h for a in range(7) for b in range(6) for w in range(1, 8 - a) for h in range(1, 7 - b) if full(a, b, w, h))
        r = got[g]
        assert r["area"] == best == r["width"] * r["height"] and full(r["left"], r["top"], r["width"], r["height"])


def test_consensus_finds_the_map_among_outliers(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        x, y = rng.uniform(0, 100), rng.uniform(0, 100)
        bx, by = (2 * x - y + 5, x + 3 * y - 1) if i < 40 else (rng.uniform(0, 300), rng.uniform(0, 300))
        rows.append((1, x, y, bx, by))
    rows += [(2, 1.0, 1.0, 2.0, 2.0)]
    got = similarity.consensus(spark.createDataFrame(rows, "p int, ax double, ay double, bx double, by_ double"), ["p"], 0.5).collect()
    assert len(got) == 1 and got[0]["agreed"] >= 40
    assert all(abs(got[0][f"m{i}"] - v) < 1e-6 for i, v in enumerate((2, -1, 5, 1, 3, -1)))


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 1)], "a int, b int")
    assert sorted(ids(graph.reachable(edges, spark.createDataFrame([(1,)], "node int")), "node")) == [1, 2, 3]


def test_document_differences_apply_and_undo(spark):
    from vellum.operators import documents

    df = spark.createDataFrame([('{"a":1,"b":"x","c":{"d":1}}', '{"a":2,"c":{"d":1},"e":[1]}'), (None, '{"a":1}')], "old string, new string")
    d = df.withColumn("diff", documents.difference(F.col("old"), F.col("new")))
    rows = d.select("diff", documents.apply(F.col("old"), F.col("diff")).alias("on"), documents.apply(F.col("new"), F.col("diff"), True).alias("back"), documents.fields(F.col("old")).alias("o"), documents.fields(F.col("new")).alias("n")).collect()
    assert set(rows[0]["diff"]) == {"a", "b", "e"}
    assert all(r["on"] == r["n"] and r["back"] == r["o"] for r in rows)


def test_merged_table_is_the_same_for_a_repeated_batch(spark, tmp_path):
    from vellum.streaming.change_log import MergedTable, read_log

    log = spark.createDataFrame([(k, s, f"v{k}{s}") for k in range(5) for s in range(6)], "k int, s int, v string")
    log.repartition(4).write.parquet(f"{tmp_path}/log")
    table = MergedTable(f"{tmp_path}/table", ["k"], "s")
    run = table.start(read_log(spark, f"{tmp_path}/log", log.schema, 1), f"{tmp_path}/progress")
    run.awaitTermination()
    last = max(p.batchId for p in run.recentProgress if p.numInputRows)
    want = [(k, 5, f"v{k}5") for k in range(5)]
    assert sorted(map(tuple, table.read(spark, last).collect())) == want
    table.apply(log.filter("s = 5"), last)
    assert sorted(map(tuple, table.read(spark, last).collect())) == want
