import random
from collections import Counter

import pytest

from vellum.operators import graph, links
from vellum.streaming import groups, views


def comps(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_groups_equal_a_full_run_after_every_batch(spark, tmp_path):
    rng, table = random.Random(3), groups.LinkGroups(str(tmp_path), "long", 16)
    now, labels = set(), {}
    for version in range(5):
        batch = [(*rng.sample(range(60), 2), False) for _ in range(14)] + [(*p, True) for p in rng.sample(sorted(now), min(len(now), 6))] + [(7, 7, False), (None, 3, False), (200 + version, 300, True)]
        moved = table.apply(spark.createDataFrame(batch, "a long, b long, removed boolean"), version)
        gone = {tuple(sorted(p[:2])) for p in batch if p[2]}
        now = {tuple(sorted(p[:2])) for p in batch if not p[2] and None not in p[:2] and p[0] != p[1]}.union(now) - gone
        want = comps(now)
        got = {r["node"]: r["component"] for r in table.groups(spark, version).collect()}
        assert got == want
        assert {(r["node"], r["was"], r["component"]) for r in moved.collect()} == {(n, labels.get(n), want.get(n)) for n in {*labels, *want} if labels.get(n) != want.get(n)}
        labels = want
    one = spark.createDataFrame([(1000, 1001, False)], "a long, b long, removed boolean")
    table.apply(one, 5)
    written = {b for t in (table.labels, table.links) for b, at in t.named(spark, 5).items() if at == 5}
    assert written == table.labels.touched(spark.createDataFrame([(1000,), (1001,)], "node long")) | table.links.touched(spark.createDataFrame([(1000,)], "component long"))
    table.apply(one, 6)  # a link that is there already
    assert 6 not in {at for t in (table.labels, table.links) for at in t.named(spark, 6).values()}
    assert table.clean(spark, 6) > 0 and {r["node"]: r["component"] for r in table.groups(spark, 6).collect()} == {**labels, 1000: 1000, 1001: 1000}


def test_links_between_near_vertices_cost_few_rounds(spark, monkeypatch):
    """Chains of 20 vertices on several tasks: joined within a range first, then one round for those that a border cuts."""
    edges = [(20 * c + i, 20 * c + i + 1) for c in range(200) for i in range(19)]
    random.Random(1).shuffle(edges)
    kept, cut = graph.checkpointed, []
    monkeypatch.setattr(graph, "EDGES_PER_TASK", 500)
    monkeypatch.setattr(graph, "checkpointed", lambda df: cut.append(1) or kept(df))
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: v // 20 * 20 for v in range(4000)}
    assert len(cut) <= 3


def test_view_equals_recomputing_with_deletes(spark, tmp_path):
    rng = random.Random(5)
    view = views.JoinView(str(tmp_path), "k long", "x string", "y string", "x <> y", 8)
    left, right = Counter(), Counter()
    for version in range(5):
        deltas = []
        for side in (left, right):
            delta = Counter((rng.choice([None, *range(9)]), rng.choice("abc")) for _ in range(12))
            for row in rng.sample(sorted(side, key=repr), min(len(side), 5)):
                delta[row] -= side[row]
            side.update(delta)
            for row in [r for r, n in side.items() if n == 0]:
                del side[row]
            deltas.append(spark.createDataFrame([(*r, n) for r, n in delta.items()], f"k long, {'x' if side is left else 'y'} string, n long"))
        was = {tuple(r)[:3]: r["n"] for r in view.read(spark, version - 1).collect()}
        change = view.apply(deltas[0], deltas[1] if version != 3 else None, version)
        if version == 3:
            right.subtract({tuple(r)[:2]: r["n"] for r in deltas[1].collect()})
            right = Counter({r: n for r, n in right.items() if n})
        want = Counter()
        for (k, x), n in left.items():
            for (j, y), m in right.items():
                if k is not None and k == j and x != y:
                    want[k, x, y] += n * m
        got = {tuple(r)[:3]: r["n"] for r in view.read(spark, version).collect()}
        assert got == dict(want)
        assert {tuple(r)[:3]: r["n"] for r in change.collect()} == {r: got.get(r, 0) - was.get(r, 0) for r in {*got, *was} if got.get(r, 0) != was.get(r, 0)}
    with pytest.raises(Exception, match="isn't there"):
        view.apply(spark.createDataFrame([(1, "zz", -1)], "k long, x string, n long"), None, 5)
    nothing = spark.createDataFrame([], "k long, x string, n long")
    assert view.apply(nothing, None, 6).count() == 0 and {tuple(r)[:3]: r["n"] for r in view.read(spark, 6).collect()} == dict(want)


def plain_swaps(members, manual):
    """File by file, as a person would go through a group."""
    out = {}
    for group in {m[0] for m in members}:
        own = sorted((m for m in members if m[0] == group), key=lambda m: m[1])
        raws = [m for m in own if m[2]]
        if not raws or not any(m[3] for m in own if not m[2]):
            continue
        _, raw, _, stack, out_of = raws[0]
        start = stack
        for _, i, is_raw, held, _ in own:
            if is_raw or held is None:
                continue
            if (not out_of) if stack is None else (not manual[stack] and manual[held]):
                stack = held
            out[i] = None
        if stack != start:
            out[raw] = stack
    return out


def test_swaps_into_stacks(spark):
    rng, manual = random.Random(2), {f"s{i}": i % 2 == 0 for i in range(8)}
    members = [(g, f"{g}-{i}", rng.random() < 0.4, rng.choice([None, *manual]), rng.random() < 0.3) for g in range(150) for i in range(rng.randint(1, 4))]
    got = links.swaps_into_stacks(spark.createDataFrame(members, "group long, id string, is_raw boolean, stack_id string, unstacked boolean"), spark.createDataFrame(list(manual.items()), "stack_id string, manual boolean"))
    rows = got.collect()
    assert {r["id"]: r["stack_id"] for r in rows} == plain_swaps(members, manual) and len({r["id"] for r in rows}) == len(rows)
    spent = links.spent_stacks(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "stack_id string"))
    assert [r["stack_id"] for r in spent.collect()] == ["b"]
