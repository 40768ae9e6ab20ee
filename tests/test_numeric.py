import random
from bisect import bisect_left, bisect_right

import numpy as np
import pytest

from vellum.operators import knots, pairing, solver, tiles


def plain_pairs(gone, new, changed):
    """One file after another."""
    gone, new, out = sorted(gone, key=lambda g: (g[1], g[0])), sorted(new), set()
    free = list(new)
    for content, channel in changed:
        at = next((i for i, n in enumerate(free) if content is not None and n[1:] == (content, channel)), None)
        if at is not None:
            free.pop(at)
    used = set()

    def pair(g, n):
        used.update([("g", g[0]), ("n", n[0])])
        out.add((g[0], g[1], n[0], g[2], {("live", "live"): "move", ("bin", "bin"): "within", ("live", "bin"): "in", ("bin", "live"): "out"}[g[3], n[2]]))

    for content in {g[2] for g in gone} - {None}:
        for channels in (("live",), ("bin",), ("live", "bin")):
            a = sorted((g for g in gone if g[2] == content and g[3] in channels and ("g", g[0]) not in used), key=lambda g: not g[4])
            b = [n for n in free if n[1] == content and n[2] in channels and ("n", n[0]) not in used]
            for g, n in zip(a, b):
                pair(g, n)
    return out


def test_staged_pairs_are_the_sequential_rule(spark):
    rng = random.Random(1)
    for n in (0, 400):
        contents = [None, *(f"h{i}" for i in range(25)), *["hot"] * 12]
        gone = [(i, f"old/{rng.randrange(10**6)}", rng.choice(contents), rng.choice(["live", "bin"]), rng.choice([True, False, None])) for i in range(n)]
        new = [(f"new/{i:05}", rng.choice(contents), rng.choice(["live", "bin"])) for i in range(n)]
        changed = [(rng.choice(contents), rng.choice(["live", "bin"])) for _ in range(n // 5)]
        got = pairing.staged_pairs(
            spark.createDataFrame(gone, "row_id long, path string, content string, channel string, member boolean"), spark.createDataFrame(new, "path string, content string, channel string"), spark.createDataFrame(changed, "old_content string, channel string")
        )
        assert {tuple(r) for r in got.select("row_id", "old_path", "new_path", "content", "kind").collect()} == plain_pairs(gone, new, changed)


@pytest.mark.parametrize("kernel,halo", [(tiles.median, 1), (tiles.range_of, 3), (tiles.median, 0)])
def test_tiles_equal_the_whole_picture(spark, kernel, halo):
    rng = np.random.default_rng(halo)
    pictures = {"p": (23, 19, 0, 0), "q": (9, 30, -5, 3), "r": (1, 1, 100, 100)}
    rows, want = [], {}
    for name, (h, w, y0, x0) in pictures.items():
        m = np.where(rng.random((h, w)) < 0.1, np.nan, rng.integers(0, 50, (h, w)).astype(float))
        out = kernel(np.pad(m, halo, constant_values=np.nan), halo)
        for y in range(h):
            for x in range(w):
                rows.append((name, y + y0, x + x0, None if np.isnan(m[y, x]) and x % 2 else float(m[y, x])))
                if not np.isnan(m[y, x]):
                    want[name, y + y0, x + x0] = float(out[y, x])
    cut = tiles.to_tiles(spark.createDataFrame(rows, "picture string, y int, x int, value double"), 5)
    got = {tuple(r)[:3]: r["value"] for r in tiles.to_pixels(tiles.stencil(cut, kernel, 5, halo), 5).collect()}
    assert got == want
    assert max(len(p["pieces"]) for p in tiles.with_halos(cut, 5, halo).collect()) <= 9


def test_a_halo_is_no_wider_than_a_tile(spark):
    with pytest.raises(ValueError):
        tiles.with_halos(spark.createDataFrame([], "picture string, ty long, tx long, values array<double>"), 4, 5)
    assert tiles.stencil(tiles.to_tiles(spark.createDataFrame([], "picture string, y int, x int, value double"), 4), tiles.median, 4, 1).count() == 0


def plain_value(table, x, ends):
    if x is None or x != x or not table:
        return None
    at = [k for k, _ in table]
    i, j = bisect_right(at, x) - 1, bisect_left(at, x)
    if 0 <= i and at[i] == x:
        return table[i][1]
    if i < 0 or j >= len(at):
        return None if ends == "null" else table[max(i, 0)][1]
    (a, v), (b, w) = table[i], table[j]
    return v + (w - v) * ((x - a) / (b - a))


@pytest.mark.parametrize("ends,ranges", [("clamp", None), ("null", 1), ("clamp", 9)])
def test_interpolation_against_bisection(spark, ends, ranges):
    rng = random.Random(4)
    knot = [(g, float(rng.randrange(100)), rng.choice([None, float(rng.randrange(9)), float(rng.randrange(9))])) for g in ("a", "b", None) for _ in range(12)] + [("a", None, 3.0), ("one", 5.0, 7.0), ("a", float("nan"), 1.0)]
    rows = [(i, rng.choice(["a", "a", "a", "b", None, "one", "none"]), rng.choice([None, float("nan"), 5.0, rng.randrange(-10, 110) * 1.0, rng.random() * 100]), "x") for i in range(300)]
    tables = {}
    for g, x, v in knot:
        if x is not None and x == x and v is not None:
            tables.setdefault(g, {})[x] = min(v, tables.setdefault(g, {}).get(x, v))
    got = knots.interpolated(spark.createDataFrame(rows, "id long, lens string, place double, __v string"), spark.createDataFrame(knot, "lens string, place double, gain double"), "lens", "place", "gain", "gain", ends, ranges)
    assert got.columns == ["id", "lens", "place", "__v", "gain"]
    got = {r["id"]: r["gain"] for r in got.collect()}
    for i, g, x, _ in rows:
        want = plain_value(sorted(tables.get(g, {}).items()), x, ends)
        assert got[i] == want if want is None else abs(got[i] - want) < 1e-9
    assert len(got) == len(rows)


def test_rotations_come_back_despite_outliers(spark):
    rng = np.random.default_rng(6)
    n = 9
    truth = solver.rotation_of(rng.normal(size=(n, 3)))
    pairs = [(a, b, 0) for a in range(n) for b in range(a + 1, n) if b - a <= 3 or rng.random() < 0.3]
    rows = []
    for i, (a, b, _) in enumerate(pairs):
        wrong = i % 6 == 5
        m = solver.rotation_of(rng.normal(size=(1, 3)) * (1.5 if wrong else 0.002))[0] @ truth[b] @ truth[a].T
        rows.append((a, b, m.ravel().tolist()))
    rows += [(0, 0, rows[0][2]), (3, 99, rows[0][2]), (None, 2, rows[0][2]), (1, 2, None)]
    start = truth @ solver.rotation_of(rng.normal(size=(n, 3)) * 0.15)
    frames = [(i, r.ravel().tolist()) for i, r in enumerate(start)] + [(50, np.eye(3).ravel().tolist())]
    got = solver.robust_rotations(spark.createDataFrame(frames, "frame long, rotation array<double>"), spark.createDataFrame(rows, "a long, b long, rotation array<double>"), most=6)
    out = {r["frame"]: np.array(r["rotation"]).reshape(3, 3) for r in got.collect()}
    assert set(out) == {f for f, _ in frames} and np.allclose(out[50], np.eye(3)) and np.allclose(out[0], start[0], atol=1e-9)
    apart = np.stack([(out[i] @ out[0].T).T @ (truth[i] @ truth[0].T) for i in range(n)])
    assert np.linalg.norm(solver.turn_of(apart), axis=1).max() < 0.02


def test_turns_and_rotations_are_inverse():
    rng = np.random.default_rng(1)
    turn = rng.normal(size=(500, 3))
    turn = turn / np.linalg.norm(turn, axis=1)[:, None] * np.concatenate([rng.random(497) * 3.14, [0, 1e-12, np.pi]])[:, None]
    assert np.allclose(solver.rotation_of(solver.turn_of(solver.rotation_of(turn))), solver.rotation_of(turn), atol=1e-6)


def test_laplacian_solution(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1, float(rng.random() + 0.1)) for i in range(9)] + [(0, 5, 0.7), (2, 8, 0.3)]
    lap = np.zeros((10, 10))
    for a, b, w in edges:
        lap[[a, b], [a, b]] += w
        lap[[a, b], [b, a]] -= w
    v = rng.normal(size=(10, 2))
    v -= v.mean(axis=0)
    got = solver.solve_laplacian(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "node long, v array<double>"), 1e-8)
    w = np.array([r["w"] for r in sorted(got.collect())])
    assert np.allclose(lap @ w, v, atol=1e-6) and np.allclose(w.sum(axis=0), 0, atol=1e-6)
