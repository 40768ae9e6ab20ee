import hashlib

import numpy as np
import pytest

from vellum.llm import codebooks

COLS = "vec_id long, embedding array<float>, label int, v string, code string, part int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = np.array([[int(np.floor(1024 * float(np.float32(x)))) for x in v] for _, v, _ in kept], np.int64)
    x = m.reshape(len(kept), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    near = lambda p: ((x[:, p, None] - books[p][None]) ** 2).sum(-1)
    for _ in range(rounds):
        for p in range(parts):
            at = near(p).argmin(1)
            for e in set(at.tolist()):
                own = x[at == e, p]
                books[p][e] = [int(s) // len(own) for s in own.sum(0)]
    at, apart = (np.stack([f(near(p)) for p in range(parts)], 1) for f in (lambda d: d.argmin(1), lambda d: d.min(1)))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e.tolist()).encode()).hexdigest()
    error = apart.sum(1).tolist()
    return sorted(((i, "".join(f"{e:02x}" for e in a), e, sum(e2 for e2, r in zip(error, kept) if r[2] == lab), sha) for (i, _, lab), a, e in zip(kept, at.tolist(), error)), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], COLS)
    return sorted(map(tuple, codebooks.vector_codes(df, **options).collect()), key=repr)


@pytest.mark.parametrize("seed,spread", [(1, 0.2), (2, 0.002)])
def test_against_all_distances(spark, seed, spread):
    """The small spread gives very many equal distances and equal entries."""
    rng = np.random.default_rng(seed)
    m = (rng.normal(size=(700, 16)) * spread).astype(np.float32)
    m[300:420] = m[5]
    rows = [(int(i), row.tolist(), None if i % 7 == 0 else int(i % 3)) for i, row in zip(rng.permutation(700), m)]
    rows += [(None, m[3].tolist(), 1), (4, m[9].tolist(), 1), (4, m[9].tolist(), 1)]
    want = brute(rows)
    rows += [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] + [0.0] * 15, 1), (903, [float("-inf")] * 16, 2), (904, [0.5], 2), (905, [], 1)]
    assert found(spark, rows) == want


def test_few_rows_and_none(spark):
    assert found(spark, []) == []
    rows = [(2, [0.1, -0.1, 0.2, 0.0], None), (1, [0.1, 0.1, 0.1, 0.1], 5)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(1, None, 2)]) == []
    with pytest.raises(ValueError):
        found(spark, [(1, [0.5], 2)])


def test_tree_gives_the_lowest_of_equal_entries():
    rng = np.random.default_rng(4)
    for size in (1, 2, 9, 256):
        for wide in (2, 5, 1000):
            points, x = rng.integers(0, wide, (size, 4)), rng.integers(-2, wide + 2, (500, 4))
            apart = ((x[:, None] - points[None]) ** 2).sum(-1)
            index, best = codebooks.KdTree(points, 2).nearest(x)
            assert (index == apart.argmin(1)).all() and (best == apart.min(1)).all()


def test_codes_stand_for_their_entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist(), 1) for i in range(60)]
    vectors = codebooks.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label", 1024)
    books = codebooks.learn(vectors, 2, 16, 2)
    real = {r["vec_id"]: r["v"] for r in vectors.collect()}
    for r in codebooks.decoded(codebooks.encode(vectors, books), books, "near").collect():
        assert r["error"] == sum((a - b) ** 2 for a, b in zip(real[r["vec_id"]], r["near"]))
