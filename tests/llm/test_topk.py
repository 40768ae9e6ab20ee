import numpy as np
from pyspark.sql import functions as F

from vellum.llm import topk


def brute(rows, k):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 50 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, shard int")
    vectors = topk.integer_vectors(df, "vec_id", "embedding", 256)
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), **options).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(600, 16)) * 0.1
    m[100:130] = m[7]  # ties
    m[200] = 0
    rows = [(i, row.tolist(), "x", 1) for i, row in enumerate(m)]
    rows += [(601, None, "x", 1), (602, [], "x", 1), (603, [None] * 16, "x", 1), (650, [float("nan")] * 16, "x", 1), (700, [float("inf")] * 16, "x", 1), (None, m[3].tolist(), "x", 1), (750, [0.5], "x", 1)]
    want = brute([(i, v) for i, v, *_ in rows if i != 750], 5)
    assert found(spark, rows) == want
    assert found(spark, rows, shard_rows=40, block=4, rescore=1, width=3) == want


def test_few_and_none(spark):
    assert found(spark, []) == set()
    rows = [(0, [1.0, 2.0], "x", 1), (50, [1.0, 0.0], "x", 1), (51, [1.0, 0.0], "x", 1)]
    assert found(spark, rows) == brute([(i, v) for i, v, *_ in rows], 5)


def test_early_stop_is_exact():
    rng = np.random.default_rng(2)
    m = np.floor(rng.normal(size=(3000, 64)) * 30).astype(np.int64)
    m[:20] *= 4
    index = topk.ImpactIndex(np.arange(3000), m, 8)
    for q in (0, 5, 77, 2999):
        ids, scores = index.search(m[q : q + 1], np.array([q]), 5, 64)[0]
        exact = m @ m[q]
        best = sorted(((-s, i) for i, s in enumerate(exact) if i != q))[:5]
        assert list(zip(ids.tolist(), scores.tolist())) == [(i, -s) for s, i in best]


def test_bars_of_earlier_shards_leave_out_what_cannot_win():
    rng = np.random.default_rng(3)
    m = np.floor(rng.normal(size=(500, 32)) * 30).astype(np.int64)
    index = topk.ImpactIndex(np.arange(500), m, 8)
    exact = np.sort(m @ m[9])[::-1]
    for bar, n in ((exact[3], 3), (exact[0] + 1, 0), (-(2**62), 5)):
        ids, scores = index.search(m[9:10], np.array([9]), 5, 1, np.array([bar]))[0]
        assert scores.tolist() == exact[1 : n + 1].tolist()
