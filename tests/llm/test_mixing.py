from pyspark.sql import functions as F

from vellum.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target long"


def fill(sizes, weights, share, most):
    """Rounds of clamping and sharing, the plain way."""
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = {s for s in sizes if s not in fixed}
        left = total - sum(fixed.values())
        got = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if got[s] >= most * sizes[s]}
        if not over:
            return fixed | got
        fixed |= {s: most * sizes[s] for s in over}
        if len(fixed) == len(sizes):
            return fixed


def docs(spark, sizes):
    rows = [(1000 * i + j, "w " * (1 + j % 7), s, "clash", 1) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_taken(spark):
    df = docs(spark, {"a": 300, "b": 20, "c": 50, "d": 400, None: 10, "B": 90})
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    sizes = {r["source"]: r["source_size"] for r in rows}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    expected = fill(sizes, weights, 1.5, 2.0)
    for s in sizes:
        mine = [r for r in rows if r["source"] == s]
        assert abs(mine[0]["target"] - expected[s]) < 1e-6 * max(1, expected[s])
        taken = sum(r["taken"] for r in mine)
        assert abs(taken - expected[s]) <= 7
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(df).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_edges(spark):
    rows = [(1, None, "a", "x", 0), (2, "", "a", "x", 0), (None, "one two", None, "x", 0), (3, "w\tw\x0bw", "a", "x", 0), (3, "w\tw\x0bw", "a", "x", 0)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in out) == [(-1, 2), (1, 0), (2, 0), (3, 3), (3, 3)]
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.repeat_rows(empty).count() == 0
    df = docs(spark, {"a": 30, "b": 3})
    repeated, plan = mixing.repeat_rows(df), mixing.mix(df)
    assert repeated.columns == df.columns
    assert repeated.count() == plan.agg(F.sum("copies")).first()[0]


def test_rows_without_an_id_or_of_one_id_are_drawn_by_their_texts(spark):
    rows = [(None if j % 2 else 5, f"word{j} " * 5, s, "clash", 1) for s, n in (("a", 400), ("b", 900)) for j in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 5
    assert abs(mixing.repeat_rows(df).count() * 5 - 1.5 * 5 * 1300) <= 10
    assert mixing.repeat_rows(df).filter("doc_id IS NULL").select("text").distinct().count() > 300


def test_many_sources_are_joined_with_the_same_result(spark, monkeypatch):
    df = docs(spark, {"a": 40, "b": 9, None: 5, "c": 25})
    want = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(df).collect())
    copies = sorted(r["doc_id"] for r in mixing.repeat_rows(df).collect())
    monkeypatch.setattr(mixing, "SENT_SOURCES", 2)
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mix(df).collect()) == want
    assert sorted(r["doc_id"] for r in mixing.repeat_rows(df).collect()) == copies
