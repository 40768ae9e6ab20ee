"""What larger tables brought up: steps whose work or memory grew faster than the input, and rows that small tables don't have."""

import glob
import os
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.types import StructType

import vellum.plans as plans
from vellum.operators import knots, solver
from vellum.plans import imports
from vellum.sources import feed
from vellum.streaming import change_log


def against_sql(spark, folder, name, **tables):
    """A query's rows over these tables, and its SQL's."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    found = con.execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    return sorted(tuple(r[c] for c in names) for r in df.collect()), sorted(found.fetchall())


def test_no_knot_is_looked_for_to_the_end_of_a_range(spark):
    rows = spark.range(50).selectExpr("id", "id % 2 AS lens", "id * 1.0D AS place")
    table = spark.range(9).selectExpr("id % 2 AS lens", "id * 5.0D AS place", "id * 1.0D AS gain")
    plan = knots.interpolated(rows, table, "lens", "place", "gain", "gain")._jdf.queryExecution().toString().lower()
    assert "currentrow$(), unboundedfollowing$()" not in plan


def test_levels_round_pixels_as_floats(spark, tmp_path):
    x = np.arange(1, 1 << 22, dtype=np.float32) / np.float32(1 << 23) + np.float32(0.25)
    halves = x[np.floor(x * np.float32(1000) + np.float32(0.5)) != np.floor(x.astype(float) * 1000 + 0.5)][:8]
    vectors = [(i, [float(h) if k == 9 else float(np.float32(np.floor(float(h) * 1000) / 1000)) for k in range(64)], 0) for i, h in enumerate(halves)]
    got, want = against_sql(spark, tmp_path, "descriptor_levels", embeddings=("vec_id long, embedding array<float>, label int", vectors))
    assert len(halves) == 8 and got == want


def test_ranges_end_where_sql_rounds_halves(spark, tmp_path):
    people = [(i * 10, "n", i % 2, 50.0 + 100.0 * i, "m") for i in range(8)]
    got, want = against_sql(spark, tmp_path, "merged_ranges", customer=("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", people))
    assert got == want


def test_a_feed_is_planned_without_its_keys(tmp_path):
    n, order = 30_000, ["stamp", "row_id"]
    pq.write_table(pa.table({"stamp": [f"{i // 2:012x}" for i in range(n)], "row_id": [str(i % 2) for i in range(n)]}), tmp_path / "log.parquet", row_group_size=4000)
    options = {"path": str(tmp_path), "order": ",".join(order), "page": "10", "pages": str(1 << 20)}
    reader = feed.FeedReader(StructType().add("stamp", "string").add("row_id", "string"), options)
    tracemalloc.start()
    end = reader.latestOffset()
    pages = reader.partitions(reader.initialOffset(), end)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1 << 20 and len(pages) == 8
    assert sum(b.num_rows for p in pages for b in reader.read(p)) == n
    short = feed.FeedReader(StructType().add("stamp", "string").add("row_id", "string"), options | {"pages": "700"})
    at, ends = short.initialOffset(), []
    while (now := short.latestOffset()) != at:
        ends.append(sum(b.num_rows for p in short.partitions(at, now) for b in short.read(p)))
        at = now
    assert ends == [7000] * 4 + [2000]


def test_crops_of_few_bytes_are_many_tasks(spark, tmp_path):
    spark.range(20).selectExpr("id AS s_suppkey", "CAST(id % 25 AS INT) AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert plans.QUERIES["filling_crops"](spark, str(tmp_path)).rdd.getNumPartitions() > 1


def test_a_tree_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(40).selectExpr("id AS o_orderkey", "'F' AS o_orderstatus", "id % 2 || '-x' AS o_orderpriority").repartition(4).write.parquet(f"{tmp_path}/orders.parquet")
    writers, scan = set(), plans.live.tree.scan

    def seen(session, root, **options):
        writers.update(os.path.basename(f)[:10] for f in glob.glob(f"{root.removeprefix('file:')}/**/*.parquet", recursive=True))
        return scan(session, root, **options)

    monkeypatch.setattr(plans.live.tree, "scan", seen)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert plans.QUERIES["tree_below_a_prefix"](spark, str(tmp_path)).count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(writers) > 1


def test_claims_on_one_folder_are_the_work_of_many_tasks(spark, monkeypatch):
    from vellum.operators import changes

    monkeypatch.setattr(changes, "PAIRS_PER_TASK", 50, raising=False)
    arrivals = spark.range(40).selectExpr("id % 1 AS library_id", "id", "IF(id % 9 = 0, NULL, 'f' || id % 1) AS path", "'g' AS was", "id % 3 AS stamp")
    holders = spark.range(30).selectExpr("id % 1 AS library_id", "100 - id AS id", "'f' || id % 1 AS path", "id % 2 AS stamp")
    assert changes.folder_claims(arrivals, holders).count() == 35 * 30
    sizes = changes._met(arrivals, holders.withColumnRenamed("id", "held_by").drop("stamp"), ["library_id", "path"]).rdd.glom().map(len).collect()
    assert sum(sizes) == 35 * 30 and max(sizes) < sum(sizes) / 3


def test_sidecars_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imports, "FILES_PER_TASK", 10, raising=False)
    writers, read = set(), imports.sidecar.read

    def seen(session, folder, pattern):
        writers.update(os.path.basename(f).split("-")[1] for f in glob.glob(f"{folder.removeprefix('file:')}/*/*.txt"))
        return read(session, folder, pattern)

    monkeypatch.setattr(imports.sidecar, "read", seen)
    found, wanted = against_sql(spark, tmp_path, "sidecar_edits_from_files", supplier=("s_suppkey long", [(i,) for i in range(40)]))
    assert found == wanted and len(found) == 40 and len(writers) > 1


def test_a_step_of_a_solve_broadcasts_nothing(spark, monkeypatch):
    plans_of, observed = [], solver._observed

    def seen(df, folder, **sums):
        plans_of.append(df._jdf.queryExecution().sparkPlan().toString())
        return observed(df, folder, **sums)

    monkeypatch.setattr(solver, "_observed", seen)
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "a long, b long, weight double")
    rhs = spark.createDataFrame([(i, [float(2 * i - 5)]) for i in range(6)], "node long, v array<double>")
    w = {r["node"]: r["w"][0] for r in solver.solve_laplacian(edges, rhs, most=3).collect()}
    assert len(w) == 6 and len(plans_of) > 2 and not any("Broadcast" in p for p in plans_of)


def test_a_micro_batch_is_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    table = change_log.MergedTable(f"{tmp_path}/table", ["k"], "stamp", 4)
    for version in (0, 1):
        rows = spark.range(20).selectExpr("id AS k", f"id + {version} AS stamp")
        table.apply(rows.mapInPandas(count, "k long, stamp long"), version)
    assert seen.value == 40 and table.read(spark, 1).filter("stamp = k + 1").count() == 20


def test_passes_of_a_solve_do_not_grow_with_a_chain(spark, monkeypatch):
    """A chain of frames is solved exactly by blocks and levels of blocks, not by steps that carry a turn one frame on."""
    monkeypatch.setattr(solver, "FRAMES_PER_BLOCK", 12, raising=False)
    passes, observed = [], solver._observed
    monkeypatch.setattr(solver, "_observed", lambda *a, **k: passes.append(1) or observed(*a, **k))
    rng = np.random.default_rng(3)
    truth = solver.rotation_of(np.cumsum(rng.normal(size=(60, 3)), axis=0) * 0.05)
    pairs = [(a, b) for a in range(60) for b in (a + 1, a + 2) if b < 60 and not a < 40 <= b]  # two chains
    rows = [(a, b, (truth[b] @ truth[a].T).ravel().tolist()) for a, b in pairs]
    start = truth @ solver.rotation_of(rng.normal(size=(60, 3)) * 0.1)
    frames = spark.createDataFrame([(i, r.ravel().tolist()) for i, r in enumerate(start)], "frame long, rotation array<double>")
    got = solver.robust_rotations(frames, spark.createDataFrame(rows, "a long, b long, rotation array<double>"), most=4)
    out = {r["frame"]: np.array(r["rotation"]).reshape(3, 3) for r in got.collect()}
    assert len(out) == 60 and len(passes) < 20
    for first, frames in ((0, range(40)), (40, range(40, 60))):
        assert np.allclose(out[first], start[first], atol=1e-9)
        assert max(np.linalg.norm(solver.turn_of(((out[i] @ out[first].T).T @ (truth[i] @ truth[first].T))[None])) for i in frames) < 1e-3


def test_solve_by_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(solver, "FRAMES_PER_BLOCK", 9, raising=False)
    rng = np.random.default_rng(4)
    names = [f"n{i:03}" for i in range(70)]
    edges = [(i, j, float(rng.random() + 0.1), rng.normal(size=3)) for i in range(70) for j in (i + 1, i + 2) if j < 70 and not i < 30 <= j] + [(3, 4, 0.5, rng.normal(size=3))]
    lap, v = np.zeros((70, 70)), np.zeros((70, 3))
    for a, b, w, t in edges:
        lap[[a, b], [a, b]] += w
        lap[[a, b], [b, a]] -= w
        v[b] += w * t
        v[a] -= w * t
    rows = spark.createDataFrame([(names[a], names[b], w, t.tolist()) for a, b, w, t in edges], "a string, b string, weight double, turn array<double>")
    parts = solver.connected_components(rows)
    cut, widths = solver.dissected(rows, parts)
    got = {r["node"]: r["w"] for r in solver.solve_blocks(cut, widths, parts, f"{tmp_path}/levels").collect()}
    assert len(widths) > 2 and sorted(got) == names
    assert np.allclose(np.array([got[n] for n in names]), np.linalg.pinv(lap) @ v, atol=1e-9)
    everything = spark.createDataFrame([(a, b) for a in range(30) for b in range(a)], "a long, b long")
    assert solver.dissected(everything, solver.connected_components(everything)) is None
