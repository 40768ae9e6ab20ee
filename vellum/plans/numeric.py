"""Staged pairing, tiles, calibration and reweighted solves over the sample tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import knots, pairing, similarity, solver, tiles
from .registry import query

LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"
GONE = f"(SELECT l_orderkey * 10 + l_linenumber AS row_id, 'old/' || l_suppkey || '/' || l_orderkey || '-' || l_linenumber AS path, CASE WHEN l_partkey % 9 > 0 THEN 'h' || l_partkey END AS content, CASE WHEN l_suppkey % 3 = 0 THEN 'bin' ELSE 'live' END AS channel, l_returnflag = 'R' AS member FROM {LINES} WHERE l_linenumber <= 2)"
NEW = f"(SELECT 'new/' || l_orderkey || '-' || l_linenumber AS path, 'h' || l_partkey AS content, CASE WHEN l_suppkey % 2 = 0 THEN 'bin' ELSE 'live' END AS channel FROM {LINES} WHERE l_linenumber = 3)"
CHANGED = f"(SELECT 'h' || l_partkey AS content, CASE WHEN l_suppkey % 2 = 0 THEN 'bin' ELSE 'live' END AS channel FROM {LINES} WHERE l_linenumber = 5)"


@query(f"""
WITH h AS (SELECT content, channel, count(*) AS held FROM {CHANGED} GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY content, channel ORDER BY NOT member, path, row_id) AS k FROM {GONE} WHERE content IS NOT NULL),
n AS (SELECT * REPLACE (k - held AS k) FROM (SELECT x.*, coalesce(h.held, 0) AS held, row_number() OVER (PARTITION BY x.content, x.channel ORDER BY path) AS k FROM {NEW} x LEFT JOIN h ON h.content = x.content AND h.channel = x.channel) WHERE k > held),
a AS (SELECT row_id, g.path AS old_path, n.path AS new_path, g.content, CASE g.channel WHEN 'bin' THEN 'within' ELSE 'move' END AS kind FROM g JOIN n ON g.content = n.content AND g.channel = n.channel AND g.k = n.k),
g2 AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY NOT member, path, row_id) AS j FROM g WHERE row_id NOT IN (SELECT row_id FROM a)),
n2 AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY path) AS j FROM n WHERE path NOT IN (SELECT new_path FROM a))
SELECT * FROM a UNION ALL SELECT row_id, g2.path, n2.path, g2.content, CASE g2.channel WHEN 'bin' THEN 'out' ELSE 'in' END FROM g2 JOIN n2 ON g2.content = n2.content AND g2.j = n2.j""")
def staged_pairs(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.max("l_returnflag").alias("l_returnflag"))
    name = lambda top, *c: F.concat(F.lit(top), F.concat_ws("-", *(F.col(x).cast("string") for x in c)))
    channel = lambda n: F.when(F.col("l_suppkey") % n == 0, "bin").otherwise("live").alias("channel")
    content = F.concat(F.lit("h"), F.col("l_partkey").cast("string"))
    old = F.concat(F.lit("old/"), F.col("l_suppkey").cast("string"), F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    gone = lines.filter("l_linenumber <= 2").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), old.alias("path"), F.when(F.col("l_partkey") % 9 > 0, content).alias("content"), channel(3), (F.col("l_returnflag") == "R").alias("member"))
    new = lines.filter("l_linenumber = 3").select(name("new/", "l_orderkey", "l_linenumber").alias("path"), content.alias("content"), channel(2))
    changed = lines.filter("l_linenumber = 5").select(content.alias("old_content"), channel(2))
    return pairing.staged_pairs(gone, new, changed)


PIXELS = "(SELECT l_returnflag AS picture, (l_orderkey % 150)::INT AS y, (l_partkey % 90)::INT AS x, max(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def pixels(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("picture"), (F.col("l_orderkey") % 150).cast("int").alias("y"), (F.col("l_partkey") % 90).cast("int").alias("x")).agg(F.max("l_quantity").alias("value"))


def neighbours(what):
    return f"WITH p AS {PIXELS} SELECT a.picture, a.y::BIGINT AS y, a.x::BIGINT AS x, {what} AS value FROM p a, (SELECT dy, dx FROM range(-1, 2) i(dy), range(-1, 2) j(dx)) d JOIN p b ON b.picture = a.picture AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL"


@query(neighbours("median(b.value)"))
def tile_medians(t):
    """The median of each pixel's neighbourhood, tile by tile."""
    return tiles.to_pixels(tiles.stencil(tiles.to_tiles(pixels(t), 32), tiles.median, 32, 1), 32)


@query(neighbours("max(b.value) - min(b.value)"))
def tile_ranges(t):
    return tiles.to_pixels(tiles.stencil(tiles.to_tiles(pixels(t), 16), tiles.range_of, 16, 1), 16)


@query("""
WITH k AS (SELECT c_nationkey AS lens, c_acctbal AS place, min(c_custkey)::DOUBLE AS gain FROM customer WHERE c_nationkey <> 9 GROUP BY ALL),
v AS (SELECT o_orderkey, (o_custkey % 25)::INT AS lens, CASE WHEN o_orderkey % 13 > 0 THEN o_totalprice / 20 - 1500 END AS place FROM orders),
a AS (SELECT v.*, k.place AS p0, k.gain AS g0 FROM v ASOF LEFT JOIN k ON v.lens = k.lens AND v.place >= k.place),
b AS (SELECT a.*, k.place AS p1, k.gain AS g1 FROM a ASOF LEFT JOIN k ON a.lens = k.lens AND a.place <= k.place)
SELECT o_orderkey, round(CASE WHEN place IS NULL THEN NULL WHEN p0 = place OR p1 IS NULL THEN g0 WHEN p0 IS NULL THEN g1 ELSE g0 + (g1 - g0) * ((place - p0) / (p1 - p0)) END, 4) AS gain FROM b""")
def interpolated_gains(t):
    """A value of calibration at each order's place in its lens's table."""
    table = t.customer.filter("c_nationkey <> 9").select(F.col("c_nationkey").alias("lens"), F.col("c_acctbal").alias("place"), F.col("c_custkey").alias("gain"))
    values = t.orders.select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("lens"), F.when(F.col("o_orderkey") % 13 > 0, F.col("o_totalprice") / 20 - 1500).alias("place"))
    return knots.interpolated(values, table, "lens", "place", "gain", "gain").select("o_orderkey", F.round("gain", 4).alias("gain"))


def planted_turn(key: np.ndarray, salt: float, size: float) -> np.ndarray:
    """A turn that follows from a key alone."""
    return size * np.sin(np.outer(np.asarray(key, float) + 1, [1.3, 2.1, 0.7]) * salt)


def _frames(batches):
    for pdf in batches:
        real = solver.rotation_of(planted_turn(pdf["frame"], 1.0, 1.0))
        yield pd.DataFrame({"frame": pdf["frame"], "rotation": list((real @ solver.rotation_of(planted_turn(pdf["frame"], 5.0, 0.15))).reshape(-1, 9))})


def _pairs(batches):
    for pdf in batches:
        a, b = (solver.rotation_of(planted_turn(pdf[c], 1.0, 1.0)) for c in "ab")
        off = np.where((pdf["n"] % 7 == 0).to_numpy()[:, None], planted_turn(pdf["n"], 3.0, 1.5), planted_turn(pdf["n"], 11.0, 0.001))
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "rotation": list((solver.rotation_of(off) @ b @ np.swapaxes(a, 1, 2)).reshape(-1, 9))})


def _apart(batches):
    for pdf in batches:
        real, start = (solver.rotation_of(planted_turn(pdf["frame"], 1.0, 1.0)) for _ in range(2))
        real0, now0 = (np.array(pdf[c].tolist(), float).reshape(-1, 3, 3) for c in ("real0", "now0"))
        now = np.array(pdf["rotation"].tolist(), float).reshape(-1, 3, 3)
        left = np.swapaxes(now @ np.swapaxes(now0, 1, 2), 1, 2) @ (start @ np.swapaxes(real0, 1, 2))
        yield pd.DataFrame({"frame": pdf["frame"], "close": np.linalg.norm(solver.turn_of(left), axis=1) < 0.03})


@query("SELECT s_suppkey AS frame, TRUE AS close FROM supplier")
def solved_rotations(t):
    """Suppliers are frames, those next to each other by key are pairs, every seventh pair is measured wrong: are the planted rotations found again?"""
    key = t.supplier.select(F.col("s_suppkey").alias("frame"))
    frames = key.mapInPandas(_frames, "frame long, rotation array<double>")
    steps = F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 8, 13))))
    pairs = key.select(F.col("frame").alias("a"), steps.alias("d")).withColumn("b", F.col("a") + F.col("d")).join(key.withColumnRenamed("frame", "b"), "b", "left_semi").withColumn("n", F.col("a") * 6 + F.col("d"))
    solved = solver.robust_rotations(frames, pairs.select("a", "b", "n").mapInPandas(_pairs, "a long, b long, rotation array<double>"), most=7)
    least = solved.agg(F.min("frame").alias("frame0"), F.min_by("rotation", "frame").alias("now0"))  # one row
    real0 = key.agg(F.min("frame").alias("frame")).mapInPandas(_real, "real0 array<double>")
    return solved.join(F.broadcast(least.join(real0))).mapInPandas(_apart, "frame long, close boolean")


def _real(batches):
    for pdf in batches:
        yield pd.DataFrame({"real0": list(solver.rotation_of(planted_turn(pdf["frame"], 1.0, 1.0)).reshape(-1, 9))})


@query("""
WITH p AS (SELECT vec_id // 40 AS picture, vec_id AS point, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT a.picture AS a, b.picture AS b, a.point AS f, b.point AS t, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS alike FROM p a JOIN p b ON b.picture = a.picture + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY alike DESC, t) AS place, lead(alike) OVER (PARTITION BY f ORDER BY alike DESC, t) AS second FROM d)
SELECT a, b, f AS from_point, t AS to_point, round((1 - alike) / (1 - second), 6) AS over FROM r WHERE place = 1 AND second IS NOT NULL AND alike > 0 AND (1 - alike) / (1 - second) <= 0.9""")
def paired_points(t):
    """Blocks of forty vectors are pictures, each is held against the next."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    points = t.embeddings.select(F.floor(F.col("vec_id") / 40).alias("picture"), F.col("vec_id").alias("point"), v.alias("v")).withColumn("v", F.transform("v", lambda x: x / size))
    pairs = points.select(F.col("picture").alias("a")).distinct().withColumn("b", F.col("a") + 1)
    return similarity.paired_points(points, pairs, 0.9).withColumn("over", F.round("over", 6))


@query("SELECT l_suppkey AS p, 1 + l_suppkey % 5 / 10 AS m0, l_suppkey % 3 / 10 AS m1, l_suppkey % 11 * 1.0 AS m2, -(l_suppkey % 4) / 10 AS m3, 2 - l_suppkey % 7 / 10 AS m4, -(l_suppkey % 13) * 1.0 AS m5 FROM lineitem GROUP BY 1")
def consensus_maps(t):
    """Each supplier's lines are points under a map of its own, every fifth of them thrown off."""
    key = F.col("l_suppkey")
    m = [1 + key % 5 / 10, key % 3 / 10, key % 11, -(key % 4) / 10, 2 - key % 7 / 10, -(key % 13)]
    lines = t.lineitem.withColumns({"ax": F.col("l_quantity"), "ay": F.col("l_extendedprice") / 1000})
    off = F.when(F.col("l_orderkey") % 5 == 0, 40 + F.col("l_partkey") % 200).otherwise(0)
    moved = lines.select(key.alias("p"), "ax", "ay", (m[0] * F.col("ax") + m[1] * F.col("ay") + m[2] + off).alias("bx"), (m[3] * F.col("ax") + m[4] * F.col("ay") + m[5] - off).alias("by_"))
    found = similarity.consensus(moved, ["p"], 0.01)
    return found.select("p", *(F.round(f"m{i}", 6).alias(f"m{i}") for i in range(6)))
