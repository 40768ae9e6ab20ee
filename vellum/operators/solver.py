"""Reweighted solves over a graph of pairs: rotations of frames from measured rotations between them, some of them wrong.

Each round takes what every pair's measurement says the rotations still lack, weighs pairs by how little that is (Cauchy, at a scale that shrinks to ``sigma``), and solves the weighted Laplacian system.
Where blocks of frames next to each other by key have few frames with pairs to other blocks (``dissected``), it is solved by elimination: a task reduces its block to those frames, exactly, several blocks' frames make a
block of the next level, and the solution goes back down (``solve_blocks``); the number of passes follows from the levels, not from how far apart frames are. Else conjugate gradients solve it (``solve_laplacian``):
vectors are columns of a table of frames, a matrix-vector product is a join of the pairs with it and an aggregation, and only inner products come to the driver. Either way frames and pairs needn't fit there. Rounds
stop when no frame turns by more than ``tolerance`` (radians), gradients when the residual has shrunk to ``precision`` of the right side.

Defined results: pairs with a null, of a frame with itself, or with a frame that isn't there are left out; frames without pairs keep their rotation; each component of frames is turned as a whole so that its least frame keeps the
rotation it began with; repeated pairs weigh as often as they stand; an empty table gives no rows. Rotations are nine numbers, row by row.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .graph import EDGES_PER_TASK, checkpointed, connected_components, remove_folder, shared_folder
from .ordering import positions

_MATRIX = "array<double>"
#: Frames of a block, which a task eliminates as one dense matrix.
FRAMES_PER_BLOCK = 500


def _stack(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), float).reshape(-1, 3, 3)


def rotation_of(turn: np.ndarray) -> np.ndarray:
    """Rotations by axis times angle, (n, 3) to (n, 3, 3)."""
    angle = np.linalg.norm(turn, axis=1)[:, None, None]
    x, y, z = turn.T
    zero = np.zeros_like(x)
    cross = np.stack([zero, -z, y, z, zero, -x, -y, x, zero], axis=1).reshape(-1, 3, 3)
    small = angle < 1e-8
    safe = np.where(small, 1, angle)
    return np.eye(3) + np.where(small, 1, np.sin(safe) / safe) * cross + np.where(small, 0.5, (1 - np.cos(safe)) / safe**2) * (cross @ cross)


def turn_of(rotation: np.ndarray) -> np.ndarray:
    """Axis times angle of rotations, also next to half a turn."""
    m = rotation
    odd = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], axis=1) / 2
    sin, cos = np.linalg.norm(odd, axis=1), (np.trace(m, axis1=1, axis2=2) - 1) / 2
    angle = np.arctan2(sin, cos)
    out = odd * np.where(sin > 1e-8, angle / np.where(sin > 1e-8, sin, 1), 1)[:, None]
    flat = (sin <= 1e-6) & (cos < 0)
    if flat.any():
        even = (m[flat] + np.eye(3)) / 2  # the axis times itself
        at = np.argmax(np.diagonal(even, axis1=1, axis2=2), axis=1)
        axis = even[np.arange(len(at)), at]
        out[flat] = axis / np.linalg.norm(axis, axis=1)[:, None] * np.pi
    return out


def _lacks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs with ``turn``: how b would have to turn, in its own frame, for the pair to be met."""
    for pdf in batches:
        left = np.swapaxes(_stack(pdf["rb"]), 1, 2) @ _stack(pdf["m"]) @ _stack(pdf["ra"])
        yield pdf.drop(columns=["m", "ra", "rb"]).assign(turn=list(turn_of(left)))


def _turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"frame": pdf["frame"], "rotation": list((_stack(pdf["rotation"]) @ rotation_of(np.array(pdf["w"].tolist(), float).reshape(-1, 3))).reshape(-1, 9))})


def _brought_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rotations after a component's turn: what its least frame began with, times what that frame has now, undone."""
    for pdf in batches:
        out = _stack(pdf["rotation"]) @ np.swapaxes(_stack(pdf["now"]), 1, 2) @ _stack(pdf["began"])
        yield pd.DataFrame({"frame": pdf["frame"], "rotation": list(out.reshape(-1, 9))})


def _dot(x: str, y: str):
    return F.sum(F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def _along(x: str, y: str, step: float):
    return F.zip_with(x, y, lambda a, b: a + b * F.lit(step))


def zero_like(column: str):
    return F.transform(column, lambda c: c * 0.0)


def _shuffled(df: DataFrame) -> DataFrame:
    """A table of frames to be joined by a shuffle: a broadcast would pass it through the driver, anew in each step."""
    return df.hint("shuffle_hash")


def _written(df: DataFrame, folder: str) -> DataFrame:
    """The rows, written to the folder and read again so that a step's plan knows nothing of the steps before."""
    place = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def _observed(df: DataFrame, folder: str, **sums) -> tuple[DataFrame, dict]:
    """The same, and sums over the rows from the same pass."""
    seen = Observation()
    return _written(df.observe(seen, *(v.alias(k) for k, v in sums.items())), folder), seen.get


def solve_laplacian(edges: DataFrame, rhs: DataFrame, precision: float = 1e-6, most: int = 200) -> DataFrame:
    """(node, w): least-norm solution of L w = v by conjugate gradients, both inner products of a step from one pass. ``edges``: a, b, weight (over 0). ``rhs``: node, v (arrays of three
    or any other length, each component's summing to nothing)."""
    first = rhs.select("v").first()
    if first is None:
        return rhs.select("node", F.col("v").alias("w"))
    width = len(first["v"])
    folder = f"{shared_folder(rhs.sparkSession)}/solve-{uuid.uuid4().hex}"
    edges, _ = _observed(edges.select("a", "b", "weight"), folder, n=F.count(F.lit(1)))
    now = rhs.select("node", zero_like("v").alias("w"), F.col("v").alias("r"), zero_like("v").alias("p"), zero_like("v").alias("s"))
    start = gamma_before = alpha = None
    for _ in range(most + 1):
        sides = edges.join(_shuffled(now.select(F.col("node").alias("a"), F.col("r").alias("ra"))), "a").join(_shuffled(now.select(F.col("node").alias("b"), F.col("r").alias("rb"))), "b")
        flow = F.zip_with("ra", "rb", lambda x, y: (x - y) * F.col("weight"))
        each = sides.select("a", "b", flow.alias("f")).select(F.explode(F.array(F.struct(F.col("a").alias("node"), "f"), F.struct(F.col("b").alias("node"), F.transform("f", lambda x: -x).alias("f")))).alias("e")).select("e.*")
        product = each.groupBy("node").agg(F.array(*(F.sum(F.col("f")[i]) for i in range(width))).alias("q"))
        now, sums = _observed(now.join(_shuffled(product), "node", "left").withColumn("q", F.coalesce("q", zero_like("r"))), folder, gamma=_dot("r", "r"), delta=_dot("r", "q"))
        gamma, delta = sums["gamma"], sums["delta"]
        start = gamma if start is None else start
        if not gamma or gamma <= precision**2 * start or not delta:
            break
        beta = 0.0 if alpha is None else gamma / gamma_before
        alpha = gamma / delta if alpha is None else gamma / (delta - beta * gamma / alpha)
        gamma_before = gamma
        now = now.select("node", "w", "r", _along("r", "p", beta).alias("p"), _along("q", "s", beta).alias("s"))
        now = now.select("node", _along("w", "p", alpha).alias("w"), _along("r", "s", -alpha).alias("r"), "p", "s")
    out = checkpointed(now.select("node", "w"))
    remove_folder(rhs.sparkSession, folder)
    return out


def _pulls(edges: DataFrame) -> DataFrame:
    """(node, v): what the pairs (a, b, weight, turn) pull their ends by."""
    pull = lambda sign: F.transform("turn", lambda t: t * F.col("weight") * F.lit(sign))
    each = edges.select(F.explode(F.array(F.struct(F.col("b").alias("node"), pull(1.0).alias("t")), F.struct(F.col("a").alias("node"), pull(-1.0).alias("t")))).alias("e")).select("e.*")
    return each.groupBy("node").agg(F.array(*(F.sum(F.col("t")[i]) for i in range(3))).alias("v"))


def dissected(pairs: DataFrame, parts: DataFrame) -> tuple[DataFrame, list[int]] | None:
    """The ``pairs`` (a, b and others) with component, the level at which they are dealt with, the block there, and the levels at which their ends are eliminated; and how many first blocks a block of each level spans.
    ``parts``: node, component. A block is FRAMES_PER_BLOCK nodes in their order; nodes with pairs to other blocks go on to the next level, where a block takes those of as many blocks as it can. None where such
    nodes don't get fewer, or one block would hold more than EDGES_PER_TASK pairs."""
    places = positions(parts, ["node"]).select("node", "component", F.floor(F.col("position") / FRAMES_PER_BLOCK).alias("at"))
    a, b = (_shuffled(places.toDF(*names)) for names in (("a", "component", "a_at"), ("b", "__component", "b_at")))
    edges = checkpointed(pairs.join(a, "a").join(b, "b").drop("__component"))
    block = lambda column, width: F.floor(F.col(column) / width)
    widths = [1]
    while True:
        crossing = edges.filter(block("a_at", widths[-1]) != block("b_at", widths[-1]))
        ends = crossing.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_at").alias("at")), F.struct(F.col("b").alias("node"), F.col("b_at").alias("at")))).alias("e")).select("e.*").distinct()
        left = ends.groupBy(block("at", widths[-1])).count().agg(F.max("count")).first()[0]
        if left is None:
            break
        if FRAMES_PER_BLOCK // left < 2:
            return None
        widths.append(widths[-1] * (FRAMES_PER_BLOCK // left))
    level, at = F.lit(None), F.lit(None)
    for i, width in reversed(list(enumerate(widths))):
        same = block("a_at", width) == block("b_at", width)
        level, at = F.when(same, F.lit(i)).otherwise(level), F.when(same, block("a_at", width)).otherwise(at)
    edges = edges.withColumns({"level": level, "block": at}).drop("a_at", "b_at")
    if (edges.groupBy("level", "block").count().agg(F.max("count")).first()[0] or 0) > EDGES_PER_TASK:
        return None
    tops = edges.select(F.explode(F.array("a", "b")).alias("node"), "level").groupBy("node").agg(F.max("level").alias("top"))
    tops = [_shuffled(tops.toDF(end, f"{end}_top")) for end in "ab"]
    return checkpointed(edges.join(tops[0], "a").join(tops[1], "b")), widths


def _eliminated(level: int, wider: int):
    """Function of the reduced systems within a block (one row each) and of its own pairs: one row with the system of the nodes that go on, and how the others follow from these."""

    def run(key, below: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        names = pd.concat([pd.Series(list(r.stay), dtype=object) for r in below.itertuples()] + [edges["a"].astype(object), edges["b"].astype(object)], ignore_index=True)
        tops = np.concatenate([*(np.asarray(t, int) for t in below["tops"]), edges["a_top"], edges["b_top"]]).astype(int)
        parts = pd.concat([pd.Series(list(r.parts), dtype=object) for r in below.itertuples()] + [edges["component"].astype(object)] * 2, ignore_index=True)
        place, nodes = pd.factorize(names, sort=True)
        first = np.unique(place, return_index=True)[1]
        top, part = tops[first], pd.factorize(parts)[0][first]
        n = len(nodes)
        matrix, v = np.zeros((n, n)), np.zeros((n, 3))
        at = 0
        for r in below.itertuples():
            own = place[at : at + len(r.stay)]
            at += len(own)
            matrix[np.ix_(own, own)] += np.frombuffer(r.matrix).reshape(len(own), -1)
            v[own] += np.frombuffer(r.v).reshape(-1, 3)
        if len(edges):
            a, b, w = place[at : at + len(edges)], place[at + len(edges) :], edges["weight"].to_numpy(float)
            for i, j, x in ((a, a, w), (b, b, w), (a, b, -w), (b, a, -w)):
                np.add.at(matrix, (i, j), x)
            pull = np.array(edges["turn"].tolist(), float) * w[:, None]
            np.add.at(v, b, pull)
            np.add.at(v, a, -pull)
        stay = top > level
        # a component that ends here is known but for one node, which is taken as unmoved
        ends = ~np.isin(part, part[stay])
        held = np.zeros(n, bool)
        held[np.flatnonzero(ends)[np.unique(part[ends], return_index=True)[1]]] = True
        out = ~stay & ~held
        known = np.linalg.solve(matrix[np.ix_(out, out)], np.hstack([v[out], matrix[np.ix_(out, stay)]]))
        own, by = np.zeros((n, 3)), np.zeros((n, int(stay.sum())))
        own[out], by[out] = known[:, :3], known[:, 3:]
        back = matrix[np.ix_(stay, out)]
        system = matrix[np.ix_(stay, stay)] - back @ known[:, 3:]
        row = {"block": key[0] // wider, "inner": key[0], "stay": nodes[stay].tolist(), "tops": top[stay].tolist(), "parts": pd.Series(parts)[first].to_numpy()[stay].tolist()}
        row |= {"matrix": ((system + system.T) / 2).tobytes(), "v": (v[stay] - back @ known[:, :3]).tobytes(), "gone": nodes[~stay].tolist(), "own": own[~stay].tobytes(), "by": by[~stay].tobytes()}
        return pd.DataFrame([row])

    return run


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, w) of the nodes that a block eliminated, from those that went on."""
    for pdf in batches:
        for r in pdf.itertuples():
            w, n = np.frombuffer(r.own).reshape(-1, 3), len(r.gone)
            if r.went is not None and len(r.went):
                went = np.array([list(x["w"]) for x in sorted(r.went, key=lambda x: x["at"])], float)
                w = w - np.frombuffer(r.by).reshape(n, -1) @ went
            yield pd.DataFrame({"node": list(r.gone), "w": list(w)})


def solve_blocks(edges: DataFrame, widths: list[int], parts: DataFrame, folder: str) -> DataFrame:
    """(node, w): least-norm solution of L w = v where each pair pulls b by its weight times ``turn``, and a the other way. ``edges``: those of ``dissected`` with weight (over 0) and turn; ``parts``: node, component.
    What the levels give is written to the ``folder``."""
    kind = dict(parts.dtypes)["node"]
    schema = f"block long, inner long, stay array<{kind}>, tops array<int>, parts array<{kind}>, matrix binary, v binary, gone array<{kind}>, own binary, by binary"
    below, levels = edges.sparkSession.createDataFrame([], schema), []
    for level, width in enumerate(widths):
        wider = widths[level + 1] // width if level + 1 < len(widths) else 1
        mine = edges.filter(F.col("level") == level).select("block", "a", "b", "a_top", "b_top", "component", "weight", "turn")
        below = _written(below.groupBy("block").cogroup(mine.groupBy("block")).applyInPandas(_eliminated(level, wider), schema), folder)
        levels.append(below)
    solved = None
    for rows in reversed(levels):
        rows = rows.select("inner", "stay", "gone", "own", "by")
        if solved is None:
            rows = rows.withColumn("went", F.lit(None).cast("array<struct<at:int,w:array<double>>>"))
        else:
            went = rows.select("inner", F.posexplode("stay").alias("at", "node")).join(_shuffled(solved), "node").groupBy("inner").agg(F.collect_list(F.struct("at", "w")).alias("went"))
            rows = rows.join(_shuffled(went), "inner", "left")
        found = rows.select("gone", "own", "by", "went").mapInPandas(_followed, f"node {kind}, w array<double>")
        solved = found if solved is None else solved.unionByName(found)
    solved = _written(solved.join(_shuffled(parts), "node"), folder)
    middle = solved.groupBy("component").agg(F.array(*(F.avg(F.col("w")[i]) for i in range(3))).alias("mean"))
    return solved.join(_shuffled(middle), "component").select("node", F.zip_with("w", "mean", lambda x, y: x - y).alias("w"))


def robust_rotations(frames: DataFrame, pairs: DataFrame, sigma: float = 0.02, tolerance: float = 1e-4, most: int = 12, precision: float = 1e-2) -> DataFrame:
    """(frame, rotation). ``frames``: frame, rotation to begin with. ``pairs``: a, b, rotation, which takes a's rotation to b's (R_b = M R_a)."""
    frames = checkpointed(frames.select("frame", "rotation"))
    known = frames.select("frame")
    pairs = pairs.filter("a <> b AND rotation IS NOT NULL").select("a", "b", F.col("rotation").alias("m"))
    pairs = checkpointed(pairs.join(known.withColumnRenamed("frame", "a"), "a", "left_semi").join(known.withColumnRenamed("frame", "b"), "b", "left_semi").select("a", "b", "m"))
    kind, now, scale = dict(frames.dtypes)["frame"], frames, 0.5
    parts = checkpointed(connected_components(pairs.select("a", "b")))
    cut = dissected(pairs, parts)
    pairs = cut[0] if cut else pairs
    lacking = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c != "m") + ", turn array<double>"
    folder = f"{shared_folder(frames.sparkSession)}/rotations-{uuid.uuid4().hex}"
    for _ in range(most):
        both = pairs.join(_shuffled(now.select(F.col("frame").alias("a"), F.col("rotation").alias("ra"))), "a").join(_shuffled(now.select(F.col("frame").alias("b"), F.col("rotation").alias("rb"))), "b")
        lacks = both.mapInPandas(_lacks, lacking)
        far = F.aggregate("turn", F.lit(0.0), lambda s, v: s + v * v)
        weighed = _written(lacks.withColumn("weight", 1 / (1 + far / F.lit(scale**2))), folder)
        w = _written(solve_blocks(weighed, cut[1], parts, folder), folder) if cut else solve_laplacian(weighed, _pulls(weighed), precision)
        largest = w.agg(F.max(F.aggregate("w", F.lit(0.0), lambda s, v: s + v * v))).first()[0]
        step = now.join(_shuffled(w.withColumnRenamed("node", "frame")), "frame", "left").withColumn("w", F.coalesce("w", F.array(*[F.lit(0.0)] * 3)))
        now = _written(step.mapInPandas(_turned, f"frame {kind}, rotation {_MATRIX}"), folder)
        if largest is None or (math.sqrt(largest) <= tolerance and scale <= sigma):
            break
        scale = max(sigma, scale / 2)
    parts = parts.select(F.col("node").alias("frame"), "component")
    anchors = now.withColumnRenamed("rotation", "now").join(frames.withColumnRenamed("rotation", "began"), "frame").withColumnRenamed("frame", "component")
    placed = now.join(parts, "frame").join(anchors, "component").mapInPandas(_brought_back, f"frame {kind}, rotation {_MATRIX}")
    out = checkpointed(placed.unionByName(frames.join(parts, "frame", "left_anti")))
    remove_folder(frames.sparkSession, folder)
    return out
