"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names and all executors share. Where none is set, one of this machine is taken in local mode, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder below the shared one, by Spark's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Edges that a task of a round reads and writes, and up to which one task ends the rounds.
EDGES_PER_TASK = 200_000


def _joined(batches):
    """(u, v) of all edges of a task: each vertex that isn't its component's smallest, with that one. About EDGES_PER_TASK edges."""
    import pandas as pd

    parent: dict = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["u"], pdf["v"]):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in list(parent)]
    yield pd.DataFrame([f for f in found if f[0] != f[1]], columns=["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """From edges (a, b) of any orderable type: one row a vertex, ``node`` and ``component``, its smallest reachable vertex.

    Each round hangs every vertex's larger neighbours (large star), then its smaller ones (small star), on the smallest it
    knows; the rounds end when all edges are stars, after about log(n) of them, or when so few are left that one task can join them, with the same result. Before the first, tasks join the edges of
    their own range, so that links between near vertices cost no rounds. Neighbour minima are
    aggregated map-side; no group is collected, and a vertex with very many neighbours is a large key of joins alone, which Spark may split. A round never has more edges than the
    one before and one a vertex, so its tasks follow from the edges left.
    Null ends and self-loops connect nothing, but a self-loop names its vertex.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    vertices = pairs.select(F.explode(F.array("u", "v")).alias("u")).distinct()
    now = checkpointed(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    end = lambda x, up, below: F.struct(F.col(x).alias("x"), F.lit(up).alias("up"), F.lit(below).alias("below"))
    near = False
    while True:
        ends = now.select(F.explode(F.array(end("u", 1, 0), end("v", 0, 1))).alias("e")).groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.below").alias("below"))
        edges_left, loose = ends.agg(F.sum("up"), F.count_if(F.expr("up > 1 OR up > 0 AND below > 0"))).first()
        if not loose:
            break
        tasks = max(1, -(-edges_left // EDGES_PER_TASK))
        if tasks == 1:
            now = checkpointed(now.coalesce(1).mapInPandas(_joined, now.schema))
            break
        if not near:
            now, near = checkpointed(now.repartitionByRange(tasks, "v", "u").mapInPandas(_joined, now.schema)), True
            continue
        both = now.coalesce(tasks).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = checkpointed(small.filter("u <> v").coalesce(tasks).distinct().coalesce(tasks))
    return vertices.join(now.groupBy("u").agg(F.min("v").alias("m")), "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))


def reachable(edges: DataFrame, seeds: DataFrame, a: str = "a", b: str = "b", node: str = "node", most_rounds: int = 1000) -> DataFrame:
    """Nodes that directed edges lead to from the seeds, the seeds too: a frontier is joined and what is known already left out, so cycles end."""
    steps = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct()
    known = frontier = checkpointed(seeds.select(F.col(node).alias("u")).filter("u IS NOT NULL").distinct())
    for _ in range(most_rounds):
        frontier = checkpointed(frontier.join(steps, "u").select(F.col("v").alias("u")).distinct().join(known, "u", "left_anti"))
        if not frontier.limit(1).count():
            return known.select(F.col("u").alias(node))
        known = checkpointed(known.unionByName(frontier))
    raise ValueError(f"not done after {most_rounds} rounds")
