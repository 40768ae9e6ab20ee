"""Groups of linked rows, kept between batches: labels by node and links by component, both in buckets.

A batch of new and removed links reads the label buckets of their ends, then the link buckets of the components these are in, and works components out again for those links alone; other components can't have
changed. Rewritten are the label buckets with a label that changed and the link buckets of components that lost or gained links.

Defined results: links have no direction; a link that is added and removed in one batch is removed; links to nothing and to itself are left out; removing a link that isn't there changes nothing; a node without links is in no
group; a component's name is its least node; an empty batch gives a version equal to the one before. What a batch touches is the work of a batch: one component with a third of all links is worked out again, on many tasks, if a link in it changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpointed, connected_components
from .buckets import BucketTable


class LinkGroups:
    def __init__(self, folder: str, kind: str = "string", buckets: int = 64):
        self.labels = BucketTable(f"{folder}/labels", ["node"], f"node {kind}, component {kind}", buckets)
        self.links = BucketTable(f"{folder}/links", ["component"], f"component {kind}, a {kind}, b {kind}", buckets)

    def apply(self, batch: DataFrame, version: int) -> DataFrame:
        """``batch``: a, b, removed. Writes the version and gives (node, was, component) of the nodes whose group changed, null where there is none."""
        spark, before = batch.sparkSession, self.labels.before(batch.sparkSession, version)
        pairs = batch.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.coalesce("removed", F.lit(False)).alias("removed"))
        pairs = checkpointed(pairs.groupBy("a", "b").agg(F.max("removed").alias("removed")))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        near = self.labels.read(spark, before, self.labels.touched(ends))
        old = checkpointed(near.join(ends, "node", "left_semi").select("component").distinct())
        held = self.links.read(spark, before, self.links.touched(old))
        mine = checkpointed(held.join(old, "component", "left_semi"))
        new = checkpointed(mine.select("a", "b", F.lit(False).alias("removed")).union(pairs).groupBy("a", "b").agg(F.max("removed").alias("removed")).filter("NOT removed").select("a", "b"))
        found = checkpointed(connected_components(new).select("node", "component"))
        # labels
        touched_nodes = mine.select(F.explode(F.array("a", "b")).alias("node"), F.col("component").alias("was")).distinct()
        moved = checkpointed(touched_nodes.join(found, "node", "full").filter("NOT (was <=> component)"))
        label_buckets = self.labels.touched(moved)
        rest = self.labels.read(spark, before, label_buckets).join(moved, "node", "left_anti")
        self.labels.write(rest.unionByName(moved.filter("component IS NOT NULL").select("node", "component")), label_buckets, version)
        # links: of components that are not as they were
        named = checkpointed(new.join(found.withColumnRenamed("node", "a"), "a").select("component", "a", "b"))
        both = named.withColumn("n", F.lit(1)).union(mine.select("component", "a", "b", F.lit(-1)))  # links are different in either
        change = checkpointed(both.groupBy("component", "a", "b").agg(F.sum("n").alias("n")).filter("n <> 0").select("component").distinct())
        link_buckets = self.links.touched(change)
        rest = self.links.read(spark, before, link_buckets).join(change, "component", "left_anti")
        self.links.write(rest.unionByName(named.join(change, "component", "left_semi")), link_buckets, version)
        return moved

    def groups(self, spark: SparkSession, version: int) -> DataFrame:
        return self.labels.read(spark, version)

    def clean(self, spark: SparkSession, oldest: int) -> int:
        return self.labels.clean(spark, oldest) + self.links.clean(spark, oldest)
