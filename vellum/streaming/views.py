"""A join kept up by deltas: counting view maintenance.

Both sides and the view are multisets (rows with a count ``n``), in buckets by the join's columns, so a batch reads and rewrites the buckets of its own keys. The view's change is the left side's change with the right side
as it was, and the left side as it is with the right side's change, counts multiplied; a row of the view goes when its count comes to nothing.

Defined results: null keys meet nothing but are kept; rows taken away that aren't there are an error, for counts would no longer tell the truth; an empty batch gives a version equal to the one before; repeated rows add their
counts; columns other than those named are ignored. A key with a third of all rows is one bucket of files, whose join Spark splits; its part of the view is as large as the question makes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpointed
from .buckets import BucketTable


class JoinView:
    """``left`` and ``right``: DDL of the columns beside the join's. ``where``: SQL that a joined row has to meet, over all columns."""

    def __init__(self, folder: str, on: str, left: str, right: str, where: str | None = None, buckets: int = 64):
        names = lambda ddl: [c.split()[0] for c in ddl.split(", ")]
        self.on, self.of, self.where = names(on), (names(left), names(right)), where
        self.sides = tuple(BucketTable(f"{folder}/{name}", self.on, f"{on}, {ddl}, n long", buckets) for name, ddl in (("left", left), ("right", right)))
        self.view = BucketTable(f"{folder}/view", self.on, f"{on}, {left}, {right}, n long", buckets)

    def _summed(self, rows: DataFrame, more: DataFrame, columns: list[str]) -> DataFrame:
        total = rows.select(*columns, "n").unionByName(more.select(*columns, "n")).groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0")
        return total.withColumn("n", F.when(F.col("n") < 0, F.raise_error(F.lit("a row was taken away that isn't there"))).otherwise(F.col("n")))

    def _joined(self, left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.withColumnRenamed("n", "__l").join(right.withColumnRenamed("n", "__r"), self.on)
        both = both.filter(self.where) if self.where else both
        return both.select(*self.on, *self.of[0], *self.of[1], (F.col("__l") * F.col("__r")).alias("n"))

    def apply(self, left: DataFrame | None, right: DataFrame | None, version: int) -> DataFrame:
        """Signed changes (columns and ``n``, negative for rows that go) of both sides; writes the version and gives the view's change."""
        spark = (left if left is not None else right).sparkSession
        before, deltas = self.view.before(spark, version), []
        for side, own, given in zip(self.sides, self.of, (left, right)):
            rows = given if given is not None else spark.createDataFrame([], side.schema)
            deltas.append(checkpointed(rows.groupBy(*self.on, *own).agg(F.sum("n").alias("n")).filter("n <> 0")))
        touched = self.view.touched(deltas[0].select(*self.on).union(deltas[1].select(*self.on)))
        old = [side.read(spark, before, touched) for side in self.sides]
        new = [checkpointed(self._summed(o, d, [*self.on, *own])) for o, d, own in zip(old, deltas, self.of)]
        columns = [*self.on, *self.of[0], *self.of[1]]
        change = self._joined(deltas[0], old[1]).unionByName(self._joined(new[0], deltas[1]))
        change = checkpointed(change.groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0"))
        for side, rows in zip(self.sides, new):
            side.write(rows, touched, version)
        self.view.write(self._summed(self.view.read(spark, before, touched), change, columns), touched, version)
        return change

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        return self.view.read(spark, version)

    def clean(self, spark: SparkSession, oldest: int) -> int:
        return sum(table.clean(spark, oldest) for table in (*self.sides, self.view))
