"""Sources and sinks: folder listings, keyset change feeds, and rotated snapshots.

Defined results: an empty folder gives no files; files without an extension have no format; null identities are one identity; a feed page after the last row is empty; ties of a feed's order stand in no fixed
order, so its order ends with a unique column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths


def scan_tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, size, modified, format) of all files below a folder; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.withColumn("format", paths.format_class(F.col("path")))


def first_per_identity(files: DataFrame, identity: list[str], known: str, path: str) -> DataFrame:
    """One path a file: where links give several, a known path first, then the least."""
    w = Window.partitionBy(*identity).orderBy(F.col(known).desc(), path)
    return files.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content), 256))


def feed_page(log: DataFrame, order: list[str], after: tuple | None, limit: int = 500) -> DataFrame:
    """The next page of a change feed, by keyset: a filter and a top-n, no offset."""
    from ..operators.filters import after as beyond

    rows = log if after is None else log.filter(beyond([F.col(c) for c in order], after))
    return rows.orderBy(*order).limit(limit)


def write_snapshot(tables: dict[str, DataFrame], folder: str, name: str) -> None:
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/{table}")


def read_snapshot(spark: SparkSession, folder: str, name: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}/{table}")


def snapshots_to_drop(snapshots: DataFrame, kind: str, made: str, keep: int) -> DataFrame:
    """All but the newest ``keep`` of each kind."""
    w = Window.partitionBy(kind).orderBy(F.col(made).desc())
    return snapshots.withColumn("__place", F.row_number().over(w)).filter(F.col("__place") > keep).drop("__place")
