"""Tables kept as Parquet in buckets by key, of which a batch rewrites those it touches.

A version is a short list of which version each bucket's rows were last written by. It is written after the rows, so a batch that dies leaves the version before as it was, and one that is run again writes
the same version anew from the version before. ``clean`` removes row files that no version from a given one on names.

Defined results: a version that was never written is empty; null keys have one bucket; buckets whose last row goes are no longer named; an empty batch gives a version equal to the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import remove_folder


class BucketTable:
    def __init__(self, folder: str, keys: list[str], schema: str | None = None, buckets: int = 64):
        self.folder, self.keys, self.schema, self.buckets = folder.rstrip("/"), keys, schema, buckets

    def place(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _children(self, spark: SparkSession, folder: str) -> list[str]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{folder}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def written(self, spark: SparkSession) -> list[int]:
        return sorted(int(n[2:]) for n in self._children(spark, "versions") if n.startswith("v="))

    def before(self, spark: SparkSession, version: int) -> int:
        """The last version below one, -1 if there is none."""
        return max((v for v in self.written(spark) if v < version), default=-1)

    def named(self, spark: SparkSession, version: int) -> dict[int, int]:
        if version not in self.written(spark):
            return {}
        return {r["bucket"]: r["at"] for r in spark.read.parquet(f"{self.folder}/versions/v={version}").collect()}

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets of the rows' keys; at most ``buckets`` numbers."""
        return {r["bucket"] for r in rows.select(self.place().alias("bucket")).distinct().collect()}

    def read(self, spark: SparkSession, version: int, only: set[int] | None = None) -> DataFrame:
        files = [f"{self.folder}/rows/v={at}/bucket={b}" for b, at in sorted(self.named(spark, version).items()) if only is None or b in only]
        if files:
            return spark.read.parquet(*files)
        if self.schema is None:
            raise FileNotFoundError(f"no rows in version {version} of {self.folder}")
        return spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, touched: set[int], version: int) -> None:
        """Makes a version: ``rows`` are all rows of the touched buckets, the other buckets stay."""
        spark = rows.sparkSession
        now = {b: at for b, at in self.named(spark, self.before(spark, version)).items() if b not in touched}
        if touched:
            rows.withColumn("bucket", self.place()).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/v={version}")
            now |= {int(n[7:]): version for n in self._children(spark, f"rows/v={version}") if n.startswith("bucket=")}
        spark.createDataFrame(sorted(now.items()), "bucket int, at long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/v={version}")

    def clean(self, spark: SparkSession, oldest: int) -> int:
        """Removes what only versions before ``oldest`` name; gives how many bucket folders went."""
        kept = {(at, b) for v in self.written(spark) if v >= oldest for b, at in self.named(spark, v).items()}
        gone = 0
        for name in self._children(spark, "rows"):
            at = int(name[2:])
            buckets = [int(b[7:]) for b in self._children(spark, f"rows/{name}") if b.startswith("bucket=")]
            for b in buckets:
                if at < oldest and (at, b) not in kept:
                    remove_folder(spark, f"{self.folder}/rows/{name}/bucket={b}")
                    gone += 1
            if at < oldest and not any((at, b) in kept for b in buckets):
                remove_folder(spark, f"{self.folder}/rows/{name}")
        for v in self.written(spark):
            if v < oldest:
                remove_folder(spark, f"{self.folder}/versions/v={v}")
        return gone
