"""Change logs as streams: merged state by micro-batch, coalesced events, and running views.

Defined results: of rows with one key and stamp one stays; null keys are one key; a batch without rows leaves the table as it is; events later than the watermark are dropped from windows, not from the
merged table, which takes them in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes
from ..operators.graph import checkpointed
from .buckets import BucketTable


def read_log(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


class MergedTable:
    """A last-writer-wins table in ``buckets`` by key (``BucketTable``): a micro-batch rewrites the buckets it touches. A batch that is run again gives the same version, for it starts from the version before.
    ``keep`` versions stay readable; row files that only older ones name are removed as a batch ends."""

    def __init__(self, folder: str, keys: list[str], stamp: str, buckets: int = 64, keep: int = 16):
        self.table, self.keys, self.stamp, self.keep = BucketTable(folder, keys, None, buckets), keys, stamp, keep

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns]), self.stamp).alias("__row")).select("__row.*")
        latest = checkpointed(latest)  # what follows reads it more than once, and what it comes from may be state
        touched, before = self.table.touched(latest), self.table.before(spark, batch_id)
        if touched & set(self.table.named(spark, before)):
            latest = changes.upsert(self.table.read(spark, before, touched), latest, self.keys, self.stamp)
        self.table.write(latest, touched, batch_id)
        self.table.clean(spark, batch_id - self.keep)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        return self.table.read(spark, version)


def coalesce_events(stream: DataFrame, keys: list[str], at: str, quiet: str, value: str) -> DataFrame:
    """The last event of each key in each tumbling window of the quiet time."""
    return stream.withWatermark(at, quiet).groupBy(F.window(at, quiet), *keys).agg(F.max_by(value, at).alias(value), F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, value, "n")


def running_counts(stream: DataFrame, keys: list[str], at: str, every: str, late: str) -> DataFrame:
    """Counts and totals of each key by window; what is older than ``late`` leaves the state."""
    return stream.withWatermark(at, late).groupBy(F.window(at, every), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def tail(log: DataFrame, order: str, n: int = 512) -> DataFrame:
    """The last n events, for a reader that comes back."""
    return log.orderBy(F.col(order).desc()).limit(n)
