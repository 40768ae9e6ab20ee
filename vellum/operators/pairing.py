"""Staged pairing of files that are gone with files that are new, by content and channel (live or bin).

First, for each changed file one new file of its old content on its channel is withheld: that is where its original went. Then, on each channel, gone and new files of one content are paired in order, members of albums
first, so that what is left over is no member. What is left is ranked anew and paired across channels.

Ranks come from places over all rows (``ordering.positions``) less a content's first place, so one content with a third of all rows is not one task's window.

Defined results: order is by path, then row id; null contents and null channels pair with nothing; a null ``member`` is false; of rows with one path each stands for itself, in no fixed order; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed
from .ordering import positions


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Each row's place from 0 among those that are equal in ``by``."""
    placed = positions(rows.withColumn("__tie", F.monotonically_increasing_id()), [*by, *order, "__tie"], "__place")
    first = placed.groupBy(*by).agg(F.min("__place").alias("__first"))
    return placed.join(first, by).withColumn(name, F.col("__place") - F.col("__first")).drop("__tie", "__place", "__first")


def staged_pairs(gone: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """(row_id, old_path, new_path, content, kind): ``move`` inside live folders, ``within`` the bin, ``in`` to it, ``out`` of it.

    ``gone``: row_id, path, content, channel, member. ``new``: path, content, channel. ``changed``: old_content, channel."""
    here = ["content", "channel"]
    gone = gone.dropna(subset=here).select("row_id", F.col("path").alias("old_path"), *here, (~F.coalesce("member", F.lit(False))).alias("__late"))
    new = new.dropna(subset=here).select(F.col("path").alias("new_path"), *here)
    held = changed.groupBy(F.col("old_content").alias("content"), "channel").agg(F.count("*").alias("__held"))
    free = ranked(new, here, ["new_path"], "__k").join(held, here, "left").withColumn("__k", F.col("__k") - F.coalesce("__held", F.lit(0))).filter("__k >= 0").drop("__held")
    gone, free = checkpointed(ranked(gone, here, ["__late", "old_path", "row_id"], "__k")), checkpointed(free)
    keys = [*here, "__k"]
    stay = gone.join(free, keys).select("row_id", "old_path", "new_path", "content", F.when(F.col("channel") == "bin", "within").otherwise("move").alias("kind"))
    gone_left = ranked(gone.join(free.select(*keys), keys, "left_anti").drop("__k"), ["content"], ["__late", "old_path", "row_id"], "__k")
    new_left = ranked(free.join(gone.select(*keys), keys, "left_anti").drop("__k"), ["content"], ["new_path"], "__k").drop("channel")
    cross = gone_left.join(new_left, ["content", "__k"]).select("row_id", "old_path", "new_path", "content", F.when(F.col("channel") == "bin", "out").otherwise("in").alias("kind"))
    return stay.unionByName(cross)
