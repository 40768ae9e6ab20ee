"""Joins by prefix, rule, identity and multiset, and top-1 look-ups.

Defined results: null paths and keys meet nothing; rows that repeat are kept each; a look-up without a match gives null, a count 0; null items belong to no set, so
groups of null items alone have equal sets; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def at_or_below(rows: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """Semi join: rows whose path is one of the folders or below one. Prefixes are exploded, so the join has keys; folders below others of the list
    are left out first, so a path meets one folder at most and rows need not be told apart again. Null paths are below nothing."""
    known = folders.select(F.col(folder).alias("__f")).filter("__f IS NOT NULL").distinct()
    above = known.select(F.col("__f").alias("__own"), F.explode(paths.prefixes(paths.folder(F.col("__f")))).alias("__f")).join(known, "__f", "left_semi")
    tops = known.join(above.select(F.col("__own").alias("__f")), "__f", "left_anti")
    return rows.withColumn("__f", F.explode(paths.prefixes(F.col(path)))).join(tops, "__f").select(*rows.columns)


def longest_prefix(rows: DataFrame, path: str, folders: DataFrame, folder: str, name: str) -> DataFrame:
    """Adds the longest of the folders that holds each path, or null."""
    hits = rows.select(F.col(path).alias("__p"), F.explode(paths.prefixes(F.col(path))).alias("__f"))
    best = hits.join(folders.select(F.col(folder).alias("__f")).distinct(), "__f").groupBy("__p").agg(F.max_by("__f", F.length("__f")).alias(name))
    return rows.join(best.withColumnRenamed("__p", path), path, "left")


def first_of(rows: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """One value a group, that of the first row in the order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").select(*by, F.col(value).alias(name))


def with_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Adds the number of children, 0 without any; children are counted before they are joined."""
    n = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def chosen_or_group(rows: DataFrame, chosen: DataFrame, row_id: str, group: str) -> DataFrame:
    """The chosen rows, and all members of a chosen row's group: two keyed joins in place of one with OR."""
    ids = chosen.select(row_id).distinct()
    groups = rows.join(ids, row_id, "left_semi").filter(F.col(group).isNotNull()).select(group).distinct()
    return rows.join(groups, group, "left_semi").select(*rows.columns).unionByName(rows.filter(F.col(group).isNull()).join(ids, row_id, "left_semi").select(*rows.columns))


def pair_multisets(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs the k-th of the left with the k-th of the right for each key: equal contents that were removed here and added there."""
    number = lambda df, order: df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    a = number(left.dropna(subset=keys), left_order).select(*keys, "__k", F.col(left_id).alias("from_id"))
    b = number(right.dropna(subset=keys), right_order).select(*keys, "__k", F.col(right_id).alias("to_id"))
    return a.join(b, [*keys, "__k"]).select(*keys, "from_id", "to_id")


def unique_matches(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Matches by identity that are one to one; keys with several on either side match nothing."""
    one = lambda df, col, name: df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__n"), F.min(col).alias(name)).filter("__n = 1").drop("__n")
    return one(left, left_id, "left_id").join(one(right, right_id, "right_id"), keys)


def moved_folders(moves: DataFrame, old: str, new: str) -> DataFrame:
    """From the old and new path of each file (new null where it didn't move): the folders all of whose files moved, with the same tail, to one other folder."""
    files = moves.select(F.col(old).alias("o"), F.col(new).alias("n"), paths.folder(F.col(old)).alias("f"))
    tails = files.select("o", "n", F.explode(paths.prefixes(F.col("f"))).alias("folder"))
    tail = F.substr("o", F.length("folder") + 1)
    target = F.when(F.col("n").endswith(tail), F.substring(F.col("n"), F.lit(1), F.length("n") - F.length(tail)))
    judged = tails.withColumn("target", target).groupBy("folder").agg(F.count("*").alias("files"), F.count("target").alias("moved"), F.min("target").alias("target"), F.max("target").alias("other"))
    return judged.filter("files = moved AND target = other AND folder <> target AND folder <> ''").select("folder", "target", "files")


def all_under(inputs: DataFrame, by: str, under: Column) -> DataFrame:
    """Division: groups that have inputs, all of which lie under."""
    return inputs.groupBy(by).agg(F.bool_and(F.coalesce(under, F.lit(False))).alias("__all")).filter("__all").select(by)


def same_sets(rows: DataFrame, by: str, item: str) -> DataFrame:
    """Groups with equal sets of items: (a, b) of neighbouring groups in each class of equal sets, by a digest of the sorted set."""
    sets = rows.groupBy(by).agg(F.sha2(F.to_json(F.array_sort(F.collect_set(item))).cast("binary"), 256).alias("digest"))
    w = Window.partitionBy("digest").orderBy(by)
    return sets.withColumn("first", F.first(by).over(w)).filter(F.col("first") != F.col(by)).select(F.col("first").alias("a"), F.col(by).alias("b"))
