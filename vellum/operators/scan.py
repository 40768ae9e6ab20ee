"""Reconciling a scan with a catalogue: folders that came, went or moved, a renamed bin, crossings by path, held-back rows and orphaned files.

A scan's directories have path, dev, ino and birth, its files a path; a catalogue's shoots have id, path and the identity recorded (null until walked).

Defined results: null identities match nothing; repeated directories or files count once; an empty scan dooms nothing unless it was a full one;
paths are compared as they are, with '/' between segments and none at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import lookup


def folder_changes(shoots: DataFrame, dirs: DataFrame, files: DataFrame, full: bool) -> DataFrame:
    """(path, id, change): ``identity`` where a shoot's folder has another identity than recorded, ``create`` for folders with files and no shoot, and, after a full
    scan, ``remove`` for shoots without photos whose folder was walked once, is gone, and holds no other shoot. ``shoots``: id, path, dev, ino, birth, photos."""
    seen = dirs.dropDuplicates(["path"]).select("path", *(F.col(c).alias(f"__{c}") for c in ("dev", "ino", "birth")))
    met = shoots.join(seen, "path")
    other = ~(F.col("dev").eqNullSafe(F.col("__dev")) & F.col("ino").eqNullSafe(F.col("__ino")) & F.col("birth").eqNullSafe(F.col("__birth")))
    out = met.filter(other).select("path", "id", F.lit("identity").alias("change"))
    wanted = files.select(paths.folder(F.col("path")).alias("path")).filter("path <> ''").distinct().join(shoots.select("path"), "path", "left_anti")
    out = out.unionByName(wanted.select("path", F.lit(None).cast(shoots.schema["id"].dataType).alias("id"), F.lit("create").alias("change")))
    if full:
        empty = shoots.filter("photos = 0 AND dev IS NOT NULL").join(seen.select("path"), "path", "left_anti")
        holds = shoots.select(F.explode(paths.prefixes(paths.folder(F.col("path")))).alias("path")).distinct()
        out = out.unionByName(empty.join(holds, "path", "left_anti").select("path", "id", F.lit("remove").alias("change")))
    return out


def bin_by_identity(dirs: DataFrame, bins: DataFrame, files: DataFrame, binned: DataFrame) -> DataFrame:
    """What became of each library's bin (library_id, path, dev, ino), by the directories (library_id, path, dev, ino) that carry its identity: ``kept`` where none does
    (an unknown identity and inode 0, which a file system without inodes gives, are no one's) or it stands where it was, ``ambiguous`` where several do or one below another folder, for a bin is a name in the root, ``renamed`` with its new path (``target``) where one does that holds a binned file (library_id,
    path) under its name of old, else ``stranger``."""
    found = dirs.dropDuplicates(["library_id", "path"]).select("library_id", F.col("path").alias("__at"), "dev", "ino")
    met = bins.filter("ino <> 0").join(found, ["library_id", "dev", "ino"]).groupBy("library_id").agg(F.count("*").alias("__n"), F.min("__at").alias("target"), F.bool_or(F.col("__at") == F.col("path")).alias("__same"))
    tails = binned.join(bins.select("library_id", F.col("path").alias("__bin")), "library_id").filter(paths.below(F.col("path"), F.col("__bin")))
    tails = tails.select("library_id", F.substr("path", F.length("__bin") + 1).alias("__tail"))
    lone = (F.col("__n") == 1) & (F.instr("target", "/") == 0)
    holds = tails.join(met.filter(lone), "library_id").select("library_id", F.concat("target", "__tail").alias("path")).join(files, ["library_id", "path"], "left_semi").select("library_id", F.lit(True).alias("__holds")).distinct()
    out = bins.join(met, "library_id", "left").join(holds, "library_id", "left")
    what = F.when(F.col("__n").isNull() | ((F.col("__n") == 1) & F.col("__same")), "kept").when(~lone, "ambiguous").when(F.col("__holds"), "renamed").otherwise("stranger")
    return out.select("library_id", "path", what.alias("became"), F.when(what == "renamed", F.col("target")).alias("target"))


def pair_by_path(added: DataFrame, removed: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(crossings, additions left): a file new in the bin under ``root`` at the path of a live row that went is that row, whatever its content.
    ``added``: path; ``removed``: id, path. Gives crossings (id, old_path, new_path)."""
    inside = added.filter(paths.below(F.col("path"), root)).select(F.col("path").alias("new_path"), F.expr(f"substring(path, {len(root) + 2})").alias("path")).distinct()
    met = removed.join(inside, "path").select("id", F.col("path").alias("old_path"), "new_path")
    return met, added.join(met.select(F.col("new_path").alias("path")), "path", "left_anti")


def without_stalled(rows: DataFrame, files: DataFrame, stalled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id) and files (path) less those of moves that wait (id, was_at): both sides stay out of a diff until the move is done."""
    return rows.join(stalled.select("id"), "id", "left_anti"), files.join(stalled.select(F.col("was_at").alias("path")), "path", "left_anti")


def in_scope_of(rows: DataFrame, changed: DataFrame, missing: Column) -> DataFrame:
    """What a scan of some paths compares: the rows (path) at or below a changed path, and all that are missing already."""
    near = lookup.at_or_below(rows, "path", changed, "path")
    return near.unionByName(rows.filter(missing).join(near.select("path").distinct(), "path", "left_anti"))


def orphans(files: DataFrame, live: DataFrame, extension: str, staging: str, now: Column, grace: float) -> DataFrame:
    """Generated files (path, modified, bytes) named by no live row's id, or with an extension no longer written; what is being staged has ``grace`` seconds."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.withColumns({"id": F.regexp_replace(name, r"\.[^.]+$", ""), "__ext": F.regexp_extract(name, r"(\.[^.]+)$", 1)})
    kept = named.join(live.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").filter(F.col("__ext") == extension).select("path")
    staged = F.col("path").endswith(staging) & (now - F.col("modified") < grace)
    return named.join(kept.distinct(), "path", "left_anti").filter(~staged).select("path", "bytes")


def stale_drafts(files: DataFrame, folder: str, now: Column, most_age: float) -> DataFrame:
    """(draft, bytes) of the drafts, folders right below ``folder``, whose newest file is older than ``most_age`` seconds. ``files``: path, modified, bytes."""
    inside = files.filter(paths.below(F.col("path"), folder)).withColumn("draft", F.split(F.expr(f"substring(path, {len(folder) + 2})"), "/")[0])
    return inside.groupBy("draft").agg(F.max("modified").alias("__last"), F.sum("bytes").alias("bytes")).filter(now - F.col("__last") > most_age).select("draft", "bytes")


def bracket_orders(frames: DataFrame, shift_frames: int) -> DataFrame:
    """What merging each asked set of frames (merge, id, stack, origin, kind, index, taken) gives: ``problem`` (null if none: not one bracket stack, not one capture, a
    pixel shift without all of its frames), kind, and ids in the camera's order (by index where all have one, else by time)."""
    place = F.struct(F.when(F.col("__all"), F.col("index")).alias("i"), F.when(~F.col("__all"), F.col("taken")).alias("t"), "id")
    marked = frames.join(frames.groupBy("merge").agg((F.count("index") == F.count("*")).alias("__all")), "merge")
    out = marked.groupBy("merge").agg(
        F.count("*").alias("n"), F.count_distinct("stack").alias("stacks"), F.bool_and(F.coalesce((F.col("origin") == "bracket") & F.col("stack").isNotNull(), F.lit(False))).alias("brackets"),
        F.count_distinct("kind").alias("kinds"), F.count("kind").alias("known"), F.min("kind").alias("kind"), F.array_sort(F.collect_list(place)).alias("placed"),
    )  # a merge is a stack's frames: some dozens
    problem = F.when((F.col("stacks") != 1) | ~F.col("brackets"), "not one bracket stack").when((F.col("kinds") != 1) | (F.col("known") != F.col("n")), "not one capture")
    problem = problem.when((F.col("kind") == "pixelShift") & (F.col("n") != shift_frames), "not all frames of a pixel shift")
    return out.select("merge", problem.alias("problem"), F.when(problem.isNull(), F.col("kind")).alias("kind"), F.when(problem.isNull(), F.transform("placed", lambda p: p["id"])).alias("ids"))
