"""Linked rows share their marks and labels: the newest mark of a group wins, and a label is held unless its removal is later.

Groups come from ``graph.connected_components`` over the links. Defined results: a null stamp is older than any; ties go to a RAW, then to the larger id; a group of one
changes nothing; rows that agree with the winner already are left as they are; repeated labels count once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, connected_components


def link_pairs(photos: DataFrame, rendered: tuple[str, ...], camera: tuple[str, ...]) -> DataFrame:
    """(raw_id, camera_file_id): a RAW and a camera file of one library, folder, stem and moment, by null-safe make and model, both single files.

    ``photos``: id, library_id, folder, stem, date_taken, camera_make, camera_model, format, kind."""
    files = photos.filter("kind = 'file' AND date_taken IS NOT NULL")
    keys = ["library_id", "date_taken", "folder", "stem"]
    raw = files.filter(~F.col("format").isin(*rendered)).select(*keys, F.col("id").alias("raw_id"), F.col("camera_make").alias("__make"), F.col("camera_model").alias("__model"))
    file = files.filter(F.col("format").isin(*camera)).select(*keys, F.col("id").alias("camera_file_id"), "camera_make", "camera_model")
    return raw.join(file, keys).filter(F.expr("__make <=> camera_make AND __model <=> camera_model")).select("raw_id", "camera_file_id")


def newest_marks(members: DataFrame, columns: list[str], stamp: str) -> DataFrame:
    """(id, columns): what the members (group, id, is_raw, columns, stamp) of a group have to take over from the one with the newest stamp."""
    value = F.struct(*columns)
    rank = F.struct(F.coalesce(stamp, F.lit("")), F.col("is_raw").cast("int"), "id")
    winner = members.groupBy("group").agg(F.max_by(value, rank).alias("__won"))
    differs = ~F.struct(*columns).eqNullSafe(F.col("__won"))
    return members.join(winner, "group").filter(differs).select("id", *(F.col(f"__won.{c}").alias(c) for c in columns))


def shared_labels(members: DataFrame, labels: DataFrame, removals: DataFrame) -> DataFrame:
    """(id, label, action): ``add`` where a group's other members hold a label newer than or as new as its last removal from those that lack it, ``remove`` from its
    holders where the removal is later. ``members``: group, id; ``labels`` and ``removals``: id, label, stamp."""
    held = labels.groupBy("id", "label").agg(F.max(F.coalesce("stamp", F.lit(""))).alias("__held"))
    taken = removals.groupBy("id", "label").agg(F.max(F.coalesce("stamp", F.lit(""))).alias("__gone"))
    wanted = members.join(held, "id").groupBy("group", "label").agg(F.max("__held").alias("__added"), F.count("*").alias("__n"))
    each = members.join(wanted, "group").join(held, ["id", "label"], "left").join(taken, ["id", "label"], "left")
    lacking = F.col("__held").isNull()
    last = each.groupBy("group", "label").agg(F.max(F.when(lacking, F.coalesce("__gone", F.lit("")))).alias("__removed"))
    judged = each.join(last.filter("__removed IS NOT NULL"), ["group", "label"])
    later = F.col("__removed") > F.col("__added")
    action = F.when(later & ~lacking, "remove").when(~later & lacking, "add")
    return judged.select("id", "label", action.alias("action")).filter("action IS NOT NULL")


def swaps_into_stacks(members: DataFrame, stacks: DataFrame) -> DataFrame:
    """(id, stack_id): where the members of groups with a new link go. Every camera file leaves its stack; the group's RAW of the least id takes a place it leaves if it is in none and was never taken
    out of one, or only in a detected stack while that one is a person's: in the end the first person's stack by the files' ids, else the first.

    ``members``: group, id, is_raw, stack_id, unstacked. ``stacks``: stack_id, manual. Groups without a RAW change nothing; a null ``unstacked`` is false; stacks that aren't there count as detected."""
    placed = members.join(stacks.select("stack_id", F.col("manual").alias("__manual")), "stack_id", "left").withColumn("__manual", F.coalesce("__manual", F.lit(False)))
    raw = F.min_by(F.struct("id", "stack_id", F.coalesce("unstacked", F.lit(False)).alias("out"), F.col("__manual").alias("manual")), F.when(F.col("is_raw"), F.col("id")))
    held = ~F.col("is_raw") & F.col("stack_id").isNotNull()
    first = F.min_by(F.struct("stack_id", F.col("__manual").alias("manual")), F.when(held, F.struct(~F.col("__manual"), "id")))
    judged = placed.groupBy("group").agg(raw.alias("raw"), first.alias("first")).filter("raw IS NOT NULL AND first IS NOT NULL")
    takes = F.when(F.col("raw.stack_id").isNull(), ~F.col("raw.out")).otherwise(~F.col("raw.manual") & F.col("first.manual"))
    moved = judged.filter(takes).select(F.col("raw.id").alias("id"), F.col("first.stack_id").alias("stack_id"))
    left = members.filter(held).join(judged, "group", "left_semi").select("id", F.lit(None).cast(dict(members.dtypes)["stack_id"]).alias("stack_id"))
    return left.unionByName(moved)


def spent_stacks(rows: DataFrame) -> DataFrame:
    """Stacks (stack_id of rows) that have fewer than two members left."""
    return rows.filter("stack_id IS NOT NULL").groupBy("stack_id").agg(F.count("*").alias("members")).filter("members < 2")


def collapse_stacks(members: DataFrame, stacks: DataFrame, graves: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Stacks that share a photo, however many others lie between, become the one of the newest created_stamp (ties: the larger id). Gives all members as they are then, and the stacks that are gone.

    Members of the others go to it under the stamp ``at``, but not where it has a tombstone for that photo newer than the membership, for there somebody took it out. ``members``: stack_id, photo_id, stamp.
    ``stacks``: stack_id, created_stamp. ``graves``: stack_id, photo_id, stamp of the tombstones of memberships. Null stamps are older than any; stacks that aren't in ``stacks`` win nothing and lose nothing."""
    least = members.groupBy("photo_id").agg(F.min("stack_id").alias("__a"))
    shared = members.join(least, "photo_id").filter("stack_id <> __a").select("__a", "stack_id").distinct()
    groups = connected_components(shared, "__a", "stack_id").withColumnRenamed("node", "stack_id").join(stacks, "stack_id")
    won = groups.groupBy("component").agg(F.max_by("stack_id", F.struct(F.coalesce("created_stamp", F.lit("")), "stack_id")).alias("__winner"))
    losing = checkpointed(groups.join(won, "component").filter("stack_id <> __winner").select("stack_id", "__winner"))
    moving = members.join(losing, "stack_id").select("photo_id", F.col("__winner").alias("stack_id"), F.coalesce("stamp", F.lit("")).alias("__was"))
    buried = graves.groupBy("stack_id", "photo_id").agg(F.max("stamp").alias("__grave"))
    allowed = moving.join(buried, ["stack_id", "photo_id"], "left").filter("__grave IS NULL OR __grave <= __was").select("stack_id", "photo_id").distinct()
    stay = members.join(losing, "stack_id", "left_anti").select("stack_id", "photo_id", "stamp")
    new = allowed.join(stay, ["stack_id", "photo_id"], "left_anti").select("stack_id", "photo_id", F.lit(at).alias("stamp"))
    return stay.unionByName(new), losing.select("stack_id")
