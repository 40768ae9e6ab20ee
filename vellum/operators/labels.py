"""Saving an edited list of labels against the labels held: inserts, renames, moves and deletes by comparison, each under the save's one stamp.

Defined results: a label that the list leaves out keeps its place among the others left out, behind the listed ones; a removed label that is listed all the same is inserted anew; removals of labels not held are
ignored; of repeated listings the first counts; null ids and libraries are no labels; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairing import ranked


def saved(held: DataFrame, ordered: DataFrame, removed: DataFrame, at: Column) -> DataFrame:
    """Every label after the save, and those that go: library, id, name, colour, position, stamp, stamp_position and action (``insert``, ``rename``, ``move``, ``rename and move``, ``keep``, ``delete``).

    ``held``: library, id, name, colour, position, stamp, stamp_position. ``ordered``: library, id, name, colour, place. ``removed``: library, id. Only libraries with a row in ``ordered`` or ``removed`` are saved."""
    key = ["library", "id"]
    saved_ones = ordered.select("library").unionByName(removed.select("library")).distinct()
    held = held.dropna(subset=key).join(saved_ones, "library").withColumn("__old", F.struct("name", "colour", "position", "stamp", "stamp_position"))
    stays = held.join(removed.select(*key).distinct(), key, "left_anti").select(*key, "__old")
    goes = held.join(removed.select(*key).distinct(), key, "left_semi").select(*key, "__old")
    listed = ordered.dropna(subset=key).groupBy(*key).agg(F.min_by(F.struct("name", "colour", "place"), "place").alias("__new"))
    both = listed.join(stays, key, "full").withColumns({"__late": F.col("__new").isNull(), "__at": F.coalesce("__new.place", "__old.position")})
    placed = ranked(both, ["library"], ["__late", "__at", "id"], "__k")
    value = lambda n: F.when(F.col("__late"), F.col(f"__old.{n}")).otherwise(F.col(f"__new.{n}"))
    anew = F.col("__old").isNull()
    renamed = ~anew & ~(value("name").eqNullSafe(F.col("__old.name")) & value("colour").eqNullSafe(F.col("__old.colour")))
    moved = ~anew & ~F.col("__k").eqNullSafe(F.col("__old.position"))
    action = F.when(anew, "insert").when(renamed & moved, "rename and move").when(renamed, "rename").when(moved, "move").otherwise("keep")
    stamp = lambda changed, n: F.when(anew | changed, at).otherwise(F.col(f"__old.{n}")).alias(n)
    out = placed.select(*key, value("name").alias("name"), value("colour").alias("colour"), F.col("__k").alias("position"), stamp(renamed, "stamp"), stamp(moved, "stamp_position"), action.alias("action"))
    return out.unionByName(goes.select(*key, "__old.*", F.lit("delete").alias("action")).withColumn("position", F.col("position").cast("long")))
