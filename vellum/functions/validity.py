"""Whether a value from outside may be used: camera clock offsets, replicated paths and bin names. Null is never valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_offset(text: Column) -> Column:
    """``+11:00`` or ``-08:00``; null for anything else, such as blanks."""
    return F.when(text.rlike(r"^[+-][0-9]{2}:[0-9]{2}\z"), text)


def offset_minutes(text: Column) -> Column:
    whole = F.substring(text, 2, 2).cast("int") * 60 + F.substring(text, 5, 2).cast("int")
    return F.when(clock_offset(text).isNotNull(), F.when(text.startswith("-"), -whole).otherwise(whole))


def is_replicated_path(path: Column, longest: int = 4096) -> Column:
    """Relative to the root, with forward slashes, and no empty, ``.`` or ``..`` segment."""
    segments = F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return F.coalesce((F.length(path) <= longest) & ~path.contains("\\") & ~path.contains("\0") & ~path.rlike("^[A-Za-z]:") & ~segments, F.lit(False))


def is_bin_name(name: Column, longest: int = 255) -> Column:
    """One folder's name."""
    return F.coalesce(F.length(name).between(1, longest) & ~name.rlike(r"[/\\]") & ~name.contains("\0") & ~name.isin(".", ".."), F.lit(False))
