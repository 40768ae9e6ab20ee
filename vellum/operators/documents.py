"""Edit documents as flat JSON objects: differences, and applying and undoing them.

Defined results: null documents have no fields; a field whose value is null is one that isn't there; equal documents differ in nothing; undoing a difference that was applied gives the fields of before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A difference maps a field to its old and new JSON text; null stands for a field that isn't there.
DIFF = "map<string, struct<old: string, new: string>>"


def fields(doc: Column) -> Column:
    """Top-level fields with their values as JSON text; null documents have none."""
    return F.coalesce(F.from_json(doc, "map<string, string>"), F.create_map().cast("map<string, string>"))


def difference(old: Column, new: Column) -> Column:
    """What changes over the union of the keys."""
    a, b = fields(old), fields(new)
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    changed = F.filter(keys, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    return F.map_from_entries(F.transform(changed, lambda k: F.struct(k, F.struct(F.element_at(a, k).alias("old"), F.element_at(b, k).alias("new")))))


def apply(doc: Column, diff: Column, undo: bool = False) -> Column:
    """The fields after a difference (or before it, with ``undo``), as a map; other fields stay."""
    have, side = fields(doc), "old" if undo else "new"
    keys = F.array_sort(F.array_union(F.map_keys(have), F.map_keys(diff)))
    value = lambda k: F.when(F.array_contains(F.map_keys(diff), k), F.element_at(diff, k)[side]).otherwise(F.element_at(have, k))
    entries = F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), value(k).alias("value"))), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)
