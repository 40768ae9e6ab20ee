"""What a backup holds of a library's originals, and what it owes.

One left join of the originals with one backup's copies answers for all sets; nothing is joined twice.

Defined results: rows of other kinds than file are left out; an unknown content hash or size of the photo contradicts no copy; a copy of unknown health is not held and not owed again by that alone; of several copies of one photo
the one at the least path counts; null photo ids meet no copy; empty tables give no rows, and a coverage of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_copy(photos: DataFrame, copies: DataFrame, peer) -> DataFrame:
    one = copies.filter(F.col("peer_id") == F.lit(peer)).groupBy("photo_id").agg(F.min_by(F.struct("rel_path", "health", "content_hash", "size"), "rel_path").alias("__copy"))
    return photos.filter("kind = 'file'").join(one, "photo_id", "left")


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _held() -> Column:
    return _sure(F.col("__copy.health") == "held")


def _same() -> Column:
    """The copy is of what the photo is, as far as that is known."""
    return (F.col("content_hash").isNull() | _sure(F.col("content_hash") == F.col("__copy.content_hash"))) & (F.col("file_size").isNull() | _sure(F.col("file_size") == F.col("__copy.size")))


def _to_send() -> Column:
    other = _sure(F.col("content_hash") != F.col("__copy.content_hash")) | _sure(F.col("file_size") != F.col("__copy.size"))
    return ~F.col("is_missing") & (~F.col("__copy").isNotNull() | _sure(F.col("__copy.health") != "held") | other)


def backup_states(photos: DataFrame, copies: DataFrame, peer) -> DataFrame:
    """(photo_id, owed, lost, misplaced, offloaded, belongs_at, was_at) of each original. ``photos``: photo_id, kind, path, is_missing, content_hash, file_size. ``copies``: peer_id, photo_id, rel_path, health,
    content_hash, size. Owed: here, and not held as it is; lost: not here, and no copy known; misplaced: held under another path; offloaded: not here, with a copy there."""
    there = F.col("__copy").isNotNull()
    return _with_copy(photos, copies, peer).select(
        "photo_id", _to_send().alias("owed"), (F.col("is_missing") & ~there).alias("lost"), (_held() & _sure(F.col("path") != F.col("__copy.rel_path"))).alias("misplaced"), (F.col("is_missing") & there).alias("offloaded"),
        F.col("path").alias("belongs_at"), F.col("__copy.rel_path").alias("was_at"),
    )


def backup_coverage(photos: DataFrame, copies: DataFrame, peer) -> DataFrame:
    """One row: originals, backed_up, pending, offloaded, missing, changed, missing_originals."""
    there, health = F.col("__copy").isNotNull(), lambda what: _sure(F.col("__copy.health") == what)
    return _with_copy(photos, copies, peer).agg(
        F.count("*").alias("originals"), F.count_if(_held() & _same()).alias("backed_up"), F.count_if(_to_send()).alias("pending"), F.count_if(F.col("is_missing") & _held()).alias("offloaded"), F.count_if(health("missing")).alias("missing"),
        F.count_if(health("changed")).alias("changed"), F.count_if(F.col("is_missing") & (~there | _sure(F.col("__copy.health") != "held"))).alias("missing_originals"),
    )
