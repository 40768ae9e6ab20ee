"""Edit sessions: which document descends from which, what divergence parks, revisions that moved on, and restored stamps.

Defined results: a side without a session or stamp, or without a document, parks nothing; a null chain is empty; equal sessions descend by their stamps;
repeated rows are judged alike; a null revision is 0; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def descends(session: Column, stamp: Column, chain: Column, other_session: Column, other_stamp: Column) -> Column:
    """Whether a document was built on the other's exact state or a later save of its session. ``chain``: array of (session, stamp)."""
    built_on = F.exists(F.coalesce(chain, F.array().cast("array<struct<session:string,stamp:string>>")), lambda c: (c["session"] == other_session) & (c["stamp"] >= other_stamp))
    return F.when(session == other_session, stamp >= other_stamp).otherwise(built_on)


def parked(held: DataFrame, arriving: DataFrame) -> DataFrame:
    """Both candidates of each divergence, from tables (photo_id, session, stamp, chain, doc): neither descends from the other."""
    cols = ["session", "stamp", "chain", "doc"]
    a = held.select("photo_id", *(F.col(c).alias(f"a_{c}") for c in cols)).dropna(subset=["a_session", "a_stamp"])
    b = arriving.select("photo_id", *(F.col(c).alias(f"b_{c}") for c in cols)).dropna(subset=["b_session", "b_stamp", "b_doc"])
    both = a.join(b, "photo_id")
    c = {name: F.col(name) for name in both.columns}
    one = descends(c["b_session"], c["b_stamp"], c["b_chain"], c["a_session"], c["a_stamp"])
    two = descends(c["a_session"], c["a_stamp"], c["a_chain"], c["b_session"], c["b_stamp"])
    sides = F.array(*(F.struct(*(F.col(f"{s}_{n}").alias(n) for n in ("session", "stamp", "doc"))) for s in "ab"))
    return both.filter(~(one | two)).select("photo_id", F.inline(sides)).distinct()


def conflicts(parked_rows: DataFrame, photos: DataFrame, names: DataFrame, own: str) -> DataFrame:
    """Divergences that wait, with the row's path and the name of the peer that a stamp's last part tells: ``names`` (peer, name), or this device."""
    rows = parked_rows.join(photos.select(F.col("id").alias("photo_id"), "library_id", "path"), "photo_id")
    rows = rows.withColumn("peer", F.substring("stamp", 17, 16)).join(names, "peer", "left")
    return rows.withColumn("name", F.when(F.col("peer") == own, "this device").otherwise(F.col("name")))


def at_revision(changes: DataFrame, held: DataFrame, key: str, expected: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): changes made on the revision that stands; a row that isn't there is at 0. Of several on one revision the first by ``order`` stands."""
    joined = changes.join(held.select(key, F.coalesce(revision, F.lit(0)).alias("__held")), key, "left").withColumn("__held", F.coalesce("__held", F.lit(0)))
    fits = F.coalesce(F.col(expected), F.lit(0)) == F.col("__held")
    first = joined.filter(fits).groupBy(key).agg(F.min("order").alias("__first"))
    judged = joined.join(first, key, "left").withColumn("__ok", fits & (F.col("order") == F.col("__first")))
    return judged.filter("__ok").select(*changes.columns), judged.filter("NOT coalesce(__ok, false)").select(*changes.columns, F.col("__held").alias("held"))


def restamp(rows: DataFrame, stamps: list[str], at: Column) -> DataFrame:
    """A restored catalogue's rows with one new stamp, so that their state is the one that travels."""
    return rows.withColumns({c: at for c in stamps})


def restamp_renditions(renditions: DataFrame, edits: DataFrame, at: Column) -> DataFrame:
    """Renditions (photo_id, built_from) that were current before a restore stay current: those built from a stamp at or after their edit's take the new one."""
    e = edits.select("photo_id", F.col("stamp").alias("__edit"))
    current = F.col("built_from").isNotNull() & (F.col("built_from") >= F.col("__edit"))
    return renditions.join(e, "photo_id", "left").withColumn("built_from", F.when(F.coalesce(current, F.lit(False)), at).otherwise(F.col("built_from"))).drop("__edit")


def vouch(renditions: DataFrame, vouched: DataFrame, sources: DataFrame, edits: DataFrame, placements: DataFrame) -> DataFrame:
    """Renditions (photo_id, built_from, built_at) of vouched documents (photo_id, stamp: the state whose picture the standing one has too), and of composites they are frames of:
    one that was built, and from exactly the old state, is at the standing stamp. What is behind a row is the newest of its own and its frames' edits and, of a composite, of its placement
    (``placements``: photo_id, stamp). Null stamps are older than any."""
    behind = sources.select(F.col("composed_id").alias("row"), "photo_id").unionByName(edits.select(F.col("photo_id").alias("row"), "photo_id")).distinct()
    old = edits.join(vouched.select("photo_id", F.col("stamp").alias("__was"), F.lit(True).alias("__v")), "photo_id", "left")
    each = behind.join(old, "photo_id").select("row", F.col("stamp").alias("__now"), F.when(F.col("__v"), F.col("__was")).otherwise(F.col("stamp")).alias("__then"), F.coalesce("__v", F.lit(False)).alias("__touched"))
    placed = placements.join(sources.select(F.col("composed_id").alias("photo_id")).distinct(), "photo_id", "left_semi").select(F.col("photo_id").alias("row"), F.col("stamp").alias("__now"), F.col("stamp").alias("__then"), F.lit(False).alias("__touched"))
    stamps = each.unionByName(placed).groupBy("row").agg(F.max("__now").alias("__now"), F.max("__then").alias("__then"), F.bool_or("__touched").alias("__touched"))
    joined = renditions.join(stamps.withColumnRenamed("row", "photo_id"), "photo_id", "left")
    same = F.coalesce("__touched", F.lit(False)) & F.col("built_at").isNotNull() & F.col("built_from").eqNullSafe(F.col("__then"))
    return joined.withColumn("built_from", F.when(same, F.col("__now")).otherwise(F.col("built_from"))).drop("__now", "__then", "__touched")
