"""Snapshots, moves, upserts and last-writer-wins merges, each a pure function of tables.

Defined results: null keys match nothing in joins and are one key in aggregations; null stamps are older than any; of repeated rows with one key and stamp one stays; null contents are equal; changes to rows that
aren't there are kept or left out as each function says; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookup
from .graph import checkpointed


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, content: str, missing: str | None = None) -> DataFrame:
    """(key, change): added, removed, modified or reappeared, by a full join on the key. Null contents compare as equal."""
    a = before.select(F.col(key), F.col(content).alias("__was"), (F.col(missing) if missing else F.lit(False)).alias("__missing"), F.lit(True).alias("__old"))
    b = after.select(F.col(key), F.col(content).alias("__is"), F.lit(True).alias("__new"))
    change = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("__new").isNull() & ~F.col("__missing"), "removed")
        .when(F.col("__new") & F.col("__missing"), "reappeared")
        .when(F.col("__new") & ~F.col("__was").eqNullSafe(F.col("__is")), "modified")
    )
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


def detect_moves(before: DataFrame, after: DataFrame, path: str, content: str) -> DataFrame:
    """(content, from_id, to_id): the k-th path that is gone and the k-th that is new, of equal content, in order of path. A new path whose content
    a changed file had before is withheld."""
    gone = before.join(after, path, "left_anti")
    new = after.join(before, path, "left_anti")
    changed = before.alias("b").join(after.alias("a"), path).filter(f"NOT (b.{content} <=> a.{content})").select(F.col(f"b.{content}").alias(content)).distinct()
    new = new.join(changed, content, "left_anti")
    return lookup.pair_multisets(gone, new, [content], [path], [path], path, path)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Insert or update where newer: of each key the row with the largest stamp; what stands wins a tie."""
    both = base.withColumn("__stands", F.lit(1)).unionByName(changes.withColumn("__stands", F.lit(0)))
    row = F.struct(*[F.col(c) for c in base.columns])
    best = both.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(stamp), F.col("__stands"))).alias("__row"))
    return best.select("__row.*")


def insert_missing(base: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or ignore: what stands stays; of new rows with one key the first in the order is taken."""
    new = rows.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in base.columns]), order).alias("__row")).select("__row.*")
    return base.unionByName(new.join(base, keys, "left_anti"))


def update_from(base: DataFrame, source: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Sets a column from a matching row's value, and leaves it where nothing matches."""
    new = source.select(key, F.col(value).alias("__v"))
    return base.join(new, key, "left").withColumn(column, F.coalesce("__v", column)).drop("__v").select(*base.columns)


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str, child_key: str, stamp: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of parents and of children, and the parents' tombstones."""
    ids = doomed.select(key).distinct()
    left = parents.join(ids, key, "left_anti")
    kept = children.join(ids.select(F.col(key).alias(child_key)), child_key, "left_anti")
    return left, kept, parents.join(ids, key, "left_semi").select(F.col(key), stamp.alias("stamp"), F.lit(True).alias("deleted"))


def merge_units(log: DataFrame, keys: list[str], unit: str, stamp: list[str], value: str) -> DataFrame:
    """Last writer wins for each unit of a row: the value with the largest stamp, aggregated map-side, in any order of arrival."""
    return log.groupBy(*keys, unit).agg(F.max_by(value, F.struct(*stamp)).alias(value), F.max(F.struct(*stamp)).alias("stamp"))


def merge_edits(log: DataFrame, keys: list[str], by_user: str, stamp: list[str], value: str) -> DataFrame:
    """Last writer wins, but a user's edit is never displaced by an automatic one: the value with the largest (by_user, stamp). Null counts as automatic."""
    rank = F.struct(F.coalesce(F.col(by_user), F.lit(False)).cast("int").alias("user"), *stamp)
    return log.groupBy(*keys).agg(F.max_by(value, rank).alias(value), F.max(rank).alias("rank")).withColumn(by_user, F.col("rank.user") == 1).select(*keys, value, by_user)


def page_verdicts(pages: DataFrame, held: DataFrame, origin: str, first: str, last: str, now: Column, most_ahead: Column) -> DataFrame:
    """What to do with each page of a change log (origin, first, last: its stamps in milliseconds): ``reject`` where a stamp is further ahead of the clock than allowed, ``old`` where
    the origin's held stamp covers it all, ``wait`` where there is a gap before it, else ``apply``. ``held``: origin, held, and ``expected``, the next page's first stamp."""
    joined = pages.join(held.select(origin, F.col("held").alias("__held"), F.col("expected").alias("__next")), origin, "left")
    verdict = F.when(F.col(last) > now + most_ahead, "reject").when(F.col(last) <= F.coalesce("__held", F.lit(-1)), "old").when(F.col(first) > F.col("__next"), "wait").otherwise("apply")
    return joined.withColumn("verdict", verdict).drop("__held", "__next")


#: Pairs of a join that one task makes.
PAIRS_PER_TASK = 1_000_000


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on the keys where few rows make many pairs: the rows of a key are dealt out on the left and repeated on the right by how many pairs it has, and the number of tasks follows from all pairs."""
    there = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    count = lambda df, name: df.filter(there).groupBy(*keys).agg(F.count("*").alias(name))
    pairs = F.col("__n") * F.col("__m")
    sizes = checkpointed(count(left, "__n").join(count(right, "__m"), keys).select(*keys, pairs.alias("__pairs"), F.least(F.ceil(pairs / PAIRS_PER_TASK), F.col("__n")).cast("int").alias("__parts")))
    tasks = -(-(sizes.agg(F.sum("__pairs")).first()[0] or 0) // PAIRS_PER_TASK) or 1
    dealt = left.join(sizes, keys).withColumn("__part", F.pmod(F.xxhash64(*left.columns), F.col("__parts").cast("long"))).drop("__pairs", "__parts")
    copies = right.join(sizes, keys).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts").cast("long") - 1))).drop("__pairs", "__parts")
    by = [*keys, "__part"]
    sides = [side.repartition(2 * tasks, *by) for side in (dealt, copies)]
    return sides[0].join(sides[1].hint("shuffle_hash"), by).drop("__part")


def folder_claims(arrivals: DataFrame, holders: DataFrame) -> DataFrame:
    """Who keeps a folder that an arriving rename (library_id, id, path, was, stamp) and another row (library_id, id, path, stamp) both claim: the earlier stamp, on ties the
    smaller id; a holder without a stamp gives way. ``loser`` and the path it goes to, ``given``: an arriving one that loses goes back to where it ``was`` unless that is taken or
    unknown, then, as a holder that loses does, to the first of path_2, path_3 and so on that is free."""
    h = holders.select("library_id", "path", F.col("id").alias("held_by"), F.col("stamp").alias("__held"))
    met = _met(arrivals, h, ["library_id", "path"]).filter("id <> held_by")
    arriving = F.col("__held").isNotNull() & ((F.col("__held") < F.col("stamp")) | ((F.col("__held") == F.col("stamp")) & (F.col("held_by") < F.col("id"))))
    back = holders.select("library_id", F.col("path").alias("was"), F.lit(True).alias("__taken")).distinct()
    spent = holders.select("library_id", F.regexp_extract("path", r"^(.*)_(\d{1,9})$", 1).alias("path"), F.regexp_extract("path", r"_(\d{1,9})$", 1).try_cast("int").alias("k")).filter("k >= 2")
    spent = spent.join(arrivals.select("library_id", "path").distinct(), ["library_id", "path"], "left_semi").groupBy("library_id", "path").agg(F.array_sort(F.collect_set("k")).alias("__ks"))
    judged = met.withColumn("__arriving", arriving).join(back, ["library_id", "was"], "left").join(spent, ["library_id", "path"], "left")
    ks = F.coalesce("__ks", F.array().cast("array<int>"))
    free = F.aggregate(ks, F.lit(2), lambda n, k: F.when(k == n, n + 1).otherwise(n))
    given = F.when(F.col("__arriving") & F.col("was").isNotNull() & F.col("__taken").isNull() & (F.col("was") != F.col("path")), F.col("was")).otherwise(F.concat_ws("_", "path", free.cast("string")))
    return judged.select("library_id", "path", F.when(F.col("__arriving"), F.col("id")).otherwise(F.col("held_by")).alias("loser"), F.when(F.col("__arriving"), "arriving").otherwise("holder").alias("side"), given.alias("given"))


def apply_tombstones(merged: DataFrame, tombstones: DataFrame, keys: list[str], stamp: Column, final: bool) -> DataFrame:
    """Drops rows with a tombstone: any, where deletion is final; else those no newer than it. ``tombstones``: keys and tomb_stamp."""
    last = tombstones.groupBy(*keys).agg(F.max("tomb_stamp").alias("__tomb"))
    joined = merged.join(last, keys, "left")
    alive = F.col("__tomb").isNull() if final else F.col("__tomb").isNull() | (stamp > F.col("__tomb"))
    return joined.filter(alive).drop("__tomb")


def defer(arrivals: DataFrame, parents: DataFrame, reference: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(ready, deferred): rows that refer to a parent that isn't there yet wait; rows without a reference don't."""
    there = parents.select(F.col(parent_key).alias(reference)).distinct()
    deferred = arrivals.filter(F.col(reference).isNotNull()).join(there, reference, "left_anti")
    ready = arrivals.filter(F.col(reference).isNull()).unionByName(arrivals.join(there, reference, "left_semi").select(*arrivals.columns))
    return ready, deferred.select(*arrivals.columns)


def version_vector(applied: DataFrame, deferred: DataFrame, origin: str, stamp: str) -> DataFrame:
    """(origin, held): the largest applied stamp of each origin, below the first that was deferred."""
    first = deferred.groupBy(origin).agg(F.min(stamp).alias("__first"))
    joined = applied.join(first, origin, "left").filter(F.col("__first").isNull() | (F.col(stamp) < F.col("__first")))
    return joined.groupBy(origin).agg(F.max(stamp).alias("held"))


def collectable(tombstones: DataFrame, vectors: DataFrame, origin: str, stamp: str, peer: str) -> DataFrame:
    """Tombstones that every peer's vector (peer, origin, held) covers: those up to the least that any peer holds of their origin. Vectors are reduced to a row an
    origin first, so tombstones meet nothing that grows with the peers."""
    peers = vectors.agg(F.count_distinct(peer).alias("__peers"))
    held = vectors.groupBy(origin, peer).agg(F.max("held").alias("__held")).groupBy(origin).agg(F.min("__held").alias("__least"), F.count("*").alias("__n"))
    cover = held.join(F.broadcast(peers), F.col("__n") == F.col("__peers")).select(origin, "__least")
    return tombstones.join(cover, origin).filter(F.col(stamp) <= F.col("__least")).select(*tombstones.columns)


def claim_names(claims: DataFrame, name: str, claimed: str, row_id: str) -> DataFrame:
    """One holder a name: the earliest claim (ties: smaller id) keeps it, the others take _2, _3 and so on."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(name).orderBy(claimed, row_id))
    return claims.withColumn("__place", place).withColumn("given", F.when(F.col("__place") == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), F.col("__place").cast("string")))).drop("__place")


def owed(work: DataFrame, done: DataFrame, key: str, wanted: str, built_from: str) -> DataFrame:
    """Work whose wanted stamp is newer than what was built, or that was never built."""
    built = done.groupBy(key).agg(F.max(built_from).alias("__built"))
    return work.join(built, key, "left").filter(F.col("__built").isNull() | (F.col(wanted) > F.col("__built"))).drop("__built")


def to_hash(files: DataFrame, known: DataFrame, path: str, modified: str, size: str) -> DataFrame:
    """Files whose content has to be read: new, or of another time or size than the catalogue has; a quick check that reads no content. Null times and sizes are equal to each other."""
    was = known.select(path, F.col(modified).alias("__m"), F.col(size).alias("__s"), F.lit(True).alias("__known"))
    joined = files.join(was, path, "left")
    same = F.coalesce("__known", F.lit(False)) & F.col(modified).eqNullSafe(F.col("__m")) & F.col(size).eqNullSafe(F.col("__s"))
    return joined.filter(~same).drop("__m", "__s", "__known")


def set_fields(rows: DataFrame, chosen: DataFrame, key: str, values: dict[str, Column], stamp: str, at: Column) -> DataFrame:
    """Rows with the chosen ones' fields set under one new stamp: marks, moves, binning and hiding are all this. A row that has the values already keeps its stamp."""
    ids = chosen.select(F.col(key)).distinct().withColumn("__chosen", F.lit(True))
    joined = rows.join(ids, key, "left")
    new = {c: F.when(F.col("__chosen"), v).otherwise(F.col(c)) for c, v in values.items()}
    differs = F.lit(False)
    for c, v in new.items():
        differs = differs | ~v.eqNullSafe(F.col(c))
    return joined.withColumn(stamp, F.when(differs, at).otherwise(F.col(stamp))).withColumns(new).select(*rows.columns)


def page_of_rows(log: DataFrame, rows: DataFrame, keys: list[str], order: list[str], after: tuple | None, limit: int = 500) -> DataFrame:
    """The next page of a change feed with the current row of each key in it, read once a key; a key whose row is gone has null fields."""
    from ..sources.catalogue import feed_page

    page = feed_page(log, order, after, limit)
    wanted = rows.join(page.select(*keys).distinct(), keys, "left_semi")
    return page.join(wanted, keys, "left")


def undo_history(steps: DataFrame, by: str, at: str, cursor: str, most: int) -> DataFrame:
    """A document's steps (by, at, cursor: where the reader stands) as ``done`` or ``redo`` (steps after the cursor, which a new step drops), the newest ``most`` of them."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(at).desc()))
    return steps.withColumn("__place", place).filter(F.col("__place") <= most).withColumn("state", F.when(F.col(at) <= F.col(cursor), "done").otherwise("redo")).drop("__place")
