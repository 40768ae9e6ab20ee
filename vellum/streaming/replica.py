"""A replica's merge of change logs as keyed state: last-writer-wins units, tombstones, rows that wait for their parent, and a version vector held below what waits.

A change names its ``root`` (the row that it and its parents hang below), so a row and what refers to it share a key of state and a waiting row is settled where its parent arrives. What is shown is a function
of the set of changes alone, so any order of arrival, repeats included, ends in the same rows; ``merged`` computes it in one batch. Rows are given out parents first, by the order of kinds.

A unit is shown where its stamp is later than the row's last tombstone (of a kind whose deletion is ``final``: where there is none) and the row's parent is shown; it waits where only the parent is missing.

Defined results: of equal stamps the greater value wins; a row whose parents form a ring waits; null stamps are older than any; a change without a unit and not deleted is an empty unit; one root's rows are one key of
state and must fit a task; an empty log gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import changes, graph

LOG = "root string, kind string, row_id string, parent_kind string, parent_id string, unit string, stamp string, value string, deleted boolean"
SHOWN = "root string, kind string, row_id string, unit string, stamp string, value string, status string, seq long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Merge(StatefulProcessor):
    def __init__(self, kinds: list[str], final: list[str]):
        self.order, self.final = {k: i for i, k in enumerate(kinds)}, set(final)

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = "kind string, row_id string"
        self.units = handle.getMapState("units", f"{row}, unit string", "stamp string, value string, parent_kind string, parent_id string")
        self.graves = handle.getMapState("graves", row, "stamp string")
        self.shown = handle.getMapState("shown", f"{row}, unit string", "stamp string, value string, status string")
        self.seq = handle.getValueState("seq", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        units, graves = (dict(state.iterator()) for state in (self.units, self.graves))
        for pdf in rows:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for kind, row_id, parent_kind, parent_id, unit, stamp, value, deleted in zip(*(pdf[c] for c in ("kind", "row_id", "parent_kind", "parent_id", "unit", "stamp", "value", "deleted"))):
                stamp = stamp or ""
                if deleted:
                    if stamp > graves.get((kind, row_id), ("",))[0] or (kind, row_id) not in graves:
                        graves[kind, row_id] = (stamp,)
                        self.graves.updateValue((kind, row_id), (stamp,))
                    continue
                at, new = (kind, row_id, unit or ""), (stamp, value, parent_kind, parent_id)
                held = units.get(at)
                if held is None or (stamp, value or "") > (held[0], held[1] or ""):
                    units[at] = new
                    self.units.updateValue(at, new)
        now = self._statuses(units, graves)
        was = dict(self.shown.iterator())
        changed = [(at, row) for at, row in now.items() if was.get(at) != row]
        if not changed:
            return
        seq = (self.seq.get() or (0,))[0] + 1
        self.seq.update((seq,))
        for at, row in changed:
            self.shown.updateValue(at, row)
        changed.sort(key=lambda c: (self.order.get(c[0][0], len(self.order)), c[0]))
        out = [(key[0], *at, stamp, value, status, seq) for at, (stamp, value, status) in changed]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SHOWN.split(", ")])

    def _statuses(self, units: dict, graves: dict) -> dict:
        """(stamp, value, status) of each unit, and of each tombstone as a unit named "deleted"."""
        alive, parent = {}, {}
        for (kind, row_id, unit), (stamp, _, parent_kind, parent_id) in units.items():
            grave = graves.get((kind, row_id))
            alive[kind, row_id, unit] = grave is None or (kind not in self.final and stamp > grave[0])
            if alive[kind, row_id, unit]:
                parent[kind, row_id] = max(parent.get((kind, row_id), ("", "", "")), (stamp, parent_kind or "", parent_id or ""))
        seen: dict = {}

        def there(row) -> bool:
            trail = []
            while row not in seen:
                if row not in parent:
                    seen[row] = False
                elif not parent[row][2]:
                    seen[row] = True
                else:
                    seen[row] = False  # stands if the parents form a ring
                    trail.append(row)
                    row = parent[row][1:]
            for own in reversed(trail):
                seen[own] = seen[parent[own][1:]]
            return seen[row if not trail else trail[0]]

        out = {at: (stamp, value, "gone" if not alive[at] else "applied" if there(at[:2]) else "waiting") for at, (stamp, value, _, _) in units.items()}
        return out | {(*row, "deleted"): (stamp, None, "gone") for row, (stamp,) in graves.items()}


def stream_merge(log: DataFrame, kinds: list[str], final: list[str] | None = None) -> DataFrame:
    """What changes in the replica, batch by batch: rows of SHOWN, later ones with a greater ``seq`` of their root. For ``change_log.MergedTable`` by (root, kind, row_id, unit) and ``seq``."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = log.select(*(c.split()[0] for c in LOG.split(", ")))
    return rows.groupBy("root").transformWithStateInPandas(Merge(kinds, final or []), SHOWN, "Update", "None")


def merged(log: DataFrame, final: list[str] | None = None) -> DataFrame:
    """The same rows of a whole log in one batch, without ``seq``."""
    row, unit = ["root", "kind", "row_id"], F.coalesce("unit", F.lit(""))
    log = log.withColumns({"stamp": F.coalesce("stamp", F.lit("")), "unit": unit})
    best = log.filter("NOT coalesce(deleted, false)").groupBy(*row, "unit").agg(F.max_by(F.struct("stamp", "value", "parent_kind", "parent_id"), F.struct("stamp", F.coalesce("value", F.lit("")))).alias("w")).select(*row, "unit", "w.*")
    graves = log.filter("deleted").groupBy(*row).agg(F.max("stamp").alias("tomb_stamp"))
    judged = best.join(graves, row, "left")
    lives = F.col("tomb_stamp").isNull() | (~F.col("kind").isin(*(final or [""])) & (F.col("stamp") > F.col("tomb_stamp")))
    judged = graph.checkpointed(judged.withColumn("alive", lives))
    name = lambda kind, row_id: F.to_json(F.struct("root", F.col(kind).alias("k"), F.col(row_id).alias("r")))
    last = judged.filter("alive").groupBy(*row).agg(F.max(F.struct("stamp", F.coalesce("parent_kind", F.lit("")).alias("k"), F.coalesce("parent_id", F.lit("")).alias("r"))).alias("p")).select(*row, "p.*")
    last = graph.checkpointed(last.select(name("kind", "row_id").alias("node"), F.when(F.col("r") != "", name("k", "r")).alias("above"), *row))
    there = graph.reachable(last.filter("above IS NOT NULL"), last.filter("above IS NULL").select("node"), "above", "node").select("node", F.lit(True).alias("there"))
    known = last.join(there, "node", "left").select(*row, "there")
    status = F.when(~F.col("alive"), "gone").when(F.col("there"), "applied").otherwise("waiting")
    units = judged.join(known, row, "left").select(*row, "unit", "stamp", "value", status.alias("status"))
    return units.unionByName(graves.select(*row, F.lit("deleted").alias("unit"), F.col("tomb_stamp").alias("stamp"), F.lit(None).cast("string").alias("value"), F.lit("gone").alias("status")))


def coverage(shown: DataFrame, origin=None) -> DataFrame:
    """(origin, held): of each origin the last stamp below which nothing waits. The origin is the stamp's end, from its 17th character on."""
    rows = shown.withColumn("origin", F.substr("stamp", F.lit(17)) if origin is None else origin)
    return changes.version_vector(rows.filter("status <> 'waiting'"), rows.filter("status = 'waiting'"), "origin", "stamp")
