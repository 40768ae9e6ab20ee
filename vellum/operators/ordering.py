"""Orderings, pages, seeks and positions.

Defined results: undated rows come last both ways, and null order columns last in positions; rows that tie on all order columns have adjacent positions in no fixed order, so orders end with
a unique column; a null anchor date is after all dated rows; offsets and limits under 0 count as 0; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def order_by(ordering: str, taken: str, added: str, row_id: str) -> list[Column]:
    """taken_asc, taken_desc, added_asc or added_desc; undated rows come last both ways, ids follow the direction."""
    kind, way = ordering.split("_")
    if kind == "added":
        return [F.col(c).asc() if way == "asc" else F.col(c).desc() for c in (added, row_id)]
    return [F.col(taken).asc_nulls_last(), F.col(row_id).asc()] if way == "asc" else [F.col(taken).desc_nulls_last(), F.col(row_id).desc()]


def ranked_by(column: Column, order: list, default: int | None = None) -> Column:
    """A sort key by place in a list: kinds that depend on each other, or an ordering that a row's own value names."""
    out = F.lit(len(order) if default is None else default)
    for i, v in reversed(list(enumerate(order))):
        out = F.when(column == v, i).otherwise(out)
    return out


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 100, most: int = 500) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, most)))


def seek(rows: DataFrame, taken: str, row_id: str, anchor: tuple, forward: bool = True, limit: int = 1) -> DataFrame:
    """The rows next to an anchor (taken, id) in the order of taken with undated rows last, found by a filter and a top-n."""
    t, i = F.col(taken), F.col(row_id)
    at, of = anchor
    if at is None:
        ahead, behind = t.isNull() & (i > of), t.isNotNull() | (i < of)
    else:
        at = F.lit(at)
        ahead, behind = t.isNull() | (t > at) | ((t == at) & (i > of)), (t < at) | ((t == at) & (i < of))
    if forward:
        return rows.filter(ahead).orderBy(t.asc_nulls_last(), i.asc()).limit(limit)
    return rows.filter(behind).orderBy(t.desc_nulls_first(), i.desc()).limit(limit)


def positions(rows: DataFrame, order: list[str], name: str = "position", buckets: int | None = None) -> DataFrame:
    """Places from 0 in a total order over all rows, without bringing them into one task: rows are dealt by range (into ``buckets``, else as many as the session
    shuffles into), sorted and numbered inside a range, and moved by the counts of the ranges before. ``order`` columns ascend with nulls last; end it with a unique one."""
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = rows.repartitionByRange(buckets, *keys) if buckets else rows.repartitionByRange(*keys)
    # written down, because a second sampling of the ranges could deal the rows otherwise; an id has its partition from bit 33 on, and its place in the partition below
    numbered = checkpointed(ranged.sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    local = numbered.withColumns({"__part": F.shiftright("__id", 33), "__local": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("__id")
    counts = local.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return local.join(before, "__part").withColumn(name, (F.col("__before") + F.col("__local") - 1).cast("long")).drop("__part", "__local", "__before")


def at_positions(numbered: DataFrame, ranges: list[tuple[int, int]], position: str = "position") -> DataFrame:
    """Rows in any of the inclusive ranges of places."""
    hit = F.lit(False)
    for a, b in ranges:
        hit = hit | F.col(position).between(a, b)
    return numbered.filter(hit)


def between_anchors(rows: DataFrame, taken: str, row_id: str, first: tuple | None, last: tuple | None, most: int = 1000) -> DataFrame:
    """Up to ``most`` rows from one anchor (taken, id) to another, both included, undated rows last. Without a first anchor the rows that end at the last one are taken, and
    given in the order all the same."""
    t, i = F.col(taken), F.col(row_id)

    def side(anchor, up):
        at, of = anchor
        if at is None:
            return (t.isNull() & (i >= of)) if up else (t.isNotNull() | (i <= of))
        at = F.lit(at)
        return (t.isNull() | (t > at) | ((t == at) & (i >= of))) if up else ((t < at) | ((t == at) & (i <= of)))

    kept = rows if first is None else rows.filter(side(first, True))
    kept = kept if last is None else kept.filter(side(last, False))
    if first is None and last is not None:
        kept = kept.orderBy(t.desc_nulls_first(), i.desc()).limit(most)
        return kept.orderBy(t.asc_nulls_last(), i.asc())
    return kept.orderBy(t.asc_nulls_last(), i.asc()).limit(most)


def rebase(selection: DataFrame, samples: DataFrame, domain: DataFrame) -> DataFrame:
    """A selection of inclusive ranges (start, end) after rows moved, as positions: inside the domain (start, end) a selected position goes where its sample (was, now) went,
    and one without a sample is dropped, as is what lies outside."""
    return _inside(_inside(samples, "was", selection), "was", domain).select(F.col("now").alias("position")).distinct()


def _inside(rows: DataFrame, position: str, ranges: DataFrame, block: int = 1024) -> DataFrame:
    """Rows whose position lies in any of the inclusive ranges (start, end): an equi join by block of positions, for which ranges are cut at blocks."""
    number = lambda c: F.floor(F.col(c) / block)
    cut = ranges.select("start", "end", F.explode(F.sequence(number("start"), number("end"))).alias("__block"))
    return rows.withColumn("__block", number(position)).join(cut, (rows[position] >= cut["start"]) & (rows[position] <= cut["end"]) & (F.floor(rows[position] / block) == cut["__block"]), "left_semi").drop("__block")


def merge_ranges(ranges: DataFrame, start: str = "start", end: str = "end", by: list[str] | None = None) -> DataFrame:
    """Overlapping or adjoining inclusive ranges as one. Ranges of one ``by`` meet in a task; without ``by`` they all do, so that is for a reader's selection."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    grouped = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")
