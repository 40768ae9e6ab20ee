"""Runs over ordered rows: gap splits, brackets, representatives, budgets and ranks.

Defined results: null groups are one group; rows with a null place come first and break no run; ties stand in the order of the columns given; null sizes add nothing; one row
alone has rank level 0; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_runs(rows: DataFrame, by: list[str], at: Column, order: list[str], gap: float, name: str = "run") -> DataFrame:
    """Numbers runs from 1 in each group (null is one); a gap of exactly ``gap`` continues a run."""
    w = Window.partitionBy(*by).orderBy(*order)
    broken = F.when(at - F.lag(at).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("__broken", broken).withColumn(name, F.sum("__broken").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("__broken")


def brackets(rows: DataFrame, by: list[str], at: Column, index: str, count: str, group: str, row_id: str, gap: float) -> DataFrame:
    """Complete bracket runs: in each lane, ordered by time, index and id, a run goes on while the index rises by one, group and count
    stay, and the gap is at most ``gap``; runs of two or more that begin at 1 and, where the count is known, reach it, are kept with
    the lane's run number as ``bracket``. An index past the count begins a run anew."""
    w = Window.partitionBy(*by).orderBy(at, F.coalesce(F.col(index), F.lit(0)), F.col(row_id))
    was = lambda c: F.lag(c).over(w)
    follows = (F.col(index) == was(index) + 1) | (F.col(index).isNull() & was(index).isNull())
    same = F.col(group).eqNullSafe(was(group)) & F.col(count).eqNullSafe(was(count))
    goes_on = follows & same & (at - was(at) <= gap) & (F.col(count).isNull() | F.col(index).isNull() | (F.col(index) <= F.col(count)))
    marked = rows.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("bracket", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    one = Window.partitionBy(*by, "bracket")
    n, first, known = F.count("*").over(one), F.min(index).over(one), F.max(count).over(one)
    return runs.withColumns({"__n": n, "__first": first, "__known": known}).filter("__n >= 2 AND __first = 1 AND (__known IS NULL OR __n = __known)").drop("__n", "__first", "__known")


def representative(rows: DataFrame, by: list[str], order: list[Column], name: str | None = None) -> DataFrame:
    """One row a group, the first in the order; or, with ``name``, all rows with a flag."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if name:
        return rows.withColumn(name, place == 1)
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def within_budget(rows: DataFrame, size: str, order: list[Column], budget: float, by: list[str] | None = None) -> DataFrame:
    """Rows whose running size, in the order, is still within the budget."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= budget)


def to_evict(rows: DataFrame, size: str, order: list[Column], by: list[str], budget: float) -> DataFrame:
    """Least used first: the rows to drop until what is left of each group fits the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.sum(size).over(w), F.lit(0))
    total = F.sum(size).over(Window.partitionBy(*by))
    return rows.withColumn("__left", total - freed).filter(F.col("__left") > budget).drop("__left")


def keep_newest(rows: DataFrame, by: list[str], order: list[Column], size: str, budget: float) -> DataFrame:
    """The newest row of each group always, and those after it while their running size fits."""
    w = Window.partitionBy(*by).orderBy(*order)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"__place": F.row_number().over(w), "__running": running}).filter((F.col("__place") == 1) | (F.col("__running") <= budget)).drop("__place", "__running")


def rank_to_255(value: str, by: list[str]) -> Column:
    """Ranks with ties averaged, over 0 to 255, halves away from zero."""
    w = Window.partitionBy(*by)
    least = F.rank().over(w.orderBy(value)) - 1
    ties, n = F.count("*").over(Window.partitionBy(*by, value)), F.count("*").over(w)
    return F.when(n > 1, F.floor((least + (ties - 1) / 2) / (n - 1) * 255 + 0.5).cast("int")).otherwise(0)


def visible_size(by: list[str], visible: Column) -> Column:
    return F.sum(visible.cast("long")).over(Window.partitionBy(*by))
