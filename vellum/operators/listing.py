"""Listings: filtered, ordered, paged rows with stack collapse, totals, facets and day counts.

Defined results: rows whose group is null stand for themselves; null facet values are left out and null days are a day of their own; a null measure isn't met; repeated rows count each; an
empty table gives no rows, and totals of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering
from .filters import Conditions


def list_rows(rows: DataFrame, conditions: Conditions, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """Filter, then a distributed top-n; no window, no full sort."""
    return ordering.page(rows.filter(conditions.column()), order, offset, limit)


def collapse(rows: DataFrame, group: str, order: list[Column], single: Column, size: str = "group_size") -> DataFrame:
    """One row a group, the first in the order, with the number of its rows; rows without a group stand for themselves."""
    key = F.struct(F.col(group), F.when(F.col(group).isNull(), single))
    w = Window.partitionBy("__key")
    out = rows.withColumn("__key", key).withColumns({size: F.count("*").over(w), "__place": F.row_number().over(w.orderBy(*order))})
    return out.filter("__place = 1").drop("__place", "__key")


def totals(rows: DataFrame, conditions: Conditions, group: str) -> DataFrame:
    """Members and entries (groups once, rows without one each) in one pass."""
    return rows.filter(conditions.column()).agg(F.count("*").alias("members"), (F.count_distinct(group) + F.count_if(F.col(group).isNull())).alias("entries"))


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) of each column, in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))


def per_day(rows: DataFrame, moment: Column) -> DataFrame:
    return rows.groupBy(F.date_format(moment, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, measures: dict[str, Column], by: list[str]) -> DataFrame:
    """How many rows meet each measure, nulls as not met, in one aggregation."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in measures.items()])
