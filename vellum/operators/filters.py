"""Predicates of a listing: scope clauses always hold together; chips hold together or one of them, as asked.

Defined results: a null field matches no search, no list and no day unless ``or_null`` says so; row-value comparisons are unknown where the field that decides is null; ``having_all`` counts
repeated tags once; no conditions keep all rows; repeated rows are kept each; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(pattern: str, *columns: Column) -> Column:
    """Contains, ignoring case, in any of the columns; % and _ in the pattern stay wildcards."""
    return reduce(or_, (F.coalesce(c.ilike(f"%{pattern}%"), F.lit(False)) for c in columns))


def between_days(moment: Column, first: str | None, last: str | None) -> Column:
    """From the first day to the end of the last, either of which may be open."""
    out = F.lit(True)
    if first is not None:
        out = out & (moment >= F.lit(first).cast("timestamp"))
    if last is not None:
        out = out & (moment < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))
    return out


def one_of_or_null(column: Column, values: Sequence, or_null: bool) -> Column:
    """In the values, or null where null stands for a choice of its own."""
    found = F.coalesce(column.isin(*values), F.lit(False)) if values else F.lit(False)
    return found | column.isNull() if or_null else found


def rated(rating: Column, wanted: bool) -> Column:
    return (rating > 0) if wanted else (rating == 0)


def after(columns: Sequence[Column], values: Sequence) -> Column:
    """Row-value comparison (a, b, ...) > (values), unknown where a field that decides is null."""
    out = F.lit(False)
    for c, v in reversed(list(zip(columns, values))):
        out = (c > F.lit(v)) | ((c == F.lit(v)) & out)
    return out


@dataclass
class Conditions:
    """``scope`` clauses are joined by AND; ``chips`` by AND, or by OR where ``match`` is any and there is more than one."""

    scope: list[Column] = field(default_factory=list)
    chips: list[Column] = field(default_factory=list)
    match: str = "all"

    def column(self) -> Column:
        clauses = list(self.scope)
        if self.chips:
            clauses.append(reduce(or_ if self.match == "any" else and_, self.chips))
        return reduce(and_, clauses) if clauses else F.lit(True)


def having_all(rows: DataFrame, tags: DataFrame, wanted: Sequence, row_id: str, tag_row: str, tag: str) -> DataFrame:
    """Rows that carry all of the wanted tags: one count for each row instead of a semi join for each tag."""
    wanted = list(dict.fromkeys(wanted))
    carry = tags.filter(F.col(tag).isin(*wanted)).groupBy(tag_row).agg(F.count_distinct(tag).alias("__n")).filter(F.col("__n") == len(wanted))
    return rows.join(carry.select(F.col(tag_row).alias(row_id)), row_id, "left_semi")


def not_in(rows: DataFrame, column: str, banned: DataFrame, banned_column: str) -> DataFrame:
    """NOT IN with nulls in the list left aside, and rows without a value kept."""
    return rows.join(banned.select(F.col(banned_column).alias(column)).filter(F.col(column).isNotNull()).distinct(), column, "left_anti")
