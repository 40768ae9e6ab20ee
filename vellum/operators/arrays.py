"""Numeric patterns: binned quantiles, least squares, stencils over tiles, and tables of values.

Defined results: null values are left out everywhere, and NaN out of rank selection (in histograms it counts in the first bin); values beyond the span count in the end bins; a group without values has no
row; a rank beyond the last gives None; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned_quantile(rows: DataFrame, value: Column, low: float, high: float, bins: int, share: float, by: list[str] | None = None) -> DataFrame:
    """The lower edge of the bin in which the running count reaches ``share``; values outside the span go to the end bins. One map-side aggregation, whatever the number of rows."""
    by = by or []
    width = (high - low) / bins
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - low) / width)))
    counts = rows.filter(value.isNotNull()).groupBy(*by, at.alias("__bin")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    run = F.sum("__n").over(w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__n").over(w)
    hit = counts.withColumn("__hit", run >= total * share).filter("__hit")
    if by:
        return hit.groupBy(*by).agg((F.min("__bin") * width + low).alias("quantile"))
    return hit.agg((F.min("__bin") * width + low).alias("quantile"))


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - low) / ((high - low) / bins)))).cast("int")
    return rows.filter(value.isNotNull()).groupBy(*(by or []), at.alias("bin")).agg(F.count("*").alias("n"))


def normal_equations(rows: DataFrame, features: list[Column], target: Column) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y in one aggregation; only the small matrix reaches the driver."""
    k = len(features)
    sums = [F.sum(features[i] * features[j]) for i in range(k) for j in range(i, k)] + [F.sum(f * target) for f in features]
    got = [float(v or 0) for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = got[: k * (k + 1) // 2]
    return a + np.triu(a, 1).T, np.array(got[k * (k + 1) // 2 :])


def least_squares(rows: DataFrame, features: list[Column], target: Column, ridge: float = 0.0) -> np.ndarray:
    a, b = normal_equations(rows, features, target)
    return np.linalg.solve(a + ridge * np.eye(len(b)), b)


def moving(value: str, by: list[str], order: list[str], weights: list[float]) -> Column:
    """A centred one-dimensional stencil along an order; ends repeat the edge value. Two of them, along either axis, are a separable one."""
    w = Window.partitionBy(*by).orderBy(*order)
    half = len(weights) // 2
    edge_low, edge_high = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = F.lit(0.0)
    for j, weight in enumerate(weights):
        shift = j - half
        v = F.col(value) if shift == 0 else F.coalesce(F.lead(value, shift).over(w), edge_high) if shift > 0 else F.coalesce(F.lag(value, -shift).over(w), edge_low)
        out = out + v * weight
    return out


def interpolated(v: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation in a small table, flat beyond its ends."""
    from ..functions.colour import piecewise_linear

    return piecewise_linear(v, list(zip(xs, ys)))


def rank_select(rows: DataFrame, value: Column, rank: int, low: float, high: float, bins: int = 1024, rounds: int = 3) -> float | None:
    """The value at a rank (from 0) without a sort: a histogram finds the bin that holds it, and the bin is refined. What is left after the rounds, if it still has
    different values, is told apart by counts of equal values. Only counts of at most ``bins`` bins reach the driver at once."""
    rows = rows.select(value.cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    below, at = F.lit(True), rank
    for _ in range(rounds):
        width = (high - low) / bins
        if width <= 0:
            break
        number = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / width)))
        counts = rows.filter(below).groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("b").collect()
        for c in counts:
            if at < c["n"]:
                low, high = c["least"], c["most"]
                break
            at -= c["n"]
        else:
            return None
        below = F.col("v").between(low, high)
        if low == high:
            return low
    equal = rows.filter(below).groupBy("v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hit = equal.withColumn("upto", F.sum("n").over(w)).filter(F.col("upto") > at).agg(F.min("v")).first()[0]
    return hit


def tiles(rows: DataFrame, x: str, y: str, size: int, measures: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Reduces a grid of rows to tiles of ``size`` by ``size``; again with the result's tile_x, tile_y for a pyramid."""
    return rows.groupBy(*(by or []), F.floor(F.col(x) / size).alias("tile_x"), F.floor(F.col(y) / size).alias("tile_y")).agg(*[c.alias(n) for n, c in measures.items()])


def largest_rectangle(rows: DataFrame, by: list[str], x: str, y: str, filled: str) -> DataFrame:
    """The largest all-filled axis-aligned rectangle of each group's grid: left, top, width, height, area (ties: topmost, then leftmost; all 0 where nothing is filled).
    A group is one picture's mask; only its filled cells are held, so cells far apart cost no more than others. Repeated cells count once."""
    import pandas as pd

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        hit = pdf[pdf[filled].fillna(False).astype(bool)].drop_duplicates([x, y])
        best, tall, above = (0, 0, 0, 0, 0), {}, None
        for row, cells in hit.sort_values([y, x]).groupby(y)[x]:
            cols = cells.tolist()
            tall = {c: (tall.get(c, 0) if above is not None and row == above + 1 else 0) + 1 for c in cols}
            above = row
            stack: list[tuple[int, int]] = []  # (first column, height), of columns that touch
            last = None
            for col in [*cols, None]:
                if stack and (col is None or col != last + 1):
                    end = last + 1
                    while stack:
                        start, up = stack.pop()
                        best = max(best, (up * (end - start), -(row - up + 1), -start, end - start, up))
                if col is None:
                    break
                start = col
                while stack and stack[-1][1] >= tall[col]:
                    start, up = stack.pop()
                    best = max(best, (up * (col - start), -(row - up + 1), -start, col - start, up))
                stack.append((start, tall[col]))
                last = col
        area, top, left, width, height = best
        return pdf[by].head(1).assign(left=-left, top=-top, width=width, height=height, area=area)

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", left long, top long, width long, height long, area long"
    return rows.select(*by, x, y, filled).groupBy(*by).applyInPandas(search, schema)
