"""Picture descriptors: rank-normalised cell grids of two views, and how alike two of them are.

Cell means, grey-world chromaticity and ranks are aggregations and windows by picture; a pair is compared with a few array operations in a Pandas function.

Defined results: pictures without pixels have no descriptor; a picture with one value everywhere has its middle level in all cells; descriptors that are null or of another
size are alike by 0; repeated pixels count twice; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Luma weights, the closer view's share of the extent, the share of cells that a distance is taken over, and how much of a score colour makes.
LUMA = (0.2126, 0.7152, 0.0722)
CLOSER_VIEW, AGREEING_CELLS, COLOUR_PART = 0.78, 0.75, 0.3


def cell(at: Column, extent: int, crop: float, side: int) -> Column:
    """The cell of a place along one axis, in the centred view that has ``crop`` of the extent; null outside."""
    width = max(1, int(extent * crop))
    first = (extent - int(extent * crop)) // 2
    return F.when(at.between(first, first + width - 1), F.floor((at - first) * side / width).cast("int"))


def cell_means(pixels: DataFrame, by: list[str], width: int, height: int, side: int, crops: tuple[float, ...] = (1.0, CLOSER_VIEW)) -> DataFrame:
    """(by, view, cell, r, g, b): channel means of each cell of a grid of ``side`` by ``side``, of ``pixels`` (by, x, y, r, g, b). Views are counted in one pass."""
    views = F.array(*(F.struct(F.lit(i).alias("view"), cell(F.col("x"), width, c, side).alias("cx"), cell(F.col("y"), height, c, side).alias("cy")) for i, c in enumerate(crops)))
    placed = pixels.select(*by, "r", "g", "b", F.inline(views)).filter("cx IS NOT NULL AND cy IS NOT NULL")
    return placed.groupBy(*by, "view", (F.col("cy") * side + F.col("cx")).alias("cell")).agg(*(F.avg(c).alias(c) for c in "rgb"))


def levels(values: DataFrame, by: list[str], value: str, scale: float) -> DataFrame:
    """Adds ``level``: the rank, 0 to 255, of the value rounded at ``scale``; ties share the mean of their ranks, so that any monotone curve leaves levels alone."""
    rounded = values.withColumn("__v", F.round(F.col(value) * scale))
    w, ties = Window.partitionBy(*by), F.count("*").over(Window.partitionBy(*by, "__v"))
    last = F.greatest(F.count("*").over(w) - 1, F.lit(1))
    rank = F.rank().over(w.orderBy("__v")) - 1 + (ties - 1) / 2
    return rounded.withColumn("level", F.round(rank / last * 255).cast("int")).drop("__v")


def descriptors(pixels: DataFrame, by: list[str], width: int, height: int, side: int) -> DataFrame:
    """(by, descriptor): for each view the levels of the coarse luma (2 by 2 cells), the luma, and the two chromaticities, by cell, as one array of shorts."""
    fine = cell_means(pixels, by, width, height, side)
    luma = sum(w * F.col(c) for w, c in zip(LUMA, "rgb"))
    whole = Window.partitionBy(*by, "view")
    world = {c: F.col(c) / F.greatest(F.avg(c).over(whole), F.lit(1e-6)) for c in "rgb"}
    total = F.greatest(sum(world.values()), F.lit(1e-6))
    grids = fine.select(*by, "view", "cell", luma.alias("luma"), (world["r"] / total * 255).alias("red"), (world["g"] / total * 255).alias("green"))
    long = grids.select(*by, "view", "cell", F.inline(F.array(*(F.struct(F.lit(i).alias("grid"), F.col(c).alias("value")) for i, c in enumerate(("luma", "red", "green"), 1)))))
    half = ((F.col("cell") / side / 2).cast("int") * (side // 2) + (F.pmod("cell", F.lit(side)) / 2).cast("int")).cast("int")
    coarse = grids.groupBy(*by, "view", half.alias("cell")).agg(F.avg("luma").alias("value")).withColumn("grid", F.lit(0))
    ranked = levels(long.unionByName(coarse), [*by, "view", "grid"], "value", 1.0)
    place = F.struct("view", "grid", "cell", F.col("level").cast("short").alias("level"))
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(place)), lambda p: p["level"]).alias("descriptor"))


def _windows(grid: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(grid, (size, size))


def alike(a: np.ndarray, b: np.ndarray, side: int, window: int) -> float:
    """How alike two descriptors are, 0 to 1: the best of whole with whole and whole with either's crop, and of either as the one that moves. The shift is found on
    the coarse luma (no shift wins a tie) and judged once on the others, by the best-agreeing cells."""
    half, cells = side // 2, side * side
    view = half * half + 3 * cells
    if a is None or b is None or len(a) != 2 * view or len(b) != 2 * view:
        return 0.0
    coarse_window = window // 2

    def grids(d, v):
        d = np.asarray(d, np.int32)[v * view : (v + 1) * view]
        return d[: half * half].reshape(half, half), d[half * half :].reshape(3, side, side)

    def shifted(x, y):
        pad, coarse_pad = (side - window) // 2, (half - coarse_window) // 2
        centre = x[0][coarse_pad : coarse_pad + coarse_window, coarse_pad : coarse_pad + coarse_window]
        far = np.abs(_windows(y[0], coarse_window)[: 2 * coarse_pad + 1, : 2 * coarse_pad + 1] - centre).sum(axis=(2, 3))
        oy, ox = np.unravel_index(np.argmin(far), far.shape) if far.min() < far[coarse_pad, coarse_pad] else (coarse_pad, coarse_pad)
        kept = max(1, int(window * window * AGREEING_CELLS))
        parts = [np.sort(np.abs(p[pad : pad + window, pad : pad + window] - q[2 * oy : 2 * oy + window, 2 * ox : 2 * ox + window]).ravel())[:kept].sum() / kept / 255 for p, q in zip(x[1], y[1])]
        return (1 - COLOUR_PART) * (1 - 3 * parts[0]) + COLOUR_PART * (1 - 1.5 * (parts[1] + parts[2]))

    pairs = [(grids(a, i), grids(b, j)) for i, j in ((0, 0), (0, 1), (1, 0))]
    return float(np.clip(max(max(shifted(x, y), shifted(y, x)) for x, y in pairs), 0, 1))


def similarity(pairs: DataFrame, a: str, b: str, side: int, window: int) -> DataFrame:
    """Adds ``similarity`` of two descriptor columns of a pair."""

    @F.pandas_udf("double")
    def judge(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([alike(p, q, side, window) for p, q in zip(x, y)])

    return pairs.withColumn("similarity", judge(a, b))
