"""Two-dimensional stencils over pictures that are kept as square tiles.

A tile's row carries ``side`` x ``side`` values. Each tile sends the borders that its neighbours need (edges and corners, ``halo`` wide), a tile puts at most nine pieces together, and one vectorised kernel runs over the padded
square. What a task holds is one tile with its halo, whatever the picture's size, and the kernel may be any function of a neighbourhood, separable or not.

Defined results: places without a pixel, outside the picture too, are NaN to the kernel and have no pixel in the result; null and NaN values are such places; of several values at one place the least counts; negative places are allowed;
a halo wider than a tile is an error; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_tiles(pixels: DataFrame, side: int = 256, picture: str = "picture", y: str = "y", x: str = "x", value: str = "value") -> DataFrame:
    """(picture, ty, tx, values): row by row, null where there is no pixel."""
    place = F.pmod(F.col(y), F.lit(side)) * side + F.pmod(F.col(x), F.lit(side))
    one = pixels.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(picture, y, x).agg(F.min(F.col(value).cast("double")).alias("v"))
    tiles = one.groupBy(F.col(picture).alias("picture"), F.floor(F.col(y) / side).alias("ty"), F.floor(F.col(x) / side).alias("tx")).agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("k"), F.col("v")))).alias("m"))
    return tiles.select("picture", "ty", "tx", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.try_element_at("m", i)).alias("values"))


def to_pixels(tiles: DataFrame, side: int = 256) -> DataFrame:
    """(picture, y, x, value) of the places that have a value."""
    each = tiles.select("picture", "ty", "tx", F.posexplode("values").alias("i", "value")).filter("value IS NOT NULL")
    return each.select("picture", (F.col("ty") * side + F.floor(F.col("i") / side)).alias("y"), (F.col("tx") * side + F.col("i") % side).alias("x"), "value")


def with_halos(tiles: DataFrame, side: int, halo: int) -> DataFrame:
    """(picture, ty, tx, pieces): of each tile itself and what its neighbours sent, as (dy, dx, piece): the side they lie on."""
    if not 0 <= halo <= side:
        raise ValueError("a halo can't be wider than a tile")

    def piece(dy: int, dx: int):
        """What the neighbour at (dy, dx) gets of this tile: its far border on that side."""
        span = lambda d: (0, side) if d == 0 else (side - halo, halo) if d > 0 else (0, halo)
        (y, rows), (x, cols) = span(dy), span(dx)
        return F.flatten(F.transform(F.sequence(F.lit(y), F.lit(y + rows - 1)), lambda r: F.slice("values", r * side + x + 1, F.lit(cols))))

    sent = [F.struct((F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"), F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), (F.col("values") if not (dy or dx) else piece(dy, dx)).alias("piece")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if halo or not (dy or dx)]
    each = tiles.select("picture", F.explode(F.array(*sent)).alias("s")).select("picture", "s.*")
    whole = each.groupBy("picture", "ty", "tx").agg(F.collect_list(F.struct("dy", "dx", "piece")).alias("pieces"))
    return whole.filter(F.exists("pieces", lambda p: (p["dy"] == 0) & (p["dx"] == 0)))


def stencil(tiles: DataFrame, kernel: Callable[[np.ndarray, int], np.ndarray], side: int = 256, halo: int = 1) -> DataFrame:
    """The tiles with ``kernel(padded, halo)`` in place of their values, where they had one: ``padded`` is a square of ``side + 2 * halo``, its result one of ``side``."""
    kind = tiles.schema["picture"].dataType.simpleString()

    def run(batches):
        span = {-1: slice(0, halo), 0: slice(halo, halo + side), 1: slice(halo + side, None)}
        for batch in batches:
            for at in range(batch.num_rows):  # one tile at a time is in memory as a square
                row = batch.slice(at, 1)
                padded = np.full((side + 2 * halo, side + 2 * halo), np.nan)
                pieces = row.column(3).flatten()
                for dy, dx, piece in zip(pieces.field(0).to_pylist(), pieces.field(1).to_pylist(), pieces.field(2)):
                    where = padded[span[dy], span[dx]]
                    where[...] = piece.values.to_numpy(zero_copy_only=False).reshape(where.shape)
                own = padded[span[0], span[0]]
                out = np.where(np.isnan(own), np.nan, kernel(padded, halo)).ravel()
                values = pa.ListArray.from_arrays(pa.array([0, out.size], pa.int32()), pa.array(out, pa.float64(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), row.column(2), values], names=["picture", "ty", "tx", "values"])

    return with_halos(tiles, side, halo).mapInArrow(run, f"picture {kind}, ty long, tx long, values array<double>")


def windows(padded: np.ndarray, halo: int) -> np.ndarray:
    """The neighbourhoods of all places: (side, side, (2 * halo + 1) squared)."""
    width = 2 * halo + 1
    view = np.lib.stride_tricks.sliding_window_view(padded, (width, width))
    return view.reshape(*view.shape[:2], width * width)


def median(padded: np.ndarray, halo: int) -> np.ndarray:
    """The median of the pixels of a neighbourhood; no separable filter gives it."""
    return np.nanmedian(windows(padded, halo), axis=2) if padded.size else padded


def range_of(padded: np.ndarray, halo: int) -> np.ndarray:
    """Largest less least of a neighbourhood."""
    all_of = windows(padded, halo)
    return np.nanmax(all_of, axis=2) - np.nanmin(all_of, axis=2)
