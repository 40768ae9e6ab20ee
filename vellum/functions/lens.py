"""Radial lens corrections as column expressions: knots evenly spaced from the centre to the corner, read linearly, in parts of ``UNIT``.

Defined results: no knots displace nothing; null knots, radii or sizes give null; radii beyond the ends are the ends'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the displacement that a knot of 1 stands for is one part in so many.
UNIT = 16384.0


def knots_of(k1: Column, k2: Column, count: int) -> Column:
    """A polynomial ``k1 r^2 + k2 r^4`` as ``count`` knots, rounded half away from 0."""

    def knot(i):
        r2 = (i / float(count - 1)) * (i / float(count - 1))
        v = (k1 * r2 + k2 * r2 * r2) * UNIT
        return F.signum(v) * F.floor(F.abs(v) + 0.5) + 0.0  # no negative zero

    return F.when(k1.isNotNull() & k2.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(count - 1)), knot))


def displacement(knots: Column, radius: Column) -> Column:
    """The fraction of its radius by which a point at ``radius`` (1 at the corner) moves."""
    last = F.size(knots) - 1
    place = F.greatest(F.least(radius * last, last.cast("double")), F.lit(0.0))
    at = F.floor(place).cast("int")
    here, after = F.get(knots, at), F.get(knots, F.least(at + 1, last))
    return F.when(F.size(knots) == 0, F.lit(0.0)).when(radius.isNotNull(), (here + (after - here) * (place - at)) / UNIT)


def source_radius(knots: Column, radius: Column, crop: Column, channel: Column | None = None) -> Column:
    """The radius that a pixel at ``radius`` is read from, under a crop and, where given, a channel's own knots besides."""
    own = F.lit(1.0) if channel is None else 1 + displacement(channel, radius)
    return crop * radius * (1 + displacement(knots, radius)) * own


def filling_crop(knots: Column, width: Column, height: Column, between: int = 32) -> Column:
    """The largest crop, 1 at most, under which no ray to the frame's edge reads from outside it: each radius from the short edge on must hold the farthest
    reach up to it. Radii are the knots, ``between`` steps for each, and the short edge; a crop under 1 is a hundred-thousandth tighter, against rounding."""
    half = F.sqrt((width / 2.0) * (width / 2.0) + (height / 2.0) * (height / 2.0))
    edge = F.least(width, height) / 2.0 / half
    steps = (F.greatest(F.size(knots), F.lit(2)) - 1) * between
    radii = F.array_sort(F.concat(F.transform(F.sequence(F.lit(0), steps), lambda i: i / steps.cast("double")), F.array(edge)))

    def widen(acc, r):
        reach = F.greatest(acc["reach"], source_radius(knots, r, F.lit(1.0)))
        fits = F.when((r >= edge) & (reach > 0), F.least(acc["crop"], r / reach)).otherwise(acc["crop"])
        return F.struct(reach.alias("reach"), fits.alias("crop"))

    start = F.struct(F.lit(0.0).alias("reach"), F.lit(1.0).alias("crop"))
    crop = F.aggregate(radii, start, widen, lambda acc: F.when(acc["crop"] < 1, acc["crop"] * (1 - 1e-5)).otherwise(acc["crop"]))
    return F.when(knots.isNotNull() & half.isNotNull(), crop)
