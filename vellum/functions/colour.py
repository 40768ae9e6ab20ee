"""Transfer curves, matrices and sizes as column expressions.

Defined results: null in, null out, and NaN stays NaN; curves are for values from 0 on; sizes are at least 1 by 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published curves (sRGB, Rec. 709, ST 2084 and ARIB STD-B67).
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def rec709_to_linear(v: Column) -> Column:
    return F.when(v < 0.081, v / 4.5).otherwise(F.pow((v + 0.099) / 1.099, F.lit(1 / 0.45)))


def gamma_to_linear(v: Column, gamma: float) -> Column:
    return F.pow(F.greatest(v, F.lit(0.0)), F.lit(gamma))


def pq_to_linear(v: Column) -> Column:
    p = F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / PQ_M2))
    return F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (PQ_C2 - PQ_C3 * p), F.lit(1 / PQ_M1))


def linear_to_pq(v: Column) -> Column:
    p = F.pow(F.greatest(v, F.lit(0.0)), F.lit(PQ_M1))
    return F.pow((PQ_C1 + PQ_C2 * p) / (1 + PQ_C3 * p), F.lit(PQ_M2))


def hlg_to_linear(v: Column) -> Column:
    return F.when(v <= 0.5, v * v / 3).otherwise((F.exp((v - HLG_C) / HLG_A) + HLG_B) / 12)


def matrix3(m: list[list[float]], x: Column, y: Column, z: Column) -> list[Column]:
    return [x * row[0] + y * row[1] + z * row[2] for row in m]


def round_half_up(v: Column) -> Column:
    """Halves toward positive infinity, also below zero."""
    return F.floor(v + 0.5)


def piecewise_linear(v: Column, anchors: list[tuple[float, float]]) -> Column:
    """Clamped linear interpolation over (x, y) anchors."""
    out = F.lit(float(anchors[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors, anchors[1:]))):
        out = F.when(v <= x1, F.lit(float(y0)) + (v - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(v <= anchors[0][0], F.lit(float(anchors[0][1]))).otherwise(out)


def display_size(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column, quarter_turns: Column) -> tuple[Column, Column]:
    """Size after a crop in shares of the canvas and quarter turns; at least 1 by 1."""
    w = F.greatest(F.lit(1), round_half_up(width * (right - left)))
    h = F.greatest(F.lit(1), round_half_up(height * (bottom - top)))
    turned = F.pmod(quarter_turns, F.lit(2)) == 1
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
