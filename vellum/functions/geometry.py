"""Projections between a composed canvas, rays and sources, 3 x 3 inverses and illuminants, as column expressions. Null in, null out; what a projection can't hold is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canvas_to_ray(projection: Column, x: Column, y: Column, cx: Column, cy: Column, radians_per_pixel: Column) -> Column:
    """The ray (x right, y down, z forward) that a canvas pixel looks along: rectilinear, cylindrical or equirectangular; not normalised."""
    u, v, one = (x - cx) * radians_per_pixel, (y - cy) * radians_per_pixel, F.lit(1.0)
    return (
        F.when(projection == "rectilinear", F.array(u, v, one))
        .when(projection == "cylindrical", F.array(F.sin(u), v, F.cos(u)))
        .when(projection == "equirectangular", F.array(F.sin(u) * F.cos(v), F.sin(v), F.cos(u) * F.cos(v)))
    )


def ray_to_canvas(projection: Column, ray: Column, cx: Column, cy: Column, radians_per_pixel: Column, least: float = 1e-9) -> Column:
    """Where a ray lands on the canvas, as (x, y), or null: behind a plane, or along a cylinder's axis."""
    x, y, z = (ray[i] for i in range(3))
    flat = F.sqrt(x * x + z * z)
    place = lambda u, v: F.array(cx + u / radians_per_pixel, cy + v / radians_per_pixel)
    return (
        F.when((projection == "rectilinear") & (z > least), place(x / z, y / z))
        .when((projection == "cylindrical") & (flat > least), place(F.atan2(x, z), y / flat))
        .when(projection == "equirectangular", place(F.atan2(x, z), F.atan2(y, flat)))
    )


def rotate_back(rotation: Column, ray: Column) -> Column:
    """A ray in the frame of a camera with a unit quaternion (x, y, z, w): the rotation's inverse applied."""
    qx, qy, qz, w = (-rotation[0], -rotation[1], -rotation[2], rotation[3])
    x, y, z = (ray[i] for i in range(3))
    tx, ty, tz = 2 * (qy * z - qz * y), 2 * (qz * x - qx * z), 2 * (qx * y - qy * x)
    return F.array(x + w * tx + qy * tz - qz * ty, y + w * ty + qz * tx - qx * tz, z + w * tz + qx * ty - qy * tx)


def ray_to_source(rotation: Column, focal: Column, width: Column, height: Column, ray: Column, least: float = 1e-9) -> Column:
    """Where a ray falls in a source's picture, in its pixels, or null behind the camera."""
    d = rotate_back(rotation, ray)
    return F.when(d[2] > least, F.array(width / 2 + focal * d[0] / d[2], height / 2 + focal * d[1] / d[2]))


def inverse3(m: Column) -> Column:
    """The inverse of a 3 x 3 matrix, nine values by row; null where it has none."""
    at = lambda r, c: m[3 * (r % 3) + c % 3]
    minor = lambda r, c: at(r + 1, c + 1) * at(r + 2, c + 2) - at(r + 1, c + 2) * at(r + 2, c + 1)
    det = at(0, 0) * minor(0, 0) + at(0, 1) * minor(0, 1) + at(0, 2) * minor(0, 2)
    return F.when(det != 0, F.array(*(minor(c, r) / det for r in range(3) for c in range(3))))


def primaries_to_xyz(xy: list[tuple[float, float]], white: tuple[float, float]) -> list[float]:
    """The matrix from linear RGB to XYZ (nine values by row) of three primaries and a white point, by their chromaticities."""
    import numpy as np

    column = lambda p: np.array([p[0] / p[1], 1.0, (1 - p[0] - p[1]) / p[1]])
    p = np.stack([column(c) for c in xy], axis=1)
    return (p * np.linalg.solve(p, column(white))).ravel().tolist()


def planckian_xy(kelvin: Column) -> Column:
    """The chromaticity (x, y) of a black body of 1,667 to 25,000 K, by Kim's cubic approximation; null outside."""
    t = kelvin.cast("double")
    k = 1000 / t
    # The published coefficients
    x = F.when(t <= 4000, -0.2661239 * k**3 - 0.2343589 * k**2 + 0.8776956 * k + 0.179910).otherwise(-3.0258469 * k**3 + 2.1070379 * k**2 + 0.2226347 * k + 0.240390)
    y = (
        F.when(t <= 2222, -1.1063814 * x**3 - 1.34811020 * x**2 + 2.18555832 * x - 0.20219683)
        .when(t <= 4000, -0.9549476 * x**3 - 1.37418593 * x**2 + 2.09137015 * x - 0.16748867)
        .otherwise(3.0817580 * x**3 - 5.87338670 * x**2 + 3.75112997 * x - 0.37001483)
    )
    return F.when(t.between(1667, 25_000), F.array(x, y))


def temperature_of(x: Column, y: Column) -> Column:
    """The correlated colour temperature of a chromaticity, by McCamy's cubic; null where it has none."""
    n = (x - 0.3320) / (0.1858 - y)
    # The published coefficients
    return F.when(y != 0.1858, 449 * n**3 + 3525 * n**2 + 6823.3 * n + 5520.33)
