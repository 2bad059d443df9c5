"""Column functions of points, directions and triangles; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def minus(p: Vector, q: Vector) -> Vector:
    return p[0] - q[0], p[1] - q[1], p[2] - q[2]


def dot(p: Vector, q: Vector) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def cross(p: Vector, q: Vector) -> Vector:
    return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]


def norm(p: Vector) -> Column:
    return F.sqrt(dot(p, p))


def spherical(p: Vector) -> tuple[Column, Column, Column]:
    """Azimuth, elevation and range; at the origin the elevation is null."""
    rng = norm(p)
    ratio = F.try_divide(p[2], rng)
    return F.atan2(p[1], p[0]), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))), rng


def cartesian(azimuth: Column, elevation: Column, rng: Column) -> Vector:
    flat = rng * F.cos(elevation)
    return flat * F.cos(azimuth), flat * F.sin(azimuth), rng * F.sin(elevation)


def to_world(p: Vector, rotation: list[list[float]], shift: list[float]) -> Vector:
    """The rotation, then the shift."""
    return tuple(sum((F.lit(a) * x for a, x in zip(row, p, strict=True)), F.lit(float(t))) for row, t in zip(rotation, shift, strict=True))


def to_local(p: Vector, rotation: list[list[float]], shift: list[float]) -> Vector:
    """The inverse of to_world; a rotation's inverse is its transpose."""
    own = tuple(x - F.lit(float(t)) for x, t in zip(p, shift, strict=True))
    return tuple(sum((F.lit(a) * x for a, x in zip(column, own, strict=True)), F.lit(0.0)) for column in zip(*rotation, strict=True))


def circular_gap(later: Column, earlier: Column) -> Column:
    """later - earlier, wrapped to -180 up to 180 degrees, in radians."""
    return F.atan2(F.sin(later - earlier), F.cos(later - earlier))
