"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(c: Column | str, places: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(c, places) + F.lit(0.0)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def norm(a: tuple) -> Column:
    return F.sqrt(dot(a, a))


def xyz(prefix: str) -> tuple[Column, Column, Column]:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def named(v: tuple, prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{k}") for c, k in zip(v, "xyz", strict=True)]


def encode_normal(c: Column) -> Column:
    """A normal's component in [-1, 1] as a pixel value in [0, 1]."""
    return clip((c + 1) / 2, 0.0, 1.0)


def decode_normal(c: Column) -> Column:
    return c * 2 - 1


def stars(p: Column) -> Column:
    """Marks of significance; null stays unmarked."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is missing or not positive."""
    return F.when(b > 0, a / b)


def barycentric(r1: Column, r2: Column) -> tuple[Column, Column, Column]:
    """Weights of a uniform point of a triangle from two uniform numbers."""
    s = F.sqrt(r1)
    return 1 - s, s * (1 - r2), s * r2


def shade(n: tuple, light: tuple, ambient: float = 0.30, diffuse: float = 0.65) -> Column:
    """Lambert shading."""
    return F.lit(ambient) + F.lit(diffuse) * F.greatest(dot(n, light), F.lit(0.0))


def depth(z: Column, top: Column, sentinel: float = 1 / 255) -> Column:
    """Height as a pixel value; background is 0, so that every drawn pixel lies above it."""
    return F.lit(sentinel) + F.lit(1 - sentinel) * clip(z / top, 0.0, 1.0)
