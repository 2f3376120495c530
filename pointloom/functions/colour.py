"""Colours: rescaling, CIELab, and stable display colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rescale(c: Column) -> Column:
    """From -1..1 to 0..1, clipped."""
    return F.least(F.greatest((c + 1) * 0.5, F.lit(0.0)), F.lit(1.0))


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """sRGB in 0..1 to CIELab under D65."""

    def linear(c: Column) -> Column:
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)

    r, g, b = linear(r), linear(g), linear(b)
    x = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047
    y = 0.2126729 * r + 0.7151522 * g + 0.0721750 * b
    z = (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883

    def f(t: Column) -> Column:
        return F.when(t > 216 / 24389, F.cbrt(t)).otherwise(t * (841 / 108) + 4 / 29)

    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def region_colour(region: Column) -> Column:
    """Six hex digits from the region's number, far apart for neighbours (Knuth's multiplier)."""
    return F.lower(F.lpad(F.hex(F.pmod(region.cast("long") * F.lit(2654435761).cast("long"), F.lit(16777216).cast("long"))), 6, "0"))


def class_colour(cls: Column, palette: Sequence[Sequence[int]], other: int = 60) -> Column:
    """Six hex digits of a class in a palette of (r, g, b); grey where the class is outside it or null."""
    table = F.array(*[F.lit("%02x%02x%02x" % tuple(c)) for c in palette])
    return F.when(cls.between(0, len(palette) - 1), F.get(table, cls.cast("int"))).otherwise("%02x%02x%02x" % (other, other, other))


def fading(d2: Column, radius: float, kind: str = "linear") -> Column:
    """Opacity of a point at squared distance d2 from a pixel: linear or exponential."""
    return 1 - d2 / radius**2 if kind == "linear" else F.exp(-d2 / radius**2)
