"""Fixed-size vectors in ARRAY<DOUBLE> columns.

Sums over vectors are unrolled into one aggregate per component, so that a group costs one row and no explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12
EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def with_unit(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Scales a vector column to length one; the zero vector stays zero."""
    length = f"__{column}_norm"
    df = df.withColumn(length, F.greatest(norm(F.col(column)), F.lit(TINY)))
    return df.withColumn(out or column, F.transform(column, lambda x: x / F.col(length))).drop(length)


def sums(column: str, dim: int, weight: Column | None = None) -> Column:
    """Component-wise sum of a vector column, as one array."""
    w = F.lit(1.0) if weight is None else weight
    return F.array(*[F.coalesce(F.sum(w * F.col(column)[i]), F.lit(0.0)) for i in range(dim)])


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def histogram_distance(a: Column, b: Column) -> Column:
    """One minus the intersection of two histograms over the smaller mass."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return 1 - total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / F.least(total(a), total(b))


def angle(cosine: Column) -> Column:
    """Angle of a cosine; values just outside -1..1 are drawn in."""
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def unsigned_agreement(ax, ay, az, bx, by, bz) -> Column:
    """How parallel two normals are, whichever way they point."""
    return F.abs(ax * bx + ay * by + az * bz)
