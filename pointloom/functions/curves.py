"""Grid cells and space-filling-curve codes: column expressions inside code generation, Hilbert codes over Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 14
ORDERS = ("z", "z-trans", "hilbert", "hilbert-trans")
#: Shifts and masks that leave two free bits after each of 21 bits.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def cell(value: Column, size: float) -> Column:
    """Grid cell of a coordinate; floor, also below zero."""
    return F.floor(value / size).cast("long")


def with_cells(points: DataFrame, voxel: float, shift: float = 0.0, keys: Sequence[str] = ("scene",), depth: int = DEPTH, out: Sequence[str] = ("gx", "gy", "gz")) -> DataFrame:
    """Cells relative to the least coordinate of each scene, clamped to the curve's grid.

    The least coordinates come from a grouped aggregate (a row a scene), not from a window that gathers a scene.
    """
    low = points.groupBy(*keys).agg(*[F.min(c).alias(f"__min_{c}") for c in "xyz"])
    top = (1 << depth) - 1
    placed = points.join(low, list(keys))
    for c, name in zip("xyz", out, strict=True):
        value = F.floor((F.col(c) - F.col(f"__min_{c}")) / voxel + shift).cast("long")
        placed = placed.withColumn(name, F.least(F.greatest(value, F.lit(0).cast("long")), F.lit(top).cast("long")))
    return placed.drop("__min_x", "__min_y", "__min_z")


def interleave(x: Column, y: Column, z: Column, depth: int = DEPTH, first_high: bool = True) -> Column:
    """Morton code; the first axis takes the highest bit of each three, or the lowest."""
    high, low = (x, z) if first_high else (z, x)
    code = F.lit(0).cast("long")
    for i in range(depth):
        for value, at in ((high, 2), (y, 1), (low, 0)):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(value, i).bitwiseAND(F.lit(1).cast("long")), 3 * i + at))
    return code


def morton(x: str, y: str, z: str, depth: int = DEPTH, first_high: bool = True) -> Column:
    return interleave(F.col(x).cast("long"), F.col(y).cast("long"), F.col(z).cast("long"), depth, first_high)


def morton_decode(code: str, depth: int = DEPTH, first_high: bool = True) -> tuple[Column, Column, Column]:
    """The three axes of a Morton code."""
    out = []
    for at in (2, 1, 0) if first_high else (0, 1, 2):
        axis = F.lit(0).cast("long")
        for i in range(depth):
            axis = axis.bitwiseOR(F.shiftleft(F.shiftright(F.col(code), 3 * i + at).bitwiseAND(F.lit(1).cast("long")), i))
        out.append(axis)
    return tuple(out)


def gray(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 1))


def gray_inverse(df: DataFrame, column: str, bits: int = 16) -> DataFrame:
    step = 1
    while step < bits:
        df = df.withColumn(column, F.col(column).bitwiseXOR(F.shiftright(F.col(column), step)))
        step *= 2
    return df


def hilbert_index(x: np.ndarray, y: np.ndarray, z: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Hilbert indices of cells (Skilling's transpose method), over whole arrays."""
    h = [np.array(v, np.int64) for v in (x, y, z)]
    for bit in range(depth - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(3):
            on = -(h[i] >> bit & 1)  # all bits where the axis has this one
            t = (h[0] ^ h[i]) & low & ~on
            h[0] ^= t | (low & on)
            if i:
                h[i] ^= t
    h[1] ^= h[0]
    h[2] ^= h[1]
    t, step = h[2] >> 1, 1
    while step < depth:
        t ^= t >> step
        step *= 2
    return morton_index(*(v ^ t for v in h))


def morton_index(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Interleaved bits of cells below 2**21; the first axis takes the highest bit of each three."""
    out = 0
    for at, v in ((2, x), (1, y), (0, z)):
        v = np.asarray(v, np.int64)
        for shift, mask in SPREAD:
            v = (v | v << shift) & mask
        out = out | v << at
    return out


def hilbert_place(code: np.ndarray, depth: int = DEPTH) -> list[np.ndarray]:
    """Inverse of hilbert_index."""
    code = np.asarray(code, np.int64)
    h = [sum((code >> (3 * i + at) & 1) << i for i in range(depth)) for at in (2, 1, 0)]
    t = h[2] >> 1
    h[2], h[1], h[0] = h[2] ^ h[1], h[1] ^ h[0], h[0] ^ t
    for bit in range(1, depth):
        low = (1 << bit) - 1
        for i in (2, 1, 0):
            on = -(h[i] >> bit & 1)
            s = (h[0] ^ h[i]) & low & ~on
            h[0] = h[0] ^ (s | (low & on))
            if i:
                h[i] = h[i] ^ s
    return h


def with_hilbert(df: DataFrame, x: str, y: str, z: str, out: str, depth: int = DEPTH) -> DataFrame:
    """Adds the Hilbert index of a cell. Forty dependent steps are one kernel over Arrow batches, not forty projections."""

    @F.pandas_udf("long")
    def of(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(x, y, z, depth))

    return df.withColumn(out, of(*[F.col(c).cast("long") for c in (x, y, z)]))


def with_hilbert_cell(df: DataFrame, code: str, out: Sequence[str] = ("hx", "hy", "hz"), depth: int = DEPTH) -> DataFrame:
    """Inverse of with_hilbert: the cell of a Hilbert index."""

    @F.pandas_udf("x long, y long, z long")
    def of(code: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip("xyz", hilbert_place(code.to_numpy(), depth), strict=True)))

    placed = df.withColumn(f"__{code}", of(F.col(code)))
    return placed.withColumns({o: F.col(f"__{code}.{a}") for o, a in zip(out, "xyz", strict=True)}).drop(f"__{code}")


def coded(points: DataFrame, voxel: float, shifts: Sequence[float], orders: Sequence[str] = ORDERS, keys: Sequence[str] = ("scene",), depth: int = DEPTH) -> DataFrame:
    """(keys, curve, code, pid, x, y, z): every point once a curve, curves numbered by order and then shift, in one pass."""
    low = points.groupBy(*keys).agg(*[F.min(c).alias(f"__min_{c}") for c in "xyz"])
    placed = points.select(*keys, "pid", "x", "y", "z").join(low, list(keys))
    placed = placed.select(*keys, "pid", *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.col(f"__min_{c}").cast("double") for c in "xyz"])
    n, top = len(keys), (1 << depth) - 1

    def of(batches):
        for batch in batches:
            at = [batch.column(n + 1 + i).to_numpy() for i in range(3)]
            least = [batch.column(n + 4 + i).to_numpy() for i in range(3)]
            for j, shift in enumerate(shifts):
                cells = [np.clip(np.floor((v - m) / voxel + shift), 0, top).astype(np.int64) for v, m in zip(at, least, strict=True)]
                for i, order in enumerate(orders):
                    x, y, z = cells if not order.endswith("-trans") else (cells[1], cells[0], cells[2])
                    code = hilbert_index(x, y, z, depth) if order.startswith("hilbert") else morton_index(x, y, z)
                    curve = pa.array(np.full(batch.num_rows, i * len(shifts) + j, np.int32))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:n], curve, pa.array(code), *batch.columns[n : n + 4]], names=[*keys, "curve", "code", "pid", "x", "y", "z"])

    kinds = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys)
    return placed.mapInArrow(of, f"{kinds}, curve int, code long, pid {placed.schema['pid'].dataType.simpleString()}, x double, y double, z double")


def with_code(df: DataFrame, order: str, out: str, cells: Sequence[str] = ("gx", "gy", "gz"), depth: int = DEPTH) -> DataFrame:
    """Adds the code of one of ORDERS; `-trans` swaps the first two axes."""
    if order not in ORDERS:
        raise ValueError(f"unknown curve {order!r}")
    x, y, z = cells if not order.endswith("-trans") else (cells[1], cells[0], cells[2])
    return with_hilbert(df, x, y, z, out, depth) if order.startswith("hilbert") else df.withColumn(out, morton(x, y, z, depth))


def batch_of_offset(offsets: DataFrame) -> DataFrame:
    """Rows (batch, offset) with running ends to a row (batch, pos) for each element."""
    w = Window.orderBy("batch")
    start = F.coalesce(F.lag("offset").over(w), F.lit(0).cast("long"))
    return offsets.withColumn("start", start).where("offset > start").select("batch", F.explode(F.sequence("start", F.col("offset") - 1)).alias("pos"))


def bin_count(offsets: DataFrame) -> DataFrame:
    """Rows (batch, offset) with running ends to (batch, n): how many elements each batch has."""
    w = Window.orderBy("batch")
    return offsets.select("batch", (F.col("offset") - F.coalesce(F.lag("offset").over(w), F.lit(0).cast("long"))).alias("n"))


def offset_of_batch(rows: DataFrame) -> DataFrame:
    """Rows with a batch number to (batch, offset) with running ends; counts are summed, rows are not sorted."""
    n = rows.groupBy("batch").agg(F.count("*").alias("n"))
    return n.select("batch", F.sum("n").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)).alias("offset"))
