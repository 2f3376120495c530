"""Ten views of a shape: rotation, a grid of depths, depth images, visibility, and features of pixels back on points.

A grid of one shape and view is dense and of a fixed size, so it is a kernel; shapes and views run in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.classify import small

#: The angles (in radians, around x, y and z) of three rotations of each of ten views, and the shift after them.
VIEWS = (
    ((0 * np.pi / 2, 0, np.pi / 2), (np.pi / 4, 0, 0), (0, np.pi / 9, 0)),
    ((1 * np.pi / 2, 0, np.pi / 2), (np.pi / 4, 0, 0), (0, np.pi / 9, 0)),
    ((2 * np.pi / 2, 0, np.pi / 2), (np.pi / 4, 0, 0), (0, np.pi / 9, 0)),
    ((3 * np.pi / 2, 0, np.pi / 2), (np.pi / 4, 0, 0), (0, np.pi / 9, 0)),
    ((0 * np.pi / 2, 0, np.pi / 2), (0, 0, 0), (0, np.pi / 9, 0)),
    ((1 * np.pi / 2, 0, np.pi / 2), (0, 0, 0), (0, np.pi / 9, 0)),
    ((2 * np.pi / 2, 0, np.pi / 2), (0, 0, 0), (0, np.pi / 9, 0)),
    ((3 * np.pi / 2, 0, np.pi / 2), (0, 0, 0), (0, np.pi / 9, 0)),
    ((0, -np.pi / 2, np.pi / 2), (np.pi / 15, 0, 0), (0, np.pi / 15, 0)),
    ((0, np.pi / 2, np.pi / 2), (np.pi / 15, 0, 0), (0, np.pi / 15, 0)),
)
SHIFT = (-0.5, -0.5, -1.5)


@dataclass(frozen=True)
class Grid:
    """Sizes of the depth grid, its pooling and its smoothing. The defaults are fixed values of the object pipeline."""

    resolution: int = 224
    depth: int = 112
    pool_z: int = 5
    pool_xy: int = 11
    blur: int = 5
    sigma_xy: float = 1.0
    sigma_z: float = 2.0
    depth_bias: float = 0.3
    ratio: float = 0.7
    background: float = 0.0
    seen: float = 0.1


def rotation(angles: tuple[float, float, float]) -> np.ndarray:
    """The matrix of a turn around z, then y, then x."""
    x, y, z = angles
    turn = lambda a, i, j: np.eye(3) + (np.cos(a) - 1) * (np.outer(np.eye(3)[i], np.eye(3)[i]) + np.outer(np.eye(3)[j], np.eye(3)[j])) + np.sin(a) * (np.outer(np.eye(3)[j], np.eye(3)[i]) - np.outer(np.eye(3)[i], np.eye(3)[j]))
    return turn(x, 1, 2) @ turn(y, 2, 0) @ turn(z, 0, 1)


def view_matrices() -> np.ndarray:
    """A matrix a view, which rows of coordinates are multiplied with."""
    return np.stack([np.linalg.multi_dot([rotation(a).T for a in view]) for view in VIEWS])


def viewed(points: DataFrame) -> DataFrame:
    """(shape_id, view, pid, x, y, z): every point in every view; ten rows of constants are joined."""
    rows = [(v, *(float(c) for c in m.ravel())) for v, m in enumerate(view_matrices())]
    table = points.sparkSession.createDataFrame(rows, "view int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))
    met = points.select("shape_id", "pid", "x", "y", "z").join(F.broadcast(table))
    return met.select("shape_id", "view", "pid", *[(sum(F.col(a) * F.col(f"m{i}{j}") for i, a in enumerate("xyz")) - F.lit(SHIFT[j])).alias(c) for j, c in enumerate("xyz")])


def image_cells(points: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """(shape_id, view, pid, xx, yy, zi, zz): pixel, layer and depth of every point of every view, in a box around the shape's middle."""
    own = ["shape_id", "view"]
    box = points.groupBy(*own).agg(*[F.min(c).alias(f"lo{c}") for c in "xyz"], *[F.max(c).alias(f"hi{c}") for c in "xyz"])
    box = box.withColumn("wide", F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"], F.lit(1e-12)))
    at = {c: (F.col(c) - (F.col(f"hi{c}") + F.col(f"lo{c}")) / 2) / F.col("wide") * 2 for c in "xyz"}
    pixel = lambda c: F.least(F.greatest(F.ceil((at[c] * grid.ratio + 1) / 2 * grid.resolution), F.lit(1)), F.lit(grid.resolution - 2)).cast("int")
    z = ((at["z"] + 1) / 2 + grid.depth_bias) / (1 + grid.depth_bias) * (grid.depth - 2)
    return points.join(box, own).select(*own, "pid", pixel("x").alias("xx"), pixel("y").alias("yy"), F.ceil(z).cast("int").alias("zi"), F.least(F.greatest(z, F.lit(1.0)), F.lit(grid.depth - 2.0)).alias("zz"))


def gaussian(size: int, sigma: float) -> np.ndarray:
    """Weights of a window about its middle that sum to one."""
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return w / w.sum()


def _slide(x: np.ndarray, axis: int, size: int, fold, fill: float) -> np.ndarray:
    """Folds the shifted copies of an array along an axis, padded by half a window on both sides."""
    pad = [(0, 0)] * x.ndim
    pad[axis] = (size // 2, size // 2)
    wide, n = np.pad(x, pad, constant_values=fill), x.shape[axis]
    cut = lambda k: wide[tuple(slice(k, k + n) if a == axis else slice(None) for a in range(x.ndim))]
    return fold([cut(k) for k in range(size)])


def depth_image(xx: np.ndarray, yy: np.ndarray, zi: np.ndarray, zz: np.ndarray, grid: Grid = Grid()) -> tuple[np.ndarray, np.ndarray]:
    """(image, grid of depths): filled by the largest depth nearby, smoothed, nearest layer taken, turned so that near is small.

    Rows of the image run along x. Of points in one cell the last in order stays.
    """
    box = np.full((grid.depth, grid.resolution, grid.resolution), grid.background, np.float32)
    box[zi, xx, yy] = zz
    for axis, size in ((0, grid.pool_z), (1, grid.pool_xy), (2, grid.pool_xy)):
        box = _slide(box, axis, size, lambda parts: np.maximum.reduce(parts), -np.inf)
    for axis, sigma in ((0, grid.sigma_z), (1, grid.sigma_xy), (2, grid.sigma_xy)):
        w = gaussian(grid.blur, sigma).astype(np.float32)
        box = _slide(box, axis, grid.blur, lambda parts, w=w: sum(a * b for a, b in zip(w, parts, strict=True)), 0.0)
    image = box.max(0)
    top = max(float(image.max()), 1e-30)
    return 1 - image / top, 1 - box / top


CELLS = "shape_id {kind}, view int, pid long, is_seen double, yy int, xx int"


def visibility(cells: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """(shape_id, view, pid, is_seen, yy, xx): whether the depth at a point's pixel is about the point's own."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid")
        xx, yy, zi, zz = (g[c].to_numpy() for c in ("xx", "yy", "zi", "zz"))
        image, box = depth_image(xx, yy, zi, zz, grid)
        # pixels are looked up as (yy, xx) in an image whose rows run along x, as the object pipeline does throughout
        seen = np.abs(image[yy, xx] - box[np.clip(zi, 1, grid.depth - 3), yy, xx]) < grid.seen
        return g[["shape_id", "view", "pid"]].assign(is_seen=seen.astype(np.float64), yy=yy, xx=xx)

    kind = cells.schema["shape_id"].dataType.simpleString()
    return cells.groupBy("shape_id", "view").applyInPandas(kernel, CELLS.format(kind=kind))


def depth_images(cells: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """(shape_id, view, image): depth images as rows of numbers, resolution x resolution of them."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid")
        image, _ = depth_image(*(g[c].to_numpy() for c in ("xx", "yy", "zi", "zz")), grid)
        return pd.DataFrame({"shape_id": [g["shape_id"].iloc[0]], "view": [g["view"].iloc[0]], "image": [image.ravel()]})

    kind = cells.schema["shape_id"].dataType.simpleString()
    return cells.groupBy("shape_id", "view").applyInPandas(kernel, f"shape_id {kind}, view int, image array<float>")


def project(points: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Points of shapes to (shape_id, view, pid, is_seen, yy, xx) in ten views."""
    return visibility(image_cells(viewed(points), grid), grid)


def cropped(seen: DataFrame, border: int = 20, size: int = 224) -> DataFrame:
    """Pixels in the image without its border, scaled back to `size`."""
    at = lambda c: F.ceil((F.col(c) - border) * float(size) / (size - 2 * border)).cast("int")
    return seen.withColumns({"yy": at("yy"), "xx": at("xx")})


def smoothed(tiles: np.ndarray, window: int = 6) -> np.ndarray:
    """Means of windows of a map (side, side, features) whose edges are repeated: the same side."""
    before, after = (window - 1) // 2, window - 1 - (window - 1) // 2
    wide = np.pad(tiles, ((before, after), (before, after), (0, 0)), mode="edge")
    total = np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
    n = tiles.shape[0]
    return (total[window : window + n, window : window + n] - total[:n, window : window + n] - total[window : window + n, :n] + total[:n, :n]) / window**2


def between(tiles: np.ndarray, yy: np.ndarray, xx: np.ndarray, size: int) -> np.ndarray:
    """Values of a map at pixels of an image of `size`, between the four nearest tiles (half-pixel centres)."""
    side = tiles.shape[0]
    out = 0.0

    def ends(v):
        at = np.maximum((np.clip(v, 0, size - 1) + 0.5) * side / size - 0.5, 0)
        low = np.minimum(np.floor(at).astype(np.int64), side - 1)
        return low, np.minimum(low + 1, side - 1), at - low

    y, x = ends(yy), ends(xx)
    for a, wa in ((y[0], 1 - y[2]), (y[1], y[2])):
        for b, wb in ((x[0], 1 - x[2]), (x[1], x[2])):
            out = out + (wa * wb)[:, None] * tiles[a, b]
    return out


def pixel_features(seen: DataFrame, maps: DataFrame, dim: int, size: int = 224) -> DataFrame:
    """(shape_id, view, pid, is_seen, feat): the feature at each point's pixel, of maps (shape_id, view, cell, feat) of square
    tiles, smoothed and drawn out to `size`. A view without a map gives no rows."""

    def kernel(p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(m):
            return pd.DataFrame({c: [] for c in ("shape_id", "view", "pid", "is_seen", "feat")})
        m = m.sort_values("cell")
        side = int(round(len(m) ** 0.5))
        tiles = smoothed(np.stack(m["feat"].to_numpy()).astype(np.float64).reshape(side, side, dim))
        return p[["shape_id", "view", "pid", "is_seen"]].assign(feat=list(between(tiles, p["yy"].to_numpy(), p["xx"].to_numpy(), size)))

    kind = seen.schema["shape_id"].dataType.simpleString()
    both = seen.groupBy("shape_id", "view").cogroup(maps.groupBy("shape_id", "view"))
    return both.applyInPandas(kernel, f"shape_id {kind}, view int, pid long, is_seen double, feat array<double>")


def with_view_weights(seen: DataFrame, weights: DataFrame) -> DataFrame:
    """Joins (category, view, w); the table has a row a category and view."""
    return seen.join(F.broadcast(small(weights, "view weights")), ["category", "view"])
