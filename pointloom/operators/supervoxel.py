"""Supervoxels: seeds on voxels, flow-constrained growth, and the wrapper that labels points."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.colour import rgb_to_lab
from pointloom.functions.curves import interleave
from pointloom.operators.graph import voxel_adjacency
from pointloom.operators.segment import voxel_mean
from pointloom.operators.shape import euclid, farthest_points

AT = ["cx", "cy", "cz"]


@dataclass(frozen=True)
class Params:
    """Sizes and weights of a partition."""

    voxel: float = 0.02
    seed: float = 0.25
    w_colour: float = 0.2
    w_space: float = 0.4
    w_normal: float = 1.0
    w_boundary: float = 0.0
    boundary: float = 0.0
    search: float = 1.8
    keep: float = 0.5
    iters: int = 6
    mode: str = "grid"
    n_seeds: int = 0
    geodesic: bool = False


def normal_variance(voxels: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, cx, cy, cz, var): variance of the normals around each voxel; infinite for one without neighbours."""
    near = voxel_adjacency(voxels, keys)
    other = voxels.select(*keys, *[F.col(a).alias(f"o{a[1]}") for a in AT], "nx", "ny", "nz")
    got = near.join(other, [*keys, "ox", "oy", "oz"]).groupBy(*keys, *AT).agg(sum(F.avg(F.col(c) ** 2) - F.avg(c) ** 2 for c in ("nx", "ny", "nz")).alias("var"))
    return voxels.select(*keys, *AT).join(got, [*keys, *AT], "left").withColumn("var", F.coalesce("var", F.lit(float("inf"))))


def stride_seeds(voxels: DataFrame, n: int, depth: int = 10, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Every (m // n)-th voxel along the Morton curve of each scene, n at most: (keys, cx, cy, cz, rank)."""
    low = voxels.groupBy(*keys).agg(F.count("*").alias("m"), *[F.min(c).alias(f"lo{c}") for c in "xyz"], *[F.max(c).alias(f"hi{c}") for c in "xyz"])
    top = (1 << depth) - 1
    placed = voxels.join(low, list(keys))
    grid = [F.floor((F.col(c) - F.col(f"lo{c}")) / F.greatest(F.col(f"hi{c}") - F.col(f"lo{c}"), F.lit(1e-12)) * top).cast("long") for c in "xyz"]
    coded = placed.select(*keys, *AT, "m", interleave(*grid, depth, first_high=False).alias("code"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("code", *AT)) - 1
    stride = F.greatest(F.floor(F.col("m") / n), F.lit(1))
    ranked = coded.withColumn("at", at).where((F.col("at") % stride == 0) & (F.col("at") / stride < n))
    return ranked.select(*keys, *AT, F.floor(F.col("at") / stride).alias("rank"))


def grid_seeds(voxels: DataFrame, size: float, keep: float = 0.5, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """The voxels nearest to the nodes of a grid of `size` from each scene's least coordinates, of nodes nearer than `keep` of its size.

    A voxel can only be nearest to a node within keep * size of it, so nodes are listed around voxels, not over the
    whole box: every voxel asks the nodes in reach, and each node keeps the nearest (ties: the lowest cell).
    """
    low = voxels.groupBy(*keys).agg(*[F.min(c).alias(f"lo{c}") for c in "xyz"], *[F.max(c).alias(f"hi{c}") for c in "xyz"])
    placed = voxels.select(*keys, *AT, "x", "y", "z").join(low, list(keys))
    reach = range(-math.ceil(keep), math.ceil(keep) + 2)
    for c in "xyz":
        placed = placed.withColumn(f"s{c}", F.floor((F.col(c) - F.col(f"lo{c}")) / size).cast("long"))
    for c in "xyz":
        placed = placed.withColumn("__o", F.explode(F.array(*[F.lit(o).cast("long") for o in reach]))).withColumn(f"s{c}", F.col(f"s{c}") + F.col("__o")).drop("__o")
        # the grid ends before the greatest coordinate plus one step
        placed = placed.where((F.col(f"s{c}") >= 0) & (F.col(f"lo{c}") + F.col(f"s{c}") * size < F.col(f"hi{c}") + size))
    d2 = sum((F.col(c) - F.col(f"lo{c}") - F.col(f"s{c}") * size) ** 2 for c in "xyz")
    near = placed.withColumn("d2", d2).where(F.col("d2") < (size * keep) ** 2)
    best = near.groupBy(*keys, "sx", "sy", "sz").agg(F.min(F.struct("d2", *AT)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{a}").alias(a) for a in AT]).distinct()


def curve_seeds(voxels: DataFrame, n: int, voxel: float, depth: int = 10, keys: Sequence[str] = ("scene",)) -> tuple[DataFrame, DataFrame]:
    """Seeds along the curve and (keys, size): the edge of the share of each scene's box that a seed has, a voxel at least."""
    box = voxels.groupBy(*keys).agg(F.count("*").alias("m"), *[F.greatest(F.max(c) - F.min(c), F.lit(1e-6)).alias(f"e{c}") for c in "xyz"])
    volume = F.col("ex") * F.col("ey") * F.col("ez")
    size = box.select(*keys, F.greatest(F.lit(voxel), F.cbrt(volume / F.greatest(F.least(F.col("m"), F.lit(n)), F.lit(1)))).alias("size"))
    return stride_seeds(voxels, n, depth, keys).drop("rank"), size


def farthest_seeds(voxels: DataFrame, n: int, voxel: float, keys: Sequence[str] = ("scene",)) -> tuple[DataFrame, DataFrame]:
    """Farthest-point seeds from each scene's first voxel, and (keys, size): the mean distance of a seed to the nearest other."""
    keys = list(keys)

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(AT)
        xyz = g[["x", "y", "z"]].to_numpy(np.float64)
        pick = farthest_points(xyz, n)
        size = voxel
        if len(pick) > 1:
            d = euclid(xyz[pick], xyz[pick]) + np.diag(np.full(len(pick), np.inf))
            size = max(voxel, float(d.min(1).mean()))
        return g.iloc[pick][[*keys, *AT]].assign(size=size)

    kinds = ", ".join(f"`{k}` {voxels.schema[k].dataType.simpleString()}" for k in [*keys, *AT])
    got = voxels.select(*keys, *AT, "x", "y", "z").groupBy(*keys).applyInPandas(kernel, f"{kinds}, size double")
    return got.drop("size"), got.groupBy(*keys).agg(F.max("size").alias("size"))


def seeds_of(voxels: DataFrame, p: Params, keys: Sequence[str] = ("scene",)) -> tuple[DataFrame, DataFrame]:
    """Refined seeds by the mode that is asked for, and the size of a cluster in each scene.

    Modes: `grid`, `zcurve`, `fps`, and `auto`, which is the curve where a number of seeds is given and the grid elsewhere.
    """
    mode = p.mode if p.mode != "auto" else ("zcurve" if p.n_seeds > 0 else "grid")
    if mode == "grid":
        seeds, size = grid_seeds(voxels, p.seed, p.keep, keys), voxels.select(*keys).distinct().withColumn("size", F.lit(float(p.seed)))
    elif mode == "zcurve":
        seeds, size = curve_seeds(voxels, p.n_seeds, p.voxel, keys=keys)
    elif mode == "fps":
        seeds, size = farthest_seeds(voxels, max(1, p.n_seeds), p.voxel, keys)
    else:
        raise ValueError(f"unknown mode {p.mode!r}: auto, grid, zcurve or fps")
    return refine_seeds(seeds, voxels, keys), size


def refine_seeds(seeds: DataFrame, voxels: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Each seed moves to the voxel with the calmest normals in its neighbourhood, itself included."""
    calm = normal_variance(voxels, keys)
    near = voxel_adjacency(voxels, keys).join(seeds.select(*keys, *AT), [*keys, *AT], "left_semi")
    every = near.unionByName(seeds.select(*keys, *AT, *[F.col(a).alias(f"o{a[1]}") for a in AT]))
    scored = every.join(calm.select(*keys, *[F.col(a).alias(f"o{a[1]}") for a in AT], "var"), [*keys, "ox", "oy", "oz"])
    best = scored.groupBy(*keys, *AT).agg(F.min(F.struct("var", "ox", "oy", "oz")).alias("b"))
    return best.select(*keys, *[F.col(f"b.o{a[1]}").alias(a) for a in AT]).distinct()


def grow(at: np.ndarray, lab: np.ndarray, nrm: np.ndarray, src: np.ndarray, dst: np.ndarray, seeds: np.ndarray, p: Params, size: float | None = None) -> np.ndarray:
    """Labels of voxels by layers from all seeds at once; the cheapest claim on a voxel wins if it beats its best.

    The spatial part of a claim is the distance to the seed over the size of a cluster, or, if geodesic, the share of
    all layers gone.
    """
    size = p.seed if size is None else size
    label, best = np.full(len(at), -1), np.full(len(at), np.inf)
    label[seeds], best[seeds] = np.arange(len(seeds)), 0.0
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    first = np.searchsorted(src, np.arange(len(at) + 1))
    frontier = np.sort(seeds)
    layers = max(1, int(p.search * size / p.voxel))
    for layer in range(1, layers + 1):
        n = first[frontier + 1] - first[frontier]
        own = np.repeat(frontier, n)
        to = dst[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[frontier], n)]
        k = label[own]
        s = seeds[k]
        far = np.full(len(to), (layer / layers) ** 2) if p.geodesic else ((at[to] - at[s]) ** 2).sum(1) / (3 * size**2)
        cost = p.w_space * far + p.w_colour * ((lab[to] - lab[s]) ** 2).sum(1) / 1e4 + p.w_normal * (1 - np.abs((nrm[to] * nrm[s]).sum(1))) ** 2
        cost += p.w_boundary * np.maximum(0, p.boundary - np.abs((nrm[own] * nrm[to]).sum(1)))
        rank = np.lexsort((k, cost, to))
        to, cost, k = to[rank], cost[rank], k[rank]
        win = np.ones(len(to), bool)
        win[1:] = to[1:] != to[:-1]
        win &= cost < best[to]
        frontier = to[win]
        if not len(frontier):
            break
        label[frontier], best[frontier] = k[win], cost[win]
    return label


def move_seeds(at: np.ndarray, label: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Each seed moves to the voxel of its cluster nearest to the centroid; an empty cluster keeps its seed."""
    own = np.flatnonzero(label >= 0)
    n = np.bincount(label[own], minlength=len(seeds))
    centre = np.stack([np.bincount(label[own], at[own, i], len(seeds)) for i in range(3)], axis=1) / np.maximum(n, 1)[:, None]
    d = ((at[own] - centre[label[own]]) ** 2).sum(1)
    order = np.lexsort((own, d, label[own]))
    k = label[own][order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    out = seeds.copy()
    out[k[head]] = own[order][head]
    return out


def vccs(points: DataFrame, p: Params = Params(), keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, pid, seg): voxels, seeds and their neighbourhoods come from joins over all scenes; growth sees a scene.

    Growth takes some twenty layers six times, so it runs as a kernel over a scene's voxels (not its points). Points
    take their voxel's label; voxels that growth did not reach take that of the nearest voxel it did reach.
    """
    keys = list(keys)
    voxels = voxel_mean(points, p.voxel, keys)
    l, a, b = rgb_to_lab(F.col("r"), F.col("g"), F.col("b")) if "r" in points.columns else (F.lit(0.0),) * 3
    voxels = voxels.withColumns({"l": l, "la": a, "lb": b})
    seeds, size = seeds_of(voxels, p, keys)
    seeds = seeds.withColumn("is_seed", F.lit(True))
    near = voxel_adjacency(voxels, keys).groupBy(*keys, *AT).agg(F.collect_list(F.struct("ox", "oy", "oz")).alias("near"))
    rows = voxels.join(near, [*keys, *AT], "left").join(seeds, [*keys, *AT], "left").join(size, keys)

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(AT).reset_index(drop=True)
        at, lab, nrm = (g[c].to_numpy(np.float64) for c in (["x", "y", "z"], ["l", "la", "lb"], ["nx", "ny", "nz"]))
        many = g["near"].map(lambda v: 0 if v is None else len(v)).to_numpy()
        src = np.repeat(np.arange(len(g)), many)
        ends = np.array([[o[c] for c in ("ox", "oy", "oz")] for v in g["near"] if v is not None for o in v], np.int64).reshape(-1, 3)
        cells = g[AT].to_numpy(np.int64)
        base, span = cells.min(0), cells.max(0) - cells.min(0) + 1
        number = lambda c: ((c[:, 0] - base[0]) * span[1] + c[:, 1] - base[1]) * span[2] + c[:, 2] - base[2]
        dst = np.searchsorted(number(cells), number(ends))  # rows are in order of cells
        seed = np.flatnonzero(g["is_seed"].fillna(False).to_numpy(bool))
        seed = seed if len(seed) else np.zeros(1, np.int64)
        label = np.full(len(g), -1)
        for _ in range(p.iters):
            new = grow(at, lab, nrm, src, dst, seed, p, float(g["size"].iloc[0]))
            moved = move_seeds(at, new, seed)
            same = np.array_equal(new, label) and np.array_equal(moved, seed)
            label, seed = new, moved
            if same:
                break
        open_, known = np.flatnonzero(label < 0), np.flatnonzero(label >= 0)
        for lo in range(0, len(open_), 256):
            rest = open_[lo : lo + 256]
            label[rest] = label[known[((at[rest][:, None] - at[known][None]) ** 2).sum(2).argmin(1)]]
        return g[[*keys, *AT]].assign(seg=label)

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in [*keys, *AT])
    labels = rows.groupBy(*keys).applyInPandas(kernel, f"{kinds}, seg long")
    cells = [F.floor(F.col(c) / p.voxel).cast("long").alias(f"c{c}") for c in "xyz"]
    return points.select(*keys, "pid", *cells).join(labels, [*keys, *AT]).select(*keys, "pid", "seg")
