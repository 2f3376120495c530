"""Single objects: neighbour queries, prototypes, interpolation, and dense kernels run a shape at a time.

A shape has a few thousand points by definition, so kernels see one shape as an Arrow table; all shapes run in parallel.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.curves import cell
from pointloom.functions.vectors import EPS, dot, sums, with_unit
from pointloom.operators.classify import small
from pointloom.operators.graph import top_k
from pointloom.operators.metrics import shape_iou
from pointloom.operators.segment import summed


def distances(a: DataFrame, b: DataFrame, key: str = "shape_id", left: str = "i", right: str = "j") -> DataFrame:
    """All pairs within a shape with their squared distance: (key, i, j, d2)."""
    p = a.select(key, F.col("pid").alias(left), "x", "y", "z")
    q = b.select(key, F.col("pid").alias(right), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    d2 = sum((F.col(c) - F.col(f"{c}2")) ** 2 for c in "xyz")
    return p.join(q, key).select(key, left, right, d2.alias("d2"))


def knn(queries: DataFrame, refs: DataFrame, k: int, key: str = "shape_id") -> DataFrame:
    """k nearest references of each query, nearer and lower ids first."""
    return top_k(distances(queries, refs, key), k, ["d2", "j"], [key])


def ball_query(queries: DataFrame, refs: DataFrame, radius: float, n: int, key: str = "shape_id") -> DataFrame:
    """(key, i, slot, j): the first n references by id within a radius; missing places repeat the first.

    Queries meet the references of the 27 cells around their own, so no pairs beyond twice the radius are made.
    """
    cells = [cell(F.col(c), radius).alias(f"c{c}") for c in "xyz"]
    home = refs.select(key, F.col("pid").alias("j"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *cells)
    asked = queries.select(key, F.col("pid").alias("i"), "x", "y", "z", *cells)
    for c in "xyz":
        asked = asked.withColumn("__s", F.explode(F.array(*[F.lit(o) for o in (-1, 0, 1)]))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("__s")).drop("__s")
    d2 = sum((F.col(c) - F.col(f"{c}2")) ** 2 for c in "xyz")
    found = top_k(asked.join(home, [key, "cx", "cy", "cz"]).where(d2 <= radius**2).select(key, "i", "j"), n, ["j"], [key])
    got = found.groupBy(key, "i").agg(F.array_sort(F.collect_list("j")).alias("js"))
    padded = F.concat("js", F.array_repeat(F.element_at("js", 1), F.lit(n) - F.size("js")))
    return got.select(key, "i", F.posexplode(padded).alias("slot", "j"))


def patches(nodes: DataFrame, refs: DataFrame, k: int, key: str = "shape_id") -> DataFrame:
    """(key, i, slot, j, x, y, z): members of each node's patch, nearest first, and as slot k the shape's centre, with j -1."""
    near = knn(nodes, refs, k, key)
    ranked = near.withColumn("slot", F.row_number().over(Window.partitionBy(key, "i").orderBy("d2", "j")) - 1)
    members = ranked.join(refs.select(key, F.col("pid").alias("j"), "x", "y", "z"), [key, "j"]).select(key, "i", "slot", "j", "x", "y", "z")
    centre = refs.groupBy(key).agg(*[F.avg(c).alias(c) for c in "xyz"])
    own = nodes.select(key, F.col("pid").alias("i"), F.lit(k).alias("slot"), F.lit(-1).cast("long").alias("j")).join(centre, key)
    return members.unionByName(own)


def view_mean(seen: DataFrame, dim: int, views: int = 10) -> DataFrame:
    """(shape_id, pid, feat): weighted view features over the number of views. seen: (shape_id, pid, w, is_seen, feat)."""
    return seen.groupBy("shape_id", "pid").agg(sums("feat", dim, F.col("w") * F.col("is_seen") / views).alias("feat"))


def back_project(view_points: DataFrame, view_features: DataFrame, weights: DataFrame) -> DataFrame:
    """Feature of the pixel that each visible point falls on, with its view's weight (a row a category and view)."""
    met = view_points.join(view_features, ["shape_id", "view", "yy", "xx"])
    return met.join(F.broadcast(small(weights, "view weights")), ["category", "view"])


def mixture_moments(gamma: DataFrame, dim: int, vector: str = "feat") -> DataFrame:
    """(shape_id, k, pi, mu, sigma) of soft assignments (shape_id, pid, k, gamma, feat): share, mean and variance a component."""
    n = gamma.groupBy("shape_id").agg(F.countDistinct("pid").alias("n"))
    own = ["shape_id", "k"]
    first = summed(gamma, own, vector, dim, "gamma", "s").withColumnRenamed("w", "g").drop("n")
    mu = first.join(n, "shape_id").select(*own, (F.col("g") / F.col("n")).alias("pi"), "g", F.transform("s", lambda x: x / (F.col("g") + 1e-5)).alias("mu"))
    # about the mean, not from sums of squares, which would cancel
    off = gamma.join(mu.select(*own, "mu"), own).withColumn("__off", F.zip_with(vector, "mu", lambda x, m: (x - m) * (x - m)))
    second = summed(off, own, "__off", dim, "gamma", "s").select(*own, "s")
    return mu.join(second, own).select(*own, "pi", "mu", F.transform("s", lambda x: x / (F.col("g") + 1e-5)).alias("sigma"))


def topk_prototypes(gamma: DataFrame, k_top: int, dim: int, vector: str = "feat") -> DataFrame:
    """(shape_id, k, proto, mass): weighted mean of a cluster's strongest points."""
    best = top_k(gamma.withColumnRenamed("k", "i"), k_top, [F.desc("gamma"), "pid"], ["shape_id"])
    got = best.groupBy("shape_id", F.col("i").alias("k")).agg(F.greatest(F.sum("gamma"), F.lit(1e-4)).alias("w"), sums(vector, dim, F.col("gamma")).alias("s"))
    total = got.groupBy("shape_id").agg(F.sum("w").alias("t"))
    return got.join(total, "shape_id").select("shape_id", "k", F.transform("s", lambda x: x / F.col("w")).alias("proto"), (F.col("w") / F.col("t")).alias("mass"))


def interpolate(points: DataFrame, nodes: DataFrame, dim: int, k: int = 8, key: str = "shape_id") -> DataFrame:
    """(key, pid, feat): inverse-distance mean of the k nearest nodes' vectors."""
    near = knn(points, nodes, k, key).withColumn("w", 1 / (F.sqrt("d2") + EPS))
    met = near.join(nodes.select(key, F.col("pid").alias("j"), "feat"), [key, "j"])
    got = met.groupBy(key, F.col("i").alias("pid")).agg(sums("feat", dim, F.col("w")).alias("s"), F.sum("w").alias("w"))
    return got.select(key, "pid", F.transform("s", lambda x: x / F.col("w")).alias("feat"))


def scatter_back(points: DataFrame, patch_feats: DataFrame, key: str = "shape_id") -> DataFrame:
    """Points with features of patches written over their own; of several patches that hold a point, that of the highest node and slot.

    patch_feats: (key, i, slot, j, feat).
    """
    last = patch_feats.groupBy(key, F.col("j").alias("pid")).agg(F.max_by("feat", F.struct("i", "slot")).alias("__new"))
    return points.join(last, [key, "pid"], "left").withColumn("feat", F.coalesce("__new", "feat")).drop("__new")


def curvature(edges: DataFrame, points: DataFrame, key: str = "shape_id") -> DataFrame:
    """(key, pid, linearity, planarity, scatter) from the eigenvalues of each neighbourhood."""
    from pointloom.operators.segment import PAIRS, covariances

    @F.pandas_udf("linearity double, planarity double, scatter double")
    def of(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
        v = np.maximum(np.linalg.eigvalsh(m), 0)
        top = np.maximum(v[:, 2], 1e-12)
        return pd.DataFrame({"linearity": (v[:, 2] - v[:, 1]) / top, "planarity": (v[:, 1] - v[:, 0]) / top, "scatter": v[:, 0] / top})

    got = covariances(edges, points, [key]).withColumn("c", of(*[F.col(f"c{a}{b}") for a, b in PAIRS]))
    return got.select(key, "pid", "c.linearity", "c.planarity", "c.scatter")


def per_shape(rows: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: Sequence[str] = ("shape_id",)) -> DataFrame:
    return rows.groupBy(*keys).applyInPandas(kernel, schema)


def farthest_points(xyz: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    """Indices of n points, each farthest from those before it."""
    n = min(n, len(xyz))
    out, gap = np.zeros(n, np.int64), np.full(len(xyz), np.inf)
    for i in range(n):
        out[i] = start
        gap = np.minimum(gap, ((xyz - xyz[start]) ** 2).sum(1))
        start = int(gap.argmax())
    return out


def fps(points: DataFrame, n: int, start: str = "first", key: str = "shape_id") -> DataFrame:
    """(key, rank, pid): farthest-point sample, from the first point or that farthest from the centroid."""

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pid")
        xyz = group[["x", "y", "z"]].to_numpy(np.float64)
        first = 0 if start == "first" else int(((xyz - xyz.mean(0)) ** 2).sum(1).argmax())
        pick = farthest_points(xyz, n, first)
        return pd.DataFrame({key: group[key].iloc[0], "rank": np.arange(len(pick)), "pid": group["pid"].to_numpy()[pick]})

    kind = points.schema[key].dataType.simpleString()
    return per_shape(points.select(key, "pid", "x", "y", "z"), kernel, f"{key} {kind}, rank long, pid long", [key])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def sinkhorn_plan(cost: np.ndarray, p: np.ndarray | None = None, q: np.ndarray | None = None, epsilon: float = 1e-4, thresh: float = 1e-2, iters: int = 100) -> np.ndarray:
    """Transport plan in the log domain; stops when the duals of this shape change by less than `thresh` in all."""
    n, m = cost.shape
    p = np.full(n, 1 / n) if p is None else p
    q = np.full(m, 1 / m) if q is None else q
    u, v = np.zeros(n), np.zeros(m)
    kernel = lambda: (-cost + u[:, None] + v[None, :]) / epsilon
    for _ in range(iters):
        u0, v0 = u, v
        u = u + epsilon * (np.log(p + 1e-8) - log_sum(kernel(), 1))
        v = v + epsilon * (np.log(q + 1e-8) - log_sum(kernel(), 0))
        if np.abs(u - u0).sum() + np.abs(v - v0).sum() < thresh:
            break
    return np.exp(kernel())


def sinkhorn_normalise(log_alpha: np.ndarray, iters: int = 5, slack: bool = False) -> np.ndarray:
    """Rows and columns normalised in turn; with slack an extra row and column take the rest and are not normalised."""
    if slack:
        log_alpha = np.pad(log_alpha, ((0, 1), (0, 1)))
        for _ in range(iters):
            log_alpha = np.concatenate([log_alpha[:-1] - log_sum(log_alpha[:-1], 1)[:, None], log_alpha[-1:]])
            log_alpha = np.concatenate([log_alpha[:, :-1] - log_sum(log_alpha[:, :-1], 0)[None, :], log_alpha[:, -1:]], axis=1)
        return log_alpha[:-1, :-1]
    for _ in range(iters):
        log_alpha = log_alpha - log_sum(log_alpha, 1)[:, None]
        log_alpha = log_alpha - log_sum(log_alpha, 0)[None, :]
    return log_alpha


def euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def unit_rows(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)


def gap(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of two sets of vectors: angle, histogram intersection, chord of unit vectors, or Euclidean."""
    if kind == "ang":
        return np.arccos(np.clip(unit_rows(a) @ unit_rows(b).T, -1, 1))
    if kind == "hist":
        return 1 - np.minimum(a[:, None], b[None]).sum(2) / np.minimum(a.sum(1)[:, None], b.sum(1)[None])
    return euclid(unit_rows(a), unit_rows(b)) if kind == "cos" else euclid(a, b)


def norm_mean(kind: str, mu: np.ndarray) -> np.ndarray:
    """Cluster means as their distance wants them: of length one for angles and chords."""
    return unit_rows(mu) if kind in ("ang", "cos") else mu


def norm_cost(cost: np.ndarray) -> np.ndarray:
    """A cost matrix over its range."""
    return cost / max(cost.max() - cost.min(), 1e-3)


def connected_clustering(xyz: np.ndarray, centres: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray, str, float]], iters: int = 30) -> tuple[np.ndarray, list[np.ndarray]]:
    """Soft assignment of points to fixed centres by transport costs of several feature sets: (the last plan, means of each set).

    sets: (features, first means, distance, weight). What is near a centre and likely there moves the means; a cluster
    with nothing near has the zero mean.
    """
    n, k = len(xyz), len(centres)
    far = euclid(xyz, centres)
    eps = np.sort(far, axis=1)[:, min(1, k - 1)].mean()
    means = [np.asarray(m, np.float64) for _, m, _, _ in sets]
    near = far < (np.sqrt(5) - 1) / 2 * eps
    gamma = np.ones((n, k))
    for _ in range(iters):
        cost = np.mean([w * gap(kind, x, m) for (x, _, kind, w), m in zip(sets, means, strict=True)] + [np.sqrt(1 / 3) / max(eps, 1e-4) * far], axis=0)
        gamma = sinkhorn_plan(cost, iters=10)
        kept = gamma * (near & (gamma * n * k > 1))
        kept = kept / np.maximum(kept.sum(1, keepdims=True), 1e-3)
        means = [norm_mean(kind, kept.T @ x / (kept.sum(0)[:, None] + 1e-5)) for x, _, kind, _ in sets]
    return gamma, means


def prototypes(x: np.ndarray, likeness: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of each cluster's `top` strongest rows, weighted by how strong they are, and the clusters' relative mass."""
    pick = np.argsort(-likeness, axis=0, kind="stable")[:top].T
    w = np.take_along_axis(likeness.T, pick, 1)
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-4)
    mass = w.sum(1)
    return (w[:, :, None] * x[pick]).sum(1), mass / max(mass.mean(), 1e-4)


def nearest_member(xyz: np.ndarray, nodes: np.ndarray, members: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Each point takes the feature of the member nearest to it of the patch whose node is nearest; members: (nodes, patch, 3)."""
    own = euclid(xyz, nodes).argmin(1)
    at = ((members[own] - xyz[:, None]) ** 2).sum(2).argmin(1)
    return feats[own, at]


def local_attend(nodes: np.ndarray, xyz: np.ndarray, node_hist: np.ndarray, hist: np.ndarray, f: np.ndarray, patch: int = 48) -> np.ndarray:
    """Features of all points, averaged with what their patch attends to.

    A patch is the points nearest to a node in position and histogram, each scaled by the root of its size. In it two
    transport plans of the members with themselves, of features (masses one over all points) and of histograms, are
    multiplied. Each point takes the result of the member nearest to it in the patch of its nearest node.
    """
    wide = f.shape[1]
    scaled = lambda x, h: np.hstack([x / np.sqrt(3), h / np.sqrt(h.shape[1])])
    near = np.argsort(euclid(scaled(nodes, node_hist), scaled(xyz, hist)), axis=1, kind="stable")[:, :patch]
    mass = np.full(near.shape[1], 1 / len(xyz))
    out = np.zeros((*near.shape, wide))
    for i, own in enumerate(near):
        a = sinkhorn_plan(euclid(f[own], f[own]) / np.sqrt(wide), mass, mass)
        a = a * sinkhorn_plan(euclid(hist[own] / np.sqrt(hist.shape[1]), hist[own] / np.sqrt(hist.shape[1])) / np.sqrt(wide))
        out[i] = a / np.maximum(a.sum(1, keepdims=True), 1e-300) @ f[own]
    return (f + nearest_member(xyz, nodes, xyz[near], out)) / 2


def global_attend(hist: np.ndarray, z: np.ndarray, iters: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Superpoints attend to each other by histogram and feature, and add what they see: (features, histograms)."""
    n = len(z)
    geo = np.maximum(unit_rows(hist) @ unit_rows(hist).T, 0.001)
    sim = np.clip(unit_rows(z) @ unit_rows(z).T, 0.01, 0.9) * (1 - np.eye(n)) + 1 / (n * n + 1e-6)
    a = np.exp(sinkhorn_normalise(geo / 0.01, iters)) * np.exp(sinkhorn_normalise(sim / 0.1, iters))
    a = a / np.maximum(a.sum(1, keepdims=True), 1e-300)
    return a @ z + z, a @ hist + hist


def attend(nodes: np.ndarray, xyz: np.ndarray, z: np.ndarray, f: np.ndarray, node_hist: np.ndarray, hist: np.ndarray, mode: str = "df", top: int = 0, temperature: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Features and histograms of points, averaged with what they take from superpoints.

    Modes: `dg` transport by distance and by histogram; `df` transport by distance with row and column softmax of
    features; `gf` histograms and features, each log-normalised. With `top` a point's strongest superpoints alone count.
    """
    if mode not in ("dg", "df", "gf"):
        raise ValueError(f"unknown mode {mode!r}")
    s = f @ z.T / np.sqrt(z.shape[1])
    if mode == "gf":
        a = np.exp(sinkhorn_normalise(hist @ node_hist.T / np.sqrt(hist.shape[1]), slack=True)) * np.exp(sinkhorn_normalise(s, slack=True))
    else:
        a = sinkhorn_plan(euclid(xyz, nodes))
        if mode == "dg":
            a = a * sinkhorn_plan(euclid(hist, node_hist) / np.sqrt(hist.shape[1]))
        else:
            s = s / temperature
            a = a * np.exp(s - log_sum(s, 1)[:, None]) * np.exp(s - log_sum(s, 0)[None, :])
    a = a / np.maximum(a.sum(1, keepdims=True), 1e-300)
    mixed = [prototypes(x, a.T, top)[0] if top else a @ x for x in (z, node_hist)]
    return (mixed[0] + f) / 2, (mixed[1] + hist) / 2


def spread(xyz: np.ndarray, nodes: np.ndarray, nrm: np.ndarray, node_nrm: np.ndarray, f: np.ndarray, z: np.ndarray, k: int = 8) -> np.ndarray:
    """Nodes' features interpolated to points and fused with their own: half the larger and half the mean of both.

    Distances add a sigmoid of how far normals are apart; the k nearest nodes weigh by one over distance.
    """
    if len(nodes) == 1:
        mixed = np.repeat(z, len(xyz), axis=0)
    else:
        d = euclid(xyz, nodes) + 1 / (1 + np.exp(-euclid(nrm, node_nrm)))
        pick = np.argsort(d, axis=1, kind="stable")[:, :k]
        w = 1 / (np.take_along_axis(d, pick, 1) + EPS)
        mixed = (w[:, :, None] / w.sum(1)[:, None, None] * z[pick]).sum(1)
    return (np.maximum(f, mixed) + (f + mixed) / 2) / 2


def refined(xyz: np.ndarray, nrm: np.ndarray, hist: np.ndarray, f: np.ndarray, nodes: int = 256, patch: int = 48, iters: int = 30) -> np.ndarray:
    """Features of one shape's points after the object pipeline."""
    first = int(((xyz - xyz.mean(0)) ** 2).sum(1).argmax())
    at = farthest_points(xyz, nodes, first)
    gamma, means = connected_clustering(xyz, xyz[at], [(nrm, nrm[at], "cos", 1.0), (hist, hist[at], "eu", 0.1)], iters)
    top = max(1, len(xyz) // nodes)
    node_hist, centres = prototypes(hist, gamma, top)[0], prototypes(xyz, gamma, top)[0]
    f = local_attend(centres, xyz, node_hist, hist, f, patch)
    z, node_hist = global_attend(node_hist, prototypes(f, gamma, top)[0])
    f, hist = attend(centres, xyz, z, f, node_hist, hist, "df")
    return spread(xyz, centres, nrm, means[0], f, z)


def refine_shapes(points: DataFrame, dim: int, nodes: int = 256, patch: int = 48) -> DataFrame:
    """(shape_id, pid, feat): the object pipeline on every shape, with features of length one at the end.

    Superpoints by farthest points, connected clustering on normals and geometry histograms, prototypes of the strongest
    members for positions and histograms, local attention over all points, prototypes of the features it gives, attention
    between superpoints and back to points, and interpolation. Transport plans stop by shape (by patch in the local step).
    points: (shape_id, pid, x, y, z, nx, ny, nz, fpfh array, feat array).
    """

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid")
        xyz, nrm = g[["x", "y", "z"]].to_numpy(np.float64), g[["nx", "ny", "nz"]].to_numpy(np.float64)
        hist, f = (np.stack(g[c].to_numpy()).astype(np.float64) for c in ("fpfh", "feat"))
        return pd.DataFrame({"shape_id": g["shape_id"].iloc[0], "pid": g["pid"].to_numpy(), "feat": list(refined(xyz, nrm, hist, f, nodes, patch))})

    kind = points.schema["shape_id"].dataType.simpleString()
    got = per_shape(points.select("shape_id", "pid", "x", "y", "z", "nx", "ny", "nz", "fpfh", "feat"), kernel, f"shape_id {kind}, pid long, feat array<double>")
    return with_unit(got, "feat")


def segment_shapes(points: DataFrame, classes: DataFrame, parts: DataFrame, dim: int, nodes: int = 256, patch: int = 48) -> DataFrame:
    """Part segmentation with scores: (category, accuracy, iou, shapes).

    points as in refine_shapes with (category, part); classes: (category, cls, emb), the texts of a category's parts;
    parts: (category, part). Every category's points are scored against its own parts alone.
    """
    found = refine_shapes(points, dim, nodes, patch).join(points.select("shape_id", "pid", "category", "part"), ["shape_id", "pid"])
    scored = found.join(classes.select("category", "cls", "emb"), "category").withColumn("s", dot(F.col("feat"), F.col("emb")))
    best = scored.groupBy("shape_id", "category", "pid", "part").agg(F.max(F.struct("s", (-F.col("cls")).alias("c"))).alias("b"))
    pred = best.select("shape_id", "category", "pid", "part", (-F.col("b.c")).cast("int").alias("pred"))
    iou = shape_iou(pred, parts)
    right = pred.groupBy("shape_id").agg(F.avg((F.col("part") == F.col("pred")).cast("double")).alias("right"))
    return iou.join(right, "shape_id").groupBy("category").agg((100 * F.avg("right")).alias("accuracy"), (100 * F.avg("iou")).alias("iou"), F.count("*").alias("shapes"))


def weight_grid(views: int = 10, fixed: int = 4, base: float = 0.75, steps: Sequence[float] = (0.25, 0.5, 0.75, 1.0)) -> list[list[float]]:
    """Weights of all views: the first ones fixed, each of the others from `steps`, in order."""
    return [[base] * fixed + list(x) for x in itertools.product(steps, repeat=views - fixed)]


def search_view_weights(seen: DataFrame, classes: DataFrame, parts: DataFrame, grid: list[list[float]]) -> DataFrame:
    """(category, trial, accuracy, iou, best): every trial of view weights, and the first of the highest IoU of each category.

    seen: (shape_id, category, pid, part, view, is_seen, feat). Class scores are linear in the weights, so each view is
    scored once and trials sum numbers a class, not vectors; the grid is a literal table of bounded size.
    """
    spark = seen.sparkSession
    scored = seen.join(classes.select("category", "cls", "emb"), "category").withColumn("s", F.col("is_seen") * dot(F.col("feat"), F.col("emb")))
    scored = scored.groupBy("shape_id", "category", "pid", "part", "cls").agg(F.map_from_entries(F.collect_list(F.struct("view", "s"))).alias("by_view"))
    trials = small(spark.createDataFrame(list(enumerate(grid)), "trial int, weights array<double>"), "trials")
    total = F.aggregate(F.map_entries("by_view"), F.lit(0.0), lambda a, e: a + e["value"] * F.element_at("weights", e["key"].cast("int") + 1))
    tried = scored.join(F.broadcast(trials)).select("trial", "shape_id", "category", "pid", "part", F.struct(total.alias("s"), (-F.col("cls")).alias("c")).alias("b"))
    pred = tried.groupBy("trial", "shape_id", "category", "pid", "part").agg(F.max("b").alias("b")).select("trial", "shape_id", "category", "pid", "part", (-F.col("b.c")).cast("int").alias("pred"))
    # a trial's shape is a shape of its own to the scores
    named = pred.withColumn("shape_id", F.struct("trial", "shape_id"))
    iou = shape_iou(named, parts).join(named.groupBy("shape_id").agg(F.avg((F.col("part") == F.col("pred")).cast("double")).alias("right")), "shape_id")
    got = iou.groupBy("category", F.col("shape_id.trial").alias("trial")).agg((100 * F.avg("right")).alias("accuracy"), (100 * F.avg("iou")).alias("iou"))
    top = got.groupBy("category").agg(F.max(F.struct("iou", (-F.col("trial")).alias("t"))).alias("__top"))
    return got.join(top, "category").withColumn("best", F.col("trial") == -F.col("__top.t")).drop("__top")


def search_prompts(scored: DataFrame, parts: DataFrame, first: dict[int, int], candidates: dict[int, list[int]], passes: int = 2) -> tuple[dict[int, int], float]:
    """Coordinate search over prompts of a category: (chosen prompt of each part, IoU).

    scored: (shape_id, category, pid, part, prompt, s), how alike each point and prompt are. A part's candidates are tried
    in one job, each against the prompts chosen for the others; one that raises the IoU most is kept (ties: the first).
    """
    spark, chosen = scored.sparkSession, dict(first)

    def trials(options: list[dict[int, int]]) -> list[float]:
        rows = [(i, cls, prompt) for i, o in enumerate(options) for cls, prompt in o.items()]
        table = small(spark.createDataFrame(rows, "trial int, cls int, prompt int"), "prompts")
        met = scored.join(F.broadcast(table), "prompt").groupBy("trial", "shape_id", "category", "pid", "part").agg(F.max(F.struct("s", (-F.col("cls")).alias("c"))).alias("b"))
        named = met.select(F.struct("trial", "shape_id").alias("shape_id"), "category", "pid", "part", (-F.col("b.c")).cast("int").alias("pred"))
        got = {r["trial"]: r["iou"] for r in shape_iou(named, parts).groupBy("shape_id.trial").agg(F.avg("iou").alias("iou")).collect()}  # a row a trial
        return [got.get(i, 0.0) for i in range(len(options))]

    best = trials([chosen])[0]
    for _ in range(passes):
        for part, options in candidates.items():
            tried = trials([chosen | {part: o} for o in options]) if options else []
            if tried and max(tried) > best:
                best = max(tried)
                chosen[part] = options[tried.index(best)]
    return chosen, best


def weighted_kmeans(x: np.ndarray, centres: np.ndarray, iters: int = 10, top: int = 0, tau: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Balanced soft k-means: transport of points to centres over a temperature, then means of the `top` strongest (0: of all)."""
    gamma = np.ones((len(x), len(centres)))
    for _ in range(iters):
        gamma = sinkhorn_plan(euclid(x, centres / tau), epsilon=1e-3)
        centres = prototypes(x, gamma, top)[0] if top else gamma.T @ x / (gamma.sum(0)[:, None] + 1e-5)
    return gamma, centres


def density_clusters(points: DataFrame, eps: float = 0.15, least: int = 20, key: str = "shape_id", mean: bool = False) -> DataFrame:
    """(key, k, size, centre): clusters of dense vectors by cosine distance, numbered by their first member; centre its
    first member or their mean. Vectors with `least` others (itself counted) within `eps` are cores; cores in reach join.

    points: (key, pid, feat); a shape is a kernel, its pairs are compared a block of rows at a time.
    """

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid")
        x = unit_rows(np.stack(g["feat"].to_numpy()).astype(np.float64))
        near = [np.flatnonzero(1 - row <= eps) for lo in range(0, len(x), 512) for row in x[lo : lo + 512] @ x.T]
        core = np.array([len(v) >= least for v in near])
        label = np.full(len(x), -1)
        k = 0
        for i in np.flatnonzero(core):
            if label[i] >= 0:
                continue
            label[i], stack = k, [i]
            while stack:
                for j in near[stack.pop()]:
                    if label[j] < 0:
                        label[j] = k
                        if core[j]:
                            stack.append(j)
            k += 1
        f = np.stack(g["feat"].to_numpy()).astype(np.float64)
        rows = [(i, int((label == i).sum()), f[label == i].mean(0) if mean else f[label == i][0]) for i in range(k)]
        return pd.DataFrame({key: g[key].iloc[0], "k": [r[0] for r in rows], "size": [r[1] for r in rows], "centre": [r[2] for r in rows]})

    kind = points.schema[key].dataType.simpleString()
    return per_shape(points.select(key, "pid", "feat"), kernel, f"{key} {kind}, k long, size long, centre array<double>", [key])


def principal_colours(points: DataFrame, dim: int, vector: str = "feat", keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, pid, r, g, b): the first three principal components of each scene's vectors, each scaled to 0..1.

    Sums of products are a dim x dim matrix a scene, added up over Arrow batches before the shuffle; the sign of a
    component is that of its largest coefficient.
    """
    keys = list(keys)
    source = points.select(*keys, "pid", F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)

    def partial(frames):
        for frame in frames:
            for key, own in frame.groupby(keys, dropna=False):
                x = np.stack(own["v"].to_numpy())
                yield pd.DataFrame({k: [v] for k, v in zip(keys, key, strict=True)} | {"n": [len(x)], "s": [x.sum(0)], "p": [(x.T @ x).ravel()]})

    def axes(g: pd.DataFrame) -> pd.DataFrame:
        n = g["n"].sum()
        mean = np.sum(np.stack(g["s"].to_numpy()), axis=0) / n
        cov = np.sum(np.stack(g["p"].to_numpy()), axis=0).reshape(dim, dim) / n - np.outer(mean, mean)
        v = np.linalg.eigh(cov)[1][:, ::-1][:, :3]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)
        v = np.pad(v, ((0, 0), (0, 3 - v.shape[1])))
        return pd.DataFrame({k: [g[k].iloc[0]] for k in keys} | {"mean": [mean], "axes": [v.T.ravel()]})

    found = source.mapInPandas(partial, f"{kinds}, n long, s array<double>, p array<double>").groupBy(*keys).applyInPandas(axes, f"{kinds}, mean array<double>, axes array<double>")
    placed = source.join(found, keys).withColumn("c", F.zip_with("v", "mean", lambda x, m: x - m))
    placed = placed.select(*keys, "pid", *[dot(F.col("c"), F.slice("axes", dim * i + 1, dim)).alias(c) for i, c in enumerate("rgb")])
    box = placed.groupBy(*keys).agg(*[F.min(c).alias(f"lo{c}") for c in "rgb"], *[F.max(c).alias(f"hi{c}") for c in "rgb"])
    return placed.join(box, keys).select(*keys, "pid", *[((F.col(c) - F.col(f"lo{c}")) / F.greatest(F.col(f"hi{c}") - F.col(f"lo{c}"), F.lit(1e-12))).alias(c) for c in "rgb"])
