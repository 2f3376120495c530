"""Adjacency-constrained merging of regions in rounds of mutual best matches, over region tables only.

Features enter as sums and normals as sums of products, which add up over merged regions, so points are scanned once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.vectors import TINY, dot, norm, sums, with_unit
from pointloom.operators.segment import PAIRS, eigenvector, moments, summed

MOMENTS = [f"c{a}{b}" for a, b in PAIRS]
SCENE_REGIONS = 20_000  # regions of a scene that merge in one task; 160 MB of sums at 1,024 components


def base_regions(points: DataFrame, dim: int, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, seg, zsum, cxx..czz): sums of the valid points' unit vectors, and of all points' normal products."""
    weighted = points.withColumn("__w", F.col("valid").cast("double") / F.greatest(norm(F.col("feat")), F.lit(TINY)))
    z = summed(weighted, [*keys, "seg"], "feat", dim, "__w", "zsum").select(*keys, "seg", "zsum")
    return z.join(moments(points, [*keys, "seg"]).drop("n"), [*keys, "seg"])


def merge_round(regions: DataFrame, region_edges: DataFrame, parent: DataFrame, dim: int, th_f: float = 0.85, th_n: float = 0.30, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """One round; parent (keys, seg, root) comes back with merged roots.

    Roots m and n are admissible if their cosine, the agreement of their mean normals and that along their boundary
    reach the thresholds. Each root names its most similar admissible partner (within 1e-6 the lowest id); two that name
    each other merge into the lower id.
    """
    keys = list(keys)
    own = regions.join(parent, [*keys, "seg"])
    merged = own.groupBy(*keys, "root").agg(sums("zsum", dim).alias("z"), *[F.sum(c).alias(c) for c in MOMENTS])
    merged = with_unit(merged, "z").withColumn("v", eigenvector(True)).select(*keys, "root", "z", "v")
    side = lambda a, b: parent.select(*keys, F.col("seg").alias(a), F.col("root").alias(b))
    edges = region_edges.join(side("m", "rm"), [*keys, "m"]).join(side("n", "rn"), [*keys, "n"]).where("rm <> rn")
    edges = edges.groupBy(*keys, "rm", "rn").agg((F.sum("bsum") / F.sum("cnt")).alias("b")).where(F.col("b") >= th_n)
    at = lambda r, s: merged.select(*keys, F.col("root").alias(r), F.col("z").alias(f"z{s}"), F.col("v").alias(f"v{s}"))
    scored = edges.join(at("rm", "m"), [*keys, "rm"]).join(at("rn", "n"), [*keys, "rn"])
    agree = F.abs(sum(F.col(f"vm.{c}") * F.col(f"vn.{c}") for c in "xyz"))
    ok = scored.withColumn("sim", dot(F.col("zm"), F.col("zn"))).where((F.col("sim") >= th_f) & (agree >= th_n)).select(*keys, "rm", "rn", "sim")
    top = F.max("sim").over(Window.partitionBy(*keys, "rm"))
    best = ok.withColumn("top", top).where("sim >= top - 1e-6").groupBy(*keys, "rm").agg(F.min("rn").alias("rn"))
    mutual = best.join(best.select(*keys, F.col("rm").alias("rn"), F.col("rn").alias("back")), [*keys, "rn"]).where("back = rm")
    moved = mutual.where("rn < rm").select(*keys, F.col("rm").alias("root"), F.col("rn").alias("into"))
    return parent.join(moved, [*keys, "root"], "left").select(*keys, "seg", F.coalesce("into", "root").alias("root"))


def merge_scene(sums_: np.ndarray, products: np.ndarray, m: np.ndarray, n: np.ndarray, cnt: np.ndarray, bsum: np.ndarray, rounds: int, th_f: float, th_n: float) -> np.ndarray:
    """Root of each region of one scene, by the rounds of merge_round over arrays; m and n are places of regions in order of id."""
    root = np.arange(len(sums_))
    for _ in range(rounds):
        live, at = np.unique(root, return_inverse=True)
        z, p = np.zeros((len(live), sums_.shape[1])), np.zeros((len(live), 6))
        np.add.at(z, at, sums_)
        np.add.at(p, at, products)
        z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), TINY)
        v = np.linalg.eigh(p[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))[1][:, :, 2]
        a, b = at[m], at[n]
        cross = a != b
        pair, of = np.unique(a[cross] * len(live) + b[cross], return_inverse=True)
        agree = np.bincount(of, bsum[cross], len(pair)) / np.maximum(np.bincount(of, cnt[cross], len(pair)), 1)
        a, b = pair // len(live), pair % len(live)
        sim = (z[a] * z[b]).sum(1)
        ok = (agree >= th_n) & (sim >= th_f) & (np.abs((v[a] * v[b]).sum(1)) >= th_n)
        a, b, sim = a[ok], b[ok], sim[ok]
        top = np.full(len(live), -np.inf)
        np.maximum.at(top, a, sim)
        near = sim >= top[a] - 1e-6
        best = np.full(len(live), len(live))
        np.minimum.at(best, a[near], b[near])
        own = np.flatnonzero(best < len(live))
        moved = own[(best[own] < own) & (best[best[own]] == own)]
        if not len(moved):
            break
        into = live.copy()
        into[moved] = live[best[moved]]
        root = into[at]
    return root


def hier_merge(regions: DataFrame, region_edges: DataFrame, dim: int, rounds: int = 10, th_f: float = 0.85, th_n: float = 0.30, keys: Sequence[str] = ("scene",), cut: Callable[[DataFrame], DataFrame] | None = None, scene_regions: int = SCENE_REGIONS) -> DataFrame:
    """Rounds until nothing changes: (keys, seg, root).

    Merging sees tables of regions, not points, so the regions of a scene, up to `scene_regions` of them, are one
    kernel and all scenes merge at once. Scenes of more regions go through rounds of joins; `cut` stores a table between
    those (default: checkpoint).
    """
    from pointloom.plans.storage import stored

    keys, cut = list(keys), cut or stored
    regions, region_edges = cut(regions), cut(region_edges)
    many = regions.groupBy(*keys).count().where(F.col("count") > scene_regions).select(*keys)
    if many.isEmpty():
        return _by_scene(regions, region_edges, rounds, th_f, th_n, keys)
    part = lambda d, how: d.join(many, keys, how).select(*[F.col(c).alias(c) for c in d.columns])
    small, large = (tuple(part(d, how) for d in (regions, region_edges)) for how in ("left_anti", "left_semi"))
    return _by_scene(*small, rounds, th_f, th_n, keys).unionByName(_by_rounds(*large, dim, rounds, th_f, th_n, keys, cut))


def _by_scene(regions: DataFrame, region_edges: DataFrame, rounds: int, th_f: float, th_n: float, keys: list[str]) -> DataFrame:
    def kernel(r: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(r):
            return pd.DataFrame({k: [] for k in [*keys, "seg", "root"]})
        r = r.sort_values("seg")
        seg = r["seg"].to_numpy()
        known = np.isin(e["m"], seg) & np.isin(e["n"], seg) & (e["m"] != e["n"]).to_numpy() if len(e) else np.zeros(0, bool)
        e = e[known]
        m, n = (np.searchsorted(seg, e[c]) for c in ("m", "n"))
        z = np.nan_to_num(np.stack(r["zsum"].to_numpy()).astype(np.float64))
        root = merge_scene(z, np.nan_to_num(r[MOMENTS].to_numpy(np.float64)), m, n, e["cnt"].to_numpy(np.float64), e["bsum"].to_numpy(np.float64), rounds, th_f, th_n)
        return r[[*keys, "seg"]].assign(root=seg[root])

    kinds = ", ".join(f"`{k}` {regions.schema[k].dataType.simpleString()}" for k in [*keys, "seg"])
    both = regions.groupBy(*keys).cogroup(region_edges.groupBy(*keys))
    return both.applyInPandas(kernel, f"{kinds}, root {regions.schema['seg'].dataType.simpleString()}")


def _by_rounds(regions: DataFrame, region_edges: DataFrame, dim: int, rounds: int, th_f: float, th_n: float, keys: list[str], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sums and contacts follow the roots: what merged is summed anew, everything else is carried over."""
    whole = parent = cut(regions.select(*keys, "seg", F.col("seg").alias("root")))
    regions, region_edges = cut(regions.select(*keys, "seg", "zsum", *MOMENTS)), cut(region_edges.select(*keys, "m", "n", "cnt", "bsum"))
    for _ in range(rounds):
        new = cut(merge_round(regions, region_edges, parent, dim, th_f, th_n, keys))
        moved = cut(new.where("seg <> root"))
        if moved.isEmpty():
            break
        both = moved.select(*keys, F.explode(F.array("seg", "root")).alias("seg")).distinct()
        summed = regions.join(both, [*keys, "seg"], "left_semi").join(new, [*keys, "seg"]).groupBy(*keys, F.col("root").alias("seg")).agg(sums("zsum", dim).alias("zsum"), *[F.sum(c).alias(c) for c in MOMENTS])
        regions = cut(regions.join(both, [*keys, "seg"], "left_anti").unionByName(summed))
        side = lambda c: moved.select(*keys, F.col("seg").alias(c), F.col("root").alias(f"r{c}"))
        edges = region_edges.join(side("m"), [*keys, "m"], "left").join(side("n"), [*keys, "n"], "left")
        edges = edges.select(*keys, F.coalesce("rm", "m").alias("m"), F.coalesce("rn", "n").alias("n"), "cnt", "bsum").where("m <> n")
        region_edges = cut(edges.groupBy(*keys, "m", "n").agg(F.sum("cnt").alias("cnt"), F.sum("bsum").alias("bsum")))
        whole = cut(whole.join(moved.select(*keys, F.col("seg").alias("root"), F.col("root").alias("into")), [*keys, "root"], "left").select(*keys, "seg", F.coalesce("into", "root").alias("root")))
        parent = regions.select(*keys, "seg", F.col("seg").alias("root"))
    return whole
