"""Confidence of points within regions, attention between regions, and recovery of point features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vectors import EPS, dot, with_unit
from pointloom.operators.segment import region_normals, segment_mean, segment_softmax, summed

HISTOGRAM = 33  # bins of a geometry histogram


def region_model(points: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, seg, a{x,y,z}, m{x,y,z}, and, where points have them, c{r,g,b} and unit mean `gbar` of fpfh) of every region."""
    own = [*keys, "seg"]
    got = region_normals(points, own).select(*own, *[F.col(f"n{c}").alias(f"m{c}") for c in "xyz"])
    means = [F.avg(c).alias(f"a{c}") for c in "xyz"] + ([F.avg(c).alias(f"c{c}") for c in "rgb"] if "r" in points.columns else [])
    got = got.join(points.groupBy(*own).agg(*means), own)
    if "fpfh" in points.columns:
        g = segment_mean(points.withColumn("__one", F.lit(1.0)), own, HISTOGRAM, "fpfh", "__one", "gbar").select(*own, "gbar")
        got = got.join(with_unit(g, "gbar"), own)
    return got


def structural_confidence(points: DataFrame, gamma: float = 1.0, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, pid, seg, q): exp(-gamma * mean of residuals over the region's scale, each at most 10).

    Residuals: distance from the region's plane, disagreement of unit normals, disagreement with the region's mean
    geometry histogram (where points have `fpfh`) and colour distance (where they have colour). A scale is the region's
    mean residual, a hundredth of the scene's mean at least. Normals are taken to be of length one.
    """
    own = [*keys, "seg"]
    joined = points.join(region_model(points, keys), own)
    cues = {
        "d1": F.abs(sum((F.col(c) - F.col(f"a{c}")) * F.col(f"m{c}") for c in "xyz")),
        "d2": F.greatest(F.lit(0.0), 1 - F.abs(sum(F.col(f"n{c}") * F.col(f"m{c}") for c in "xyz"))),
    }
    if "fpfh" in points.columns:
        joined = with_unit(joined, "fpfh")
        cues["d3"] = F.greatest(F.lit(0.0), 1 - dot(F.col("fpfh"), F.col("gbar")))
    if "r" in points.columns:
        cues["d4"] = F.sqrt(sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in "rgb"))
    rows = joined.select(*own, "pid", *[v.alias(k) for k, v in cues.items()])
    scene = rows.groupBy(*keys).agg(*[F.avg(k).alias(f"w{k}") for k in cues])
    region = rows.groupBy(*own).agg(*[F.avg(k).alias(f"s{k}") for k in cues]).join(scene, list(keys))
    region = region.select(*own, *[F.greatest(F.col(f"s{k}"), 0.01 * F.col(f"w{k}"), F.lit(EPS)).alias(f"s{k}") for k in cues])
    mean = sum(F.least(F.col(k) / F.col(f"s{k}"), F.lit(10.0)) for k in cues) / len(cues)
    return rows.join(region, own).select(*own, "pid", F.exp(-gamma * mean).alias("q"))


def inter_attention(regions: DataFrame, region_edges: DataFrame, dim: int, gamma0: float = 0.5, sigma: float = 0.25, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, seg, z2, gate): residual attention over the region graph.

    regions: region_model with z (keys, seg, z, m{x,y,z}, perhaps c{r,g,b} and gbar); region_edges: (keys, m, n, cnt,
    bsum). Scores are similarities of features, of geometry histograms (where there are any) and of normals, each over its
    mean gap on the scene's edges, plus the log of boundary agreement and, where there is colour, of nearness in colour;
    the entropy of a region's weights gates the step.
    """
    keys = list(keys)
    colour, shape = "cr" in regions.columns, "gbar" in regions.columns
    cols = ["z", *[f"m{c}" for c in "xyz"], *([f"c{c}" for c in "rgb"] if colour else []), *(["gbar"] if shape else [])]
    side = lambda k, s: regions.select(*keys, F.col("seg").alias(k), *[F.col(c).alias(f"{s}{c}") for c in cols])
    e = region_edges.join(side("m", "p"), [*keys, "m"]).join(side("n", "q"), [*keys, "n"])
    near = F.col("bsum") / F.greatest("cnt", F.lit(1))
    if colour:
        near = near * F.exp(-sum((F.col(f"pc{c}") - F.col(f"qc{c}")) ** 2 for c in "rgb") / sigma**2)
    likes = {"sf": dot(F.col("pz"), F.col("qz")), "sn": F.abs(sum(F.col(f"pm{c}") * F.col(f"qm{c}") for c in "xyz"))}
    if shape:
        likes["sg"] = dot(F.col("pgbar"), F.col("qgbar"))
    e = e.withColumns(likes | {"near": near})
    tau = e.groupBy(*keys).agg(*[F.greatest(F.avg(1 - F.col(k)), F.lit(EPS)).alias(f"t{k}") for k in likes])
    e = e.join(tau, keys).withColumn("e", sum(F.col(k) / F.col(f"t{k}") for k in likes) + F.log(F.col("near") + EPS))
    a = segment_softmax(e.select(*keys, "m", "n", "e", F.zip_with("qz", "pz", lambda x, y: x - y).alias("dz")), [*keys, "m"], "e")
    a = a.withColumn("__h", -F.col("a") * F.log(F.col("a") + EPS))
    step = summed(a, [*keys, "m"], "dz", dim, "a", "d").withColumnRenamed("n", "deg").join(a.groupBy(*keys, "m").agg(F.sum("__h").alias("ent")), [*keys, "m"]).withColumnRenamed("m", "seg")
    gate = gamma0 * F.least(F.greatest(1 - F.col("ent") / F.log(F.greatest(F.col("deg"), F.lit(2)).cast("double")), F.lit(0.0)), F.lit(1.0))
    out = regions.select(*keys, "seg", "z").join(step, [*keys, "seg"], "left").withColumn("gate", F.coalesce(gate, F.lit(0.0)))
    moved = F.when(F.col("d").isNull(), F.col("z")).otherwise(F.zip_with("z", F.transform("d", lambda x: x * F.col("gate")), lambda x, y: x + y))
    return with_unit(out.withColumn("z2", moved), "z2").select(*keys, "seg", "z2", "gate")


def recover(points: DataFrame, regions: DataFrame, alpha_min: float = 1.0, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, pid, out): features drawn towards their region's.

    points: (keys, pid, seg, feat, valid, q); regions: (keys, seg, z, z2, gate). With alpha_min 1 every point of a
    region has one result, so classify regions and join labels instead.
    """
    mean = points.groupBy(*keys, "seg").agg(F.avg("q").alias("mq"))
    points = points.select(*keys, "seg", "pid", "feat", "valid", "q")  # coordinates may share names with regions' columns
    joined = with_unit(points, "feat").join(regions, [*keys, "seg"]).join(mean, [*keys, "seg"])
    share = F.least(F.greatest(F.col("q") / F.greatest("mq", F.lit(EPS)), F.lit(0.0)), F.lit(1.0))
    alpha = F.when(~F.col("valid"), 1.0).otherwise(alpha_min + (1 - alpha_min) * share)
    joined = joined.withColumn("__a", alpha).withColumn("__b", F.when(F.col("gate") > 0, F.col("__a")).otherwise(0.0))
    trio = F.arrays_zip(F.col("feat").alias("f"), F.col("z").alias("z"), F.col("z2").alias("y"))
    mixed = F.transform(trio, lambda t: t["f"] + F.col("__a") * (t["z"] - t["f"]) + F.col("__b") * (t["y"] - t["z"]))
    return with_unit(joined.withColumn("out", mixed), "out").select(*keys, "pid", "out")


def intra_consensus(points: DataFrame, anchors: int = 128, keys: Sequence[str] = ("scene",), blend: str = "entropy") -> DataFrame:
    """(keys, seg, z, eta): prototype of a region from the agreement of its points with a bounded set of anchors.

    Gaps between points: features, normals, colours, positions and, where points have `fpfh`, geometry histograms.
    Anchors are the valid points with the smallest hashes; the kernel sees a region at a time. Regions are bounded by
    the over-segmentation that made them (hundreds of points), which is what allows a grouped kernel.
    """
    own = [*keys, "seg"]
    rows = points.select(*own, "pid", "x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "feat", *(["fpfh"] if "fpfh" in points.columns else []), F.col("valid").cast("double").alias("w"), F.coalesce(F.col("q") if "q" in points.columns else F.lit(1.0), F.lit(1.0)).alias("q"), F.xxhash64("pid").alias("h"))

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["w", "h", "pid"], ascending=[False, True, True])
        f = np.stack(group["feat"].to_numpy()).astype(np.float64)
        f /= np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-12)
        ok, q = group["w"].to_numpy() > 0, group["q"].to_numpy()
        head = group.iloc[:1][own].to_dict("list")
        mean = (f * ok[:, None]).sum(0) / max(ok.sum(), EPS)
        unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
        if not ok.any():
            return pd.DataFrame(head | {"z": [np.zeros(f.shape[1])], "eta": [0.0]})
        a = np.flatnonzero(ok)[:anchors]
        xyz, nrm, rgb = (group[list(c)].to_numpy(np.float64) for c in (("x", "y", "z"), ("nx", "ny", "nz"), ("r", "g", "b")))
        gaps = [np.maximum(1 - f[a] @ f.T, 0), np.maximum(1 - np.abs(nrm[a] @ nrm.T), 0), ((rgb[a][:, None] - rgb[None]) ** 2).sum(2), ((xyz[a][:, None] - xyz[None]) ** 2).sum(2)]
        if "fpfh" in group:
            g = np.stack(group["fpfh"].to_numpy()).astype(np.float64)
            g /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
            gaps.append(np.maximum(1 - g[a] @ g.T, 0))
        e = -sum(np.minimum(d / max(d[:, ok].mean(), EPS), 50) for d in gaps)
        e = np.exp(e - e[:, ok].max(1, keepdims=True)) * ok
        r = (e / e.sum(1, keepdims=True)).sum(0) / len(a)
        u = r * q * ok
        w = u / max(u.sum(), EPS)
        eta = float(np.clip(1 + (w * np.log(w + EPS)).sum() / np.log(max(ok.sum(), 2)), 0, 1))
        z = unit((w[:, None] * f).sum(0))
        c = f @ z
        s = c / max((1 - c[ok]).mean(), EPS) + np.log(q + EPS)
        s = np.exp(s - s[ok].max()) * ok
        att = (s[:, None] / s.sum() * f).sum(0)
        share = {"entropy": eta, "mean": 0.0, "att": 1.0}[blend]
        return pd.DataFrame(head | {"z": [unit((1 - share) * unit(mean) + share * unit(att))], "eta": [eta]})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in own)
    return rows.groupBy(*own).applyInPandas(kernel, f"{kinds}, z array<double>, eta double")


