"""The evaluation queries: per-point baseline, pooled regions, merged regions, vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vectors import with_unit
from pointloom.operators import classify, graph, merge, metrics
from pointloom.operators.attention import inter_attention, recover, region_model, structural_confidence
from pointloom.operators.segment import pooled
from pointloom.plans.storage import stored


def point_predictions(points: DataFrame, classes: DataFrame) -> DataFrame:
    """(pid, pred, sim) of every point on its own."""
    return classify.argmax_class(with_unit(points, "feat"), classes, ["pid"], "feat")


def pooled_predictions(points: DataFrame, classes: DataFrame, dim: int, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, pid, seg, gt, pred): regions are classified, and their labels joined to the points."""
    own = [*keys, "seg"]
    found = classify.argmax_class(pooled(points, own, dim), classes, own)
    return points.select(*own, "pid", "gt").join(found.select(*own, "pred"), own)


def refined_predictions(points: DataFrame, region_edges: DataFrame, classes: DataFrame, dim: int, th_f: float = 0.85, th_n: float = 0.30, rounds: int = 10, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Like pooled_predictions, over merged regions. Merging works on region tables; points are joined at the end."""
    own = [*keys, "seg"]
    parent = merge.hier_merge(merge.base_regions(points, dim, keys), region_edges, dim, rounds, th_f, th_n, keys)
    moved = points.join(parent, own).drop("seg").withColumnRenamed("root", "seg")
    return pooled_predictions(moved, classes, dim, keys)


def refine(points: DataFrame, edges: DataFrame, dim: int, th_f: float = 0.85, th_n: float = 0.30, rounds: int = 10, gamma0: float = 0.5, alpha_min: float = 1.0, intra: bool = False, knn: int = 12, keys: Sequence[str] = ("scene",)) -> tuple[DataFrame, DataFrame]:
    """The whole refinement: confidence, merging, attention between merged regions, recovery of point features.

    Returns points (keys, pid, seg, root, out) and regions (keys, seg, z, z2, gate), seg the merged region there.
    edges: directed neighbour pairs of points (keys, i, j). Confidence weighs points only if `intra` and alpha_min < 1;
    the prototypes of intra_consensus are a query of their own, as merging pools anew. gamma0 = 0 leaves attention out.
    Tables of regions are stored, as several steps read them.
    """
    keys, own = list(keys), [*keys, "seg"]
    q = stored(structural_confidence(points, 1.0, keys).select(*keys, "pid", "q")) if intra else points.select(*keys, "pid", F.lit(1.0).alias("q"))
    edges = stored(edges.select(*keys, "i", "j"))
    parent = merge.hier_merge(merge.base_regions(points, dim, keys), graph.boundary(edges, points, keys), dim, rounds, th_f, th_n, keys)
    moved = stored(points.join(parent, own).withColumnRenamed("seg", "base").withColumnRenamed("root", "seg"))
    z = stored(pooled(moved, own, dim).select(*own, "z"))
    if gamma0 > 0:
        region_edges = stored(graph.degree_cap(graph.boundary(edges, moved, keys), knn, keys))
        model = stored(region_model(moved, keys).join(z, own))
        regions = stored(z.join(inter_attention(model, region_edges, dim, gamma0, keys=keys), own))
    else:
        regions = z.withColumns({"z2": F.col("z"), "gate": F.lit(0.0)})
    out = recover(moved.join(q, [*keys, "pid"]), regions, alpha_min, keys)
    return moved.select(*keys, "pid", F.col("base").alias("seg"), F.col("seg").alias("root")).join(out, [*keys, "pid"]), regions


def refined_point_scores(points: DataFrame, edges: DataFrame, classes: DataFrame, dim: int, n_classes: int, **options) -> DataFrame:
    """Scores of the refined point features."""
    out, _ = refine(points, edges, dim, **options)
    found = classify.argmax_class(out, classes, ["scene", "pid"], "out")
    return metrics.scores(metrics.confusion(points.select("scene", "pid", "gt").join(found, ["scene", "pid"]), n_classes))


def scene_run(points: DataFrame, edges: DataFrame, classes: DataFrame, dim: int, n_classes: int, th_f: float = 0.85, th_n: float = 0.30, rounds: int = 10, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """One run at chosen thresholds: (keys, method, miou, macc, oa, present, regions, merged), a row a scene and method."""
    keys, own = list(keys), [*keys, "seg"]
    out, regions = refine(points, edges, dim, th_f, th_n, rounds, 0.0, keys=keys)
    gt = points.select(*keys, "pid", "gt")
    found = {
        "refined": classify.argmax_class(out, classes, [*keys, "pid"], "out"),
        "pooled": pooled_predictions(points, classes, dim, keys).select(*keys, "pid", "pred"),
        "point": classify.argmax_class(with_unit(points, "feat"), classes, [*keys, "pid"], "feat"),
    }
    rows = None
    for name, pred in found.items():
        one = gt.join(pred.select(*keys, "pid", "pred"), [*keys, "pid"]).withColumn("method", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    counts = out.groupBy(*keys).agg(F.count_distinct("seg").alias("regions"), F.count_distinct("root").alias("merged"))
    return metrics.scores(metrics.confusion(rows, n_classes, [*keys, "method"]), [*keys, "method"]).join(counts, keys)


def refined_scores(points: DataFrame, region_edges: DataFrame, classes: DataFrame, dim: int, n_classes: int, th_f: float, th_n: float, rounds: int = 10) -> DataFrame:
    found = refined_predictions(points, region_edges, classes, dim, th_f, th_n, rounds)
    return metrics.scores(metrics.confusion(found, n_classes))


def vocabulary_probe(points: DataFrame, vocabularies: dict[str, tuple[DataFrame, DataFrame | None]], dim: int, n_classes: int) -> DataFrame:
    """(vocab, pooling, miou, macc, oa, present) for several class tables, each with an optional remap."""
    out = None
    for name, (table, mapping) in vocabularies.items():
        cls = "cls" if mapping is None else "idx"
        by_point = classify.argmax_class(with_unit(points, "feat"), table, ["scene", "pid"], "feat", cls)
        by_region = classify.argmax_class(pooled(points, ["scene", "seg"], dim), table, ["scene", "seg"], "z", cls)
        for pooling, pred, on in (("point", by_point, ["scene", "pid"]), ("region", by_region, ["scene", "seg"])):
            pred = pred if mapping is None else classify.remap(pred, mapping)
            got = metrics.scores(metrics.confusion(points.join(pred, on), n_classes)).select(F.lit(name).alias("vocab"), F.lit(pooling).alias("pooling"), "*")
            out = got if out is None else out.unionByName(got)
    return out
