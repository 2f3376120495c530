"""All registered queries of the point-cloud engine: operators applied to the derived clouds, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom import oracles
from pointloom.functions import colour, curves, vectors
from pointloom.operators import attention, classify, geometry, graph, merge, metrics, nearest, projection, segment, shape, supervoxel
from pointloom.plans import evaluate
from pointloom.plans.storage import stored
from pointloom.sources import export, scenes, text
from pointloom.sources.fixtures import DIM, big_features, big_points, classes, detail_classes, features, table, vec_points

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    """Rounded, with no negative zero."""
    return df.withColumns({c: F.round(c, to) + 0.0 for c in columns})


@query
def point_argmax(spark, sf):
    return rounded(evaluate.point_predictions(vec_points(spark, sf), classes(spark, sf)), "sim")


@query
def region_meanpool(spark, sf):
    points = big_features(spark, sf)
    return metrics.confusion(evaluate.pooled_predictions(points, classes(spark, sf), DIM), 10)


@query
def region_meanpool_metrics(spark, sf):
    points = big_features(spark, sf)
    return rounded(metrics.scores(metrics.confusion(evaluate.pooled_predictions(points, classes(spark, sf), DIM), 10)), "miou", "macc", "oa")


@query
def per_scene_metrics(spark, sf):
    points = big_features(spark, sf)
    found = metrics.confusion(evaluate.pooled_predictions(points, classes(spark, sf), DIM), 10, ["scene"])
    return rounded(metrics.scores(found, ["scene"]), "miou", "macc", "oa")


@query
def vocab_remap(spark, sf):
    points, detail = vec_points(spark, sf), detail_classes(spark, sf)
    found = classify.argmax_class(vectors.with_unit(points, "feat"), detail, ["pid"], "feat", "idx")
    return metrics.confusion(points.join(classify.remap(found, detail), "pid"), 10)


@query
def class_scores(spark, sf):
    points = vec_points(spark, sf)
    table_ = metrics.confusion(points.join(evaluate.point_predictions(points, classes(spark, sf)), "pid"), 10)
    return rounded(metrics.class_scores(table_).where("gt_n > 0"), "iou", "acc").drop("pred_n")


def _codes(order: str) -> Query:
    return lambda spark, sf: graph.curve_codes(big_points(spark, sf), 0.02, 0.0, order).select("scene", "pid", "code")


_found |= {"morton_codes": _codes("z"), "morton_codes_trans": _codes("z-trans"), "hilbert_codes": _codes("hilbert"), "hilbert_codes_trans": _codes("hilbert-trans")}


@query
def morton_decoded(spark, sf):
    coded = graph.curve_codes(big_points(spark, sf), 0.02, 0.0, "z")
    return coded.select("scene", "pid", *[c.alias(f"g{a}") for a, c in zip("xyz", curves.morton_decode("code"), strict=True)])


@query
def hilbert_decoded(spark, sf):
    coded = graph.curve_codes(big_points(spark, sf), 0.02, 0.0, "hilbert")
    return curves.with_hilbert_cell(coded, "code", ("gx", "gy", "gz")).select("scene", "pid", "gx", "gy", "gz")


@query
def gray_codes(spark, sf):
    ids = features(spark, sf).select(F.col("fid").alias("pid"))
    coded = ids.withColumn("gray", curves.gray(F.col("pid"))).withColumn("back", F.col("gray"))
    return curves.gray_inverse(coded, "back", 64)


@query
def curve_votes(spark, sf):
    return rounded(graph.curve_votes(vec_points(spark, sf), 0.02, 8, 3, 0.3), "d2")


@query
def curve_knn(spark, sf):
    return graph.curve_knn(vec_points(spark, sf), 0.02, 4, 8, 3, 0.3).select("scene", "i", "j", "votes")


@query
def curve_knn_large(spark, sf):
    """The whole large cloud; each scene's curves are cut into slabs."""
    return graph.curve_knn(big_points(spark, sf), 0.02, 8, 8, 4, 0.3).select("scene", "i", "j", "votes")


@query
def grid_knn(spark, sf):
    return rounded(graph.grid_knn(vec_points(spark, sf), 8, 0.2), "d2")


@query
def exact_knn(spark, sf):
    return rounded(graph.exact_knn(vec_points(spark, sf), 8, 0.2), "d2")


def _bounds(spark, sf) -> DataFrame:
    points = vec_points(spark, sf)
    return graph.boundary(graph.grid_knn(points, 8, 0.2), points)


@query
def boundary_stats(spark, sf):
    return rounded(_bounds(spark, sf), "bsum")


@query
def degree_cap(spark, sf):
    return graph.degree_cap(_bounds(spark, sf), 3).select("scene", "m", "n", "cnt")


def _merged(rounds: int) -> Query:
    def run(spark, sf):
        return merge.hier_merge(merge.base_regions(vec_points(spark, sf), DIM), _bounds(spark, sf), DIM, rounds, 0.2, 0.0)

    return run


_found |= {f"merge_round{r}": _merged(r) for r in (1, 2, 3)}


@query
def merged_metrics(spark, sf):
    """Merging with normals in play, then pooling per merged region and scores."""
    return rounded(evaluate.refined_scores(vec_points(spark, sf), _bounds(spark, sf), classes(spark, sf), DIM, 10, 0.2, 0.3, 6), "miou", "macc", "oa")


@query
def merged_regions(spark, sf):
    return merge.hier_merge(merge.base_regions(vec_points(spark, sf), DIM), _bounds(spark, sf), DIM, 6, 0.2, 0.3)


@query
def scene_run(spark, sf):
    """A run at chosen thresholds: scores of three methods and numbers of regions, a scene at a time."""
    points = vec_points(spark, sf)
    return rounded(evaluate.scene_run(points, graph.grid_knn(points, 8, 0.2), classes(spark, sf), DIM, 10, 0.2, 0.3, 6), "miou", "macc", "oa")


@query
def refined_metrics(spark, sf):
    """The whole refinement with attention and recovery, scored a point."""
    points = _with_fpfh(spark, sf)
    return rounded(evaluate.refined_point_scores(points, graph.grid_knn(points, 8, 0.2), classes(spark, sf), DIM, 10, th_f=0.2, th_n=0.3, rounds=6, gamma0=0.5, alpha_min=0.5, intra=True), "miou", "macc", "oa")


@query
def vocabulary_probe(spark, sf):
    detail = detail_classes(spark, sf)
    got = evaluate.vocabulary_probe(vec_points(spark, sf), {"plain": (classes(spark, sf), None), "detail": (detail, detail)}, DIM, 10)
    return rounded(got, "miou", "macc", "oa")


@query
def segment_softmax(spark, sf):
    edges = graph.grid_knn(vec_points(spark, sf), 8, 0.2).withColumn("e", -F.col("d2"))
    return rounded(segment.segment_softmax(edges, ["scene", "i"], "e"), "a").select("scene", "i", "j", "a")


@query
def segment_cov(spark, sf):
    return rounded(segment.moments(vec_points(spark, sf), ["scene", "seg"]), *merge.MOMENTS)


@query
def neighbour_cov(spark, sf):
    points = vec_points(spark, sf)
    return rounded(segment.covariances(graph.grid_knn(points, 8, 0.2), points), *merge.MOMENTS)


@query
def region_normals(spark, sf):
    return rounded(segment.region_normals(vec_points(spark, sf), ["scene", "seg"]), "nx", "ny", "nz", to=5)


@query
def point_normals(spark, sf):
    points = vec_points(spark, sf)
    return rounded(segment.point_normals(graph.grid_knn(points, 8, 0.2), points), "nx", "ny", "nz", to=4)


@query
def knn_normals(spark, sf):
    """Of each point and its nineteen nearest."""
    return rounded(geometry.knn_normals(vec_points(spark, sf), 20, 0.2), "nx", "ny", "nz", to=4)


def _with_fpfh(spark, sf) -> DataFrame:
    """The geometry pre-pass, stored: everything after reads it several times."""
    points = vec_points(spark, sf)
    return stored(points.join(geometry.fpfh(nearest.packed_knn(points, 30, 0.3), points), ["scene", "pid"]))


@query
def fpfh(spark, sf):
    points = vec_points(spark, sf)
    found = geometry.fpfh(nearest.packed_knn(points, 30, 0.3), points)
    return found.select("scene", "pid", F.posexplode("fpfh").alias("bin", "v")).withColumn("v", F.round("v", 6))


@query
def voxel_mean(spark, sf):
    return rounded(segment.voxel_mean(big_points(spark, sf), 0.1), "x", "y", "z")


@query
def voxel_first(spark, sf):
    return segment.voxel_first(big_points(spark, sf), 0.1)


@query
def voxel_adjacency26(spark, sf):
    return graph.voxel_adjacency(segment.voxel_mean(big_points(spark, sf), 0.1))


@query
def rgb_to_lab(spark, sf):
    l, a, b = colour.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return vec_points(spark, sf).select("pid", F.round(l, 6).alias("l"), F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


def _methods(spark, sf) -> DataFrame:
    points, cls = vec_points(spark, sf), classes(spark, sf)
    by_point = metrics.confusion(points.join(evaluate.point_predictions(points, cls), "pid"), 10, ["scene"])
    by_pool = metrics.confusion(evaluate.pooled_predictions(points, cls, DIM), 10, ["scene"])
    return by_point.withColumn("method", F.lit("point")).unionByName(by_pool.withColumn("method", F.lit("pool")))


def _resampled(kind: int) -> Query:
    def run(spark, sf):
        mult = metrics.bootstrap_draws(4, 20, 0, 20)[kind]
        return rounded(metrics.resampled(_methods(spark, sf), metrics.draws_table(spark, range(4), mult), "point", "pool"), "delta")

    return run


_found |= {"bootstrap_delta": _resampled(0), "split_half": _resampled(1)}


@query
def bootstrap_summary(spark, sf):
    return rounded(metrics.summary(_resampled(0)(spark, sf)), "mean", "sd", "lo", "hi", "p_above", to=5)


def _shapes(spark, sf) -> DataFrame:
    return big_points(spark, sf).select(F.col("seg").alias("shape_id"), (F.col("seg") % 4).cast("int").alias("category"), "pid", "x", "y", "z", (F.col("scene") % 4).cast("int").alias("part"), (F.col("partkey") % 4).cast("int").alias("pred"))


@query
def shape_iou(spark, sf):
    points = _shapes(spark, sf)
    return rounded(metrics.shape_iou(points, points.select("category", "part").distinct()), "iou")


@query
def shape_accuracy(spark, sf):
    return rounded(metrics.shape_accuracy(_shapes(spark, sf)), "accuracy")


@query
def view_mean(spark, sf):
    f = features(spark, sf)
    rows = big_points(spark, sf).join(F.broadcast(f.agg(F.count("*").alias("n")))).select(F.col("seg").alias("shape_id"), F.col("scene").cast("long").alias("pid"), F.pmod("partkey", "n").alias("fid"), ((F.col("scene") % 3 + 1) / 4).alias("w"), F.col("valid").cast("double").alias("is_seen"))
    got = shape.view_mean(rows.join(f, "fid"), DIM)
    return got.select("shape_id", "pid", F.round(F.col("feat")[0], 6).alias("f0"), F.round(F.col("feat")[63], 6).alias("f63"), F.round(vectors.dot(F.col("feat"), F.col("feat")), 6).alias("sq"))


@query
def topk_prototype(spark, sf):
    g = vec_points(spark, sf).select(F.col("scene").alias("shape_id"), "pid", (F.col("seg") % 5).alias("k"), ((F.col("pid") % 17 + 1) / 17).alias("gamma"), "feat")
    got = shape.topk_prototypes(g, 6, DIM)
    return got.select("shape_id", "k", F.round(F.col("proto")[0], 6).alias("p0"), F.round(vectors.dot(F.col("proto"), F.col("proto")), 6).alias("sq"), F.round("mass", 6).alias("mass"))


@query
def mixture_moments(spark, sf):
    g = vec_points(spark, sf).select(F.col("scene").alias("shape_id"), "pid", "feat", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("k"))
    g = g.withColumn("gamma", ((F.col("pid") * (F.col("k") + 1)) % 13 + 1) / 13)
    return shape.mixture_moments(g, DIM).select("shape_id", "k", F.round("pi", 6).alias("pi"), F.round(F.col("mu")[0], 6).alias("mu0"), F.round(F.col("sigma")[0], 6).alias("sigma0"))


def _as_shapes(spark, sf) -> DataFrame:
    return vec_points(spark, sf).withColumnRenamed("scene", "shape_id")


def _nodes(points: DataFrame, size: float) -> DataFrame:
    """The first point of every voxel."""
    first = segment.voxel_first(points, size, ("shape_id",)).select("shape_id", "pid")
    return points.join(first, ["shape_id", "pid"], "left_semi")


@query
def idw_interp(spark, sf):
    points = _as_shapes(spark, sf)
    return shape.interpolate(points, _nodes(points, 0.25), DIM).select("shape_id", "pid", F.round(F.col("feat")[0], 6).alias("f0"))


@query
def ball_query(spark, sf):
    points = _as_shapes(spark, sf)
    return shape.ball_query(points, points, 0.25, 6)


@query
def patch_groups(spark, sf):
    points = _as_shapes(spark, sf)
    return rounded(shape.patches(_nodes(points, 0.25), points, 12), "x", "y", "z")


@query
def hist_distance(spark, sf):
    """How far each vector, as a histogram, is from its region's mean one."""
    h = vec_points(spark, sf).select("scene", "seg", "pid", F.transform("feat", F.abs).alias("h"), F.lit(1.0).alias("w"))
    mean = segment.segment_mean(h, ["scene", "seg"], DIM, "h", "w", "mean").select("scene", "seg", "mean")
    return h.join(mean, ["scene", "seg"]).select("pid", F.round(vectors.histogram_distance(F.col("h"), F.col("mean")), 6).alias("dist"))


@query
def angles(spark, sf):
    """Between the normals of neighbours."""
    points = vec_points(spark, sf)
    end = lambda c, s: points.select("scene", F.col("pid").alias(c), *[F.col(f"n{a}").alias(f"{s}{a}") for a in "xyz"])
    met = graph.grid_knn(points, 8, 0.2).join(end("i", "p"), ["scene", "i"]).join(end("j", "q"), ["scene", "j"])
    cosine = sum(F.col(f"p{a}") * F.col(f"q{a}") for a in "xyz")
    return met.select("scene", "i", "j", F.round(vectors.angle(cosine), 6).alias("angle"))


@query
def minmax_quantise(spark, sf):
    return export.quantised(big_points(spark, sf)).select("scene", "pid", "qx", "qy", "qz")


@query
def region_colour(spark, sf):
    return big_points(spark, sf).select("seg").distinct().withColumn("colour", colour.region_colour(F.col("seg")))


@query
def legend_top12(spark, sf):
    return classify.legend(big_points(spark, sf))


@query
def per_scene_classes(spark, sf):
    return big_points(spark, sf).where("gt between 0 and 9").groupBy("scene").agg(F.count_distinct("gt").alias("n_classes"), F.count("*").alias("n"))


def _gain(points: DataFrame) -> DataFrame:
    """Mean x by region, summed as decimals: equal regions tie however their rows are dealt."""
    return points.groupBy(F.col("seg").alias("scene")).agg(F.avg(F.col("x").cast("decimal(28,18)")).alias("gain"), F.count_distinct(F.when(F.col("gt").between(0, 9), F.col("gt"))).alias("n_classes"))


@query
def scene_pick(spark, sf):
    gains = _gain(big_points(spark, sf))
    return classify.pick_by_rank(gains, "gain", ["scene"]).select("scene", F.col("pick").cast("int").alias("pick"))


@query
def robust_scale_mean(spark, sf):
    return rounded(segment.robust_scale(big_points(spark, sf), ["scene", "seg"], "y"), "scale")


@query
def robust_scale_median(spark, sf):
    return rounded(segment.robust_scale(big_points(spark, sf), ["scene", "seg"], "y", "median"), "scale")


@query
def dense_labels(spark, sf):
    return segment.dense_labels(big_points(spark, sf), "seg").select("scene", "pid", "dense")


@query
def prompt_ensemble(spark, sf):
    p = table(spark, sf, "embeddings").select(F.col("label").alias("cls"), F.col("embedding").cast("array<double>").alias("emb"))
    return classify.prompt_ensemble(p, DIM).select("cls", F.round(F.col("emb")[0], 6).alias("e0"))


@query
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.collapse_space(F.col("text")).alias("text"))


@query
def structural_confidence(spark, sf):
    return rounded(attention.structural_confidence(_with_fpfh(spark, sf)), "q", to=5)


def _attended(spark, sf) -> DataFrame:
    points = _with_fpfh(spark, sf)
    own = ["scene", "seg"]
    regions = stored(attention.region_model(points).join(segment.pooled(points, own, DIM).select(*own, "z"), own))
    found = attention.inter_attention(regions, stored(graph.degree_cap(_bounds(spark, sf))), DIM)
    return stored(found.join(regions.select(*own, "z"), own))


@query
def inter_attention(spark, sf):
    got = _attended(spark, sf)
    return got.select("scene", "seg", F.round(F.col("z2")[0], 5).alias("z0"), F.round(F.col("z2")[63], 5).alias("z63"), F.round("gate", 5).alias("gate"))


@query
def recovered_points(spark, sf):
    points = _with_fpfh(spark, sf)
    q = attention.structural_confidence(points).select("scene", "pid", "q")
    got = attention.recover(points.join(q, ["scene", "pid"]), _attended(spark, sf), 0.5)
    return got.select("scene", "pid", F.round(F.col("out")[0], 5).alias("o0"), F.round(F.col("out")[63], 5).alias("o63"))


@query
def intra_consensus(spark, sf):
    got = attention.intra_consensus(vec_points(spark, sf))
    return got.select("scene", "seg", F.round(F.col("z")[0], 5).alias("z0"), F.round(F.col("z")[63], 5).alias("z63"), F.round("eta", 5).alias("eta")).withColumns({c: F.col(c) + 0.0 for c in ("z0", "z63", "eta")})


@query
def fps_seeds(spark, sf):
    return shape.fps(_as_shapes(spark, sf), 16)


@query
def refined_shapes(spark, sf):
    points = _as_shapes(spark, sf)
    points = points.join(geometry.fpfh(nearest.packed_knn(points, 30, 0.3, ("shape_id",)), points, ("shape_id",)), ["shape_id", "pid"])
    return shape.refine_shapes(points, DIM, 16, 12)


@query
def image_cells(spark, sf):
    """Pixels, layers and depths of all points in ten views."""
    return rounded(projection.image_cells(projection.viewed(_as_shapes(spark, sf))), "zz", to=5)


@query
def visibility(spark, sf):
    return projection.project(_as_shapes(spark, sf), projection.Grid(resolution=64, depth=32))


@query
def density_clusters(spark, sf):
    got = shape.density_clusters(_as_shapes(spark, sf), 0.8, 4)
    return got.select("shape_id", "k", "size")


@query
def principal_colours(spark, sf):
    return rounded(shape.principal_colours(vec_points(spark, sf), DIM), "r", "g", "b", to=4)


@query
def class_colours(spark, sf):
    return big_points(spark, sf).select("gt").distinct().withColumn("colour", colour.class_colour(F.col("gt"), [(20 * i, 255 - 20 * i, 7 * i) for i in range(8)]))


@query
def rich_scene_pick(spark, sf):
    """Scenes with nine classes or more, by gain: those at a sixth, the middle and near the end."""
    return classify.pick_by_rank(classify.rich_scenes(_gain(big_points(spark, sf))), "gain", ["scene"]).select("scene", F.col("pick").cast("int").alias("pick"))


@query
def clean_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.basic_clean(F.col("html")).alias("text"))


@query
def vccs_labels(spark, sf):
    return supervoxel.vccs(vec_points(spark, sf), supervoxel.Params(voxel=0.05, seed=0.25))


@query
def grid_seeds(spark, sf):
    return supervoxel.grid_seeds(segment.voxel_mean(vec_points(spark, sf), 0.05), 0.25)


@query
def seed_size(spark, sf):
    return rounded(supervoxel.curve_seeds(segment.voxel_mean(vec_points(spark, sf), 0.05), 20, 0.05)[1], "size")


@query
def normal_variance(spark, sf):
    got = supervoxel.normal_variance(segment.voxel_mean(vec_points(spark, sf), 0.1))
    return got.withColumn("var", F.when(F.col("var") < 1e9, F.round("var", 6)))


@query
def stride_seeds(spark, sf):
    return supervoxel.stride_seeds(segment.voxel_mean(big_points(spark, sf), 0.1), 8)


@query
def scene_list(spark, sf):
    return scenes.sampled(big_points(spark, sf).select("scene").distinct(), stride=2, limit=3)


@query
def scene_payload(spark, sf):
    points = big_points(spark, sf).withColumn("region", F.col("seg"))
    return export.payload(points, 255)


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.sql().items() if k in _found}
