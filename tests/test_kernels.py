"""Object kernels, geometry and projection against plain versions written from their formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import colour, curves
from pointloom.operators import classify, geometry, graph, merge, projection, segment, shape, supervoxel
from pointloom.plans import evaluate
from pointloom.sources import stores, text
from pointloom.sources.fixtures import DIM, vec_points

SF = "/root/testdata/sf0.01"


def _unit(v):
    return v / max(np.linalg.norm(v), 1e-12)


def _lse(v):
    return max(v) + math.log(sum(math.exp(x - max(v)) for x in v))


def _sinkhorn(cost, p=None, q=None, eps=1e-4, thresh=1e-2, most=100):
    n, m = cost.shape
    p, q = ([1 / n] * n if p is None else p), ([1 / m] * m if q is None else q)
    u, v = [0.0] * n, [0.0] * m
    for _ in range(most):
        old = (list(u), list(v))
        u = [u[i] + eps * (math.log(p[i] + 1e-8) - _lse([(-cost[i, j] + u[i] + v[j]) / eps for j in range(m)])) for i in range(n)]
        v = [v[j] + eps * (math.log(q[j] + 1e-8) - _lse([(-cost[i, j] + u[i] + v[j]) / eps for i in range(n)])) for j in range(m)]
        if sum(abs(a - b) for a, b in zip(u + v, old[0] + old[1], strict=True)) < thresh:
            break
    return np.array([[math.exp((-cost[i, j] + u[i] + v[j]) / eps) for j in range(m)] for i in range(n)])


def _dist(a, b):
    return np.array([[math.dist(x, y) for y in b] for x in a])


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(8)
    xyz = rng.random((30, 3))
    nrm = np.array([_unit(v) for v in rng.normal(size=(30, 3))])
    return xyz, nrm, rng.random((30, 33)), rng.normal(size=(30, 8))


def test_sinkhorn_equals_a_plain_one(cloud):
    cost = _dist(cloud[0][:6], cloud[0][6:11])
    assert np.allclose(shape.sinkhorn_plan(cost), _sinkhorn(cost), atol=1e-9)
    assert np.allclose(shape.sinkhorn_plan(cost, np.full(6, 0.1), np.full(5, 0.1)), _sinkhorn(cost, [0.1] * 6, [0.1] * 5), atol=1e-9)


def test_connected_clustering(cloud):
    xyz, nrm, hist, _ = cloud
    at = [0, 5, 9, 20]
    gamma, means = shape.connected_clustering(xyz, xyz[at], [(nrm, nrm[at], "cos", 1.0), (hist, hist[at], "eu", 0.1)], 3)
    far = _dist(xyz, xyz[at])
    eps = np.mean([sorted(r)[1] for r in far])
    m1, m2 = nrm[at], hist[at]
    for _ in range(3):
        chord = _dist([_unit(v) for v in nrm], [_unit(v) for v in m1])
        cost = (1.0 * chord + 0.1 * _dist(hist, m2) + math.sqrt(1 / 3) / eps * far) / 3
        want = _sinkhorn(cost, most=10)
        kept = np.array([[want[i, k] if far[i, k] < 0.6180339887498949 * eps and want[i, k] * 30 * 4 > 1 else 0.0 for k in range(4)] for i in range(30)])
        kept = kept / np.maximum(kept.sum(1, keepdims=True), 1e-3)
        m1 = np.array([_unit(kept[:, k] @ nrm / (kept[:, k].sum() + 1e-5)) for k in range(4)])
        m2 = np.array([kept[:, k] @ hist / (kept[:, k].sum() + 1e-5) for k in range(4)])
    assert np.allclose(gamma, want, atol=1e-8) and np.allclose(means[0], m1, atol=1e-6) and np.allclose(means[1], m2, atol=1e-6)


def test_prototypes(cloud):
    x, like = cloud[3], cloud[2][:, :3]
    got, mass = shape.prototypes(x, like, 4)
    for k in range(3):
        best = sorted(range(30), key=lambda i: (-like[i, k], i))[:4]
        w = np.array([like[i, k] for i in best])
        assert np.allclose(got[k], (w / w.sum()) @ x[best])
    assert np.allclose(mass, 1)


def test_local_attention(cloud):
    xyz, _, hist, f = cloud
    nodes, node_hist = xyz[[2, 11, 23]] + 0.01, hist[[2, 11, 23]]
    got = shape.local_attend(nodes, xyz, node_hist, hist, f, 5)
    geo = lambda x, h: np.concatenate([x / math.sqrt(3), h / math.sqrt(33)])
    patch, out = [], []
    for x, h in zip(nodes, node_hist, strict=True):
        own = sorted(range(30), key=lambda i: math.dist(geo(x, h), geo(xyz[i], hist[i])))[:5]
        a = _sinkhorn(_dist(f[own], f[own]) / math.sqrt(8), [1 / 30] * 5, [1 / 30] * 5)
        a = a * _sinkhorn(_dist(hist[own] / math.sqrt(33), hist[own] / math.sqrt(33)) / math.sqrt(8))
        patch.append(own)
        out.append((a / a.sum(1, keepdims=True)) @ f[own])
    for i in range(30):
        k = min(range(3), key=lambda k: math.dist(xyz[i], nodes[k]))
        j = min(range(5), key=lambda j: math.dist(xyz[i], xyz[patch[k][j]]))
        assert np.allclose(got[i], (f[i] + out[k][j]) / 2, atol=1e-6)


def _rpm(x, iters=5):
    for _ in range(iters):
        x = x - np.array([[_lse(r)] for r in x])
        x = x - np.array([_lse(c) for c in x.T])
    return x


def test_global_attention(cloud):
    hist, z = cloud[2][:6], cloud[3][:6]
    got_z, got_h = shape.global_attend(hist, z)
    cos = lambda x: np.array([[_unit(a) @ _unit(b) for b in x] for a in x])
    geo = np.clip(cos(hist), 0.001, None)
    sim = np.clip(cos(z), 0.01, 0.9)
    np.fill_diagonal(sim, 0)
    a = np.exp(_rpm(geo / 0.01)) * np.exp(_rpm((sim + 1 / (36 + 1e-6)) / 0.1))
    a = a / a.sum(1, keepdims=True)
    assert np.allclose(got_z, a @ z + z) and np.allclose(got_h, a @ hist + hist)


def test_attention_back_to_points(cloud):
    xyz, _, hist, f = cloud
    nodes, node_hist, z = xyz[:4] + 0.02, hist[:4], f[:4]
    s = f @ z.T / math.sqrt(8) / 0.1
    soft = lambda m: np.array([[math.exp(x - _lse(r)) for x in r] for r in m])
    a = _sinkhorn(_dist(xyz, nodes)) * soft(s) * soft(s.T).T
    a = a / a.sum(1, keepdims=True)
    got_f, got_h = shape.attend(nodes, xyz, z, f, node_hist, hist, "df")
    assert np.allclose(got_f, (a @ z + f) / 2) and np.allclose(got_h, (a @ node_hist + hist) / 2)
    a = _sinkhorn(_dist(xyz, nodes)) * _sinkhorn(_dist(hist, node_hist) / math.sqrt(33))
    a = a / np.maximum(a.sum(1, keepdims=True), 1e-300)
    assert np.allclose(shape.attend(nodes, xyz, z, f, node_hist, hist, "dg")[0], (a @ z + f) / 2)
    assert shape.attend(nodes, xyz, z, f, node_hist, hist, "gf", top=2)[0].shape == f.shape
    with pytest.raises(ValueError):
        shape.attend(nodes, xyz, z, f, node_hist, hist, "xx")


def test_spread(cloud):
    xyz, nrm, _, f = cloud
    got = shape.spread(xyz, xyz[:9], nrm, nrm[:9], f, f[:9])
    for i in range(30):
        d = [math.dist(xyz[i], xyz[k]) + 1 / (1 + math.exp(-math.dist(nrm[i], nrm[k]))) for k in range(9)]
        best = sorted(range(9), key=lambda k: d[k])[:8]
        w = np.array([1 / (d[k] + 1e-8) for k in best])
        mixed = (w / w.sum()) @ f[best]
        assert np.allclose(got[i], (np.maximum(f[i], mixed) + (f[i] + mixed) / 2) / 2)


def test_object_pipeline(spark, cloud):
    xyz, nrm, hist, f = cloud
    rows = [(s, i, *xyz[i].tolist(), *nrm[i].tolist(), hist[i].tolist(), (f[i] * (1 + s)).tolist(), 0, i % 2) for s in range(2) for i in range(30)]
    points = spark.createDataFrame(rows, "shape_id long, pid long, x double, y double, z double, nx double, ny double, nz double, fpfh array<double>, feat array<double>, category int, part int")
    got = {r["pid"]: np.array(r["feat"]) for r in shape.refine_shapes(points, 8, 6, 5).where("shape_id = 0").collect()}
    want = shape.refined(xyz, nrm, hist, f, 6, 5)
    assert all(np.allclose(got[i], _unit(want[i])) for i in range(30))
    classes = spark.createDataFrame([(0, c, f[c].tolist()) for c in range(2)], "category int, cls int, emb array<double>")
    score = shape.segment_shapes(points, classes, spark.createDataFrame([(0, 0), (0, 1)], "category int, part int"), 8, 6, 5).first()
    pred = [int(np.argmax([_unit(want[i]) @ f[c] for c in range(2)])) for i in range(30)]
    assert score["shapes"] == 2 and 0 <= score["iou"] <= 100
    assert score["accuracy"] == pytest.approx(100 * np.mean([np.mean([p == i % 2 for i, p in enumerate(pred)]), np.mean([int(np.argmax([shape.refined(xyz, nrm, hist, 2 * f, 6, 5)[i] @ f[c] for c in range(2)])) == i % 2 for i in range(30)])]))


def test_merge_kernel_equals_rounds_of_joins(spark):
    points = vec_points(spark, SF)
    edges = graph.boundary(graph.grid_knn(points, 8, 0.2), points)
    run = lambda most: {(r["scene"], r["seg"], r["root"]) for r in merge.hier_merge(merge.base_regions(points, DIM), edges, DIM, 10, 0.2, 0.3, scene_regions=most).collect()}
    assert run(20_000) == run(0)


def test_sums_of_wide_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), rng.normal(size=130).tolist() if i % 7 else None, float(i)) for i in range(60)]
    points = spark.createDataFrame(rows, "g int, v array<double>, w double").repartition(4)
    for got in (segment.summed(points, ["g"], "v", 130, "w"), segment.summed(points, ["g"], "v", 130, "w", unrolled=200)):
        for r in got.collect():
            own = [x for x in rows if x[0] == r["g"]]
            assert np.allclose(r["z"], sum(np.array(v) * w for _, v, w in own if v is not None)) and r["w"] == sum(x[2] for x in own) and r["n"] == len(own)


def test_small_tables_only(spark):
    table = spark.range(30).select(F.col("id").cast("int").alias("idx"), F.col("id").cast("int").alias("cls"))
    with pytest.raises(ValueError):
        classify.small(table, "classes", 29)
    assert classify.small(table, "classes", 30).count() == 30


def test_histograms_sum_to_one_and_ignore_position(spark):
    points = vec_points(spark, SF)
    got = geometry.fpfh(graph.grid_knn(points, 30, 0.3), points)
    sums = {round(sum(r["fpfh"]), 6) for r in got.collect()}
    assert sums <= {0.0, 1.0}
    moved = points.withColumns({"x": F.col("x") + 1, "y": F.col("y") - 2})
    again = geometry.fpfh(graph.grid_knn(moved, 30, 0.3), moved).withColumnRenamed("fpfh", "other")
    both = got.join(again, ["scene", "pid"]).collect()
    assert np.mean([np.allclose(r["fpfh"], r["other"], atol=1e-6) for r in both]) > 0.95
    assert {"nx", "fpfh"} <= set(geometry.with_geometry(points, 0.3, 0.3).columns)


def test_projection_of_a_view():
    rng = np.random.default_rng(0)
    grid = projection.Grid(resolution=12, depth=8, pool_z=3, pool_xy=3, blur=3)
    n = 10
    xx, yy, zi = (rng.integers(1, top, n) for top in (11, 11, 7))
    zz = zi.astype(float)
    image, box = projection.depth_image(xx, yy, zi, zz, grid)
    raw = np.zeros((8, 12, 12))
    for a, b, c, v in zip(zi, xx, yy, zz, strict=True):
        raw[a, b, c] = v
    inside = lambda k, n: range(max(0, k - 1), min(n, k + 2))
    pooled = np.array([[[max(raw[i, j, k] for i in inside(a, 8) for j in inside(b, 12) for k in inside(c, 12)) for c in range(12)] for b in range(12)] for a in range(8)])
    w = lambda k, s: math.exp(-((k - 1) ** 2) / (2 * s * s))
    total = sum(w(i, 2) * w(j, 1) * w(k, 1) for i in range(3) for j in range(3) for k in range(3))
    blurred = np.zeros_like(pooled)
    for a in range(8):
        for b in range(12):
            for c in range(12):
                blurred[a, b, c] = sum(w(i - a + 1, 2) * w(j - b + 1, 1) * w(k - c + 1, 1) * pooled[i, j, k] for i in inside(a, 8) for j in inside(b, 12) for k in inside(c, 12)) / total
    top = blurred.max()
    assert np.allclose(image, 1 - blurred.max(0) / top, atol=1e-5) and np.allclose(box, 1 - blurred / top, atol=1e-5)


def test_rotations_and_maps():
    for m in projection.view_matrices():
        assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
    x = projection.rotation((np.pi / 2, 0, 0))
    assert np.allclose(x @ [0, 1, 0], [0, 0, 1])
    tiles = np.random.default_rng(0).random((4, 4, 2))
    wide = np.pad(tiles, ((2, 3), (2, 3), (0, 0)), mode="edge")
    assert np.allclose(projection.smoothed(tiles), [[wide[i : i + 6, j : j + 6].mean((0, 1)) for j in range(4)] for i in range(4)])
    assert np.allclose(projection.between(tiles, np.array([0, 3]), np.array([0, 3]), 4), tiles[[0, 3], [0, 3]])


def test_projected_features(spark):
    points = spark.createDataFrame([(0, i, i / 5, (i * i) % 5 / 5, i % 3 / 3) for i in range(6)], "shape_id long, pid long, x double, y double, z double")
    seen = projection.project(points, projection.Grid(resolution=32, depth=16))
    assert seen.count() == 60 and {r[0] for r in seen.select("is_seen").distinct().collect()} <= {0.0, 1.0}
    maps = spark.range(10).select(F.lit(0).cast("long").alias("shape_id"), F.col("id").cast("int").alias("view"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("cell")).withColumn("feat", F.array(F.lit(2.0), F.lit(3.0)))
    got = projection.pixel_features(projection.cropped(seen, 4, 32), maps, 2, 32).collect()
    assert len(got) == 60 and all(np.allclose(r["feat"], [2, 3]) for r in got)


def test_view_weight_search(spark):
    rng = np.random.default_rng(3)
    rows = [(s, 0, p, int(rng.integers(0, 2)), v, float(rng.integers(0, 2)), rng.normal(size=3).tolist()) for s in range(2) for p in range(6) for v in range(3)]
    part = {(r[0], r[2]): r[3] for r in rows}
    rows = [(*r[:3], part[r[0], r[2]], *r[4:]) for r in rows]
    emb = rng.normal(size=(2, 3))
    seen = spark.createDataFrame(rows, "shape_id long, category int, pid long, part int, view int, is_seen double, feat array<double>")
    classes = spark.createDataFrame([(0, c, emb[c].tolist()) for c in range(2)], "category int, cls int, emb array<double>")
    grid = shape.weight_grid(3, 1)
    assert len(grid) == 16 and grid[0] == [0.75, 0.25, 0.25]
    got = {r["trial"]: r for r in shape.search_view_weights(seen, classes, spark.createDataFrame([(0, 0), (0, 1)], "category int, part int"), grid).collect()}
    for t, w in enumerate(grid):
        acc = []
        for s in range(2):
            hit = 0
            for p in range(6):
                f = sum(np.array(r[6]) * w[r[4]] * r[5] for r in rows if r[0] == s and r[2] == p)
                hit += int(np.argmax(emb @ f)) == part[s, p]
            acc.append(hit / 6)
        assert got[t]["accuracy"] == pytest.approx(100 * np.mean(acc))
    best = max(r["iou"] for r in got.values())
    assert [t for t, r in got.items() if r["best"]] == [min(t for t, r in got.items() if r["iou"] == best)]


def test_prompt_search(spark):
    scored = spark.createDataFrame([(0, 0, p, p % 2, k, float((p % 2 == 0) if k in (0, 3) else (p % 2 == 1) if k == 2 else 0.5)) for p in range(8) for k in range(4)], "shape_id long, category int, pid long, part int, prompt int, s double")
    chosen, iou = shape.search_prompts(scored, spark.createDataFrame([(0, 0), (0, 1)], "category int, part int"), {0: 1, 1: 1}, {0: [0, 3], 1: [2]})
    assert chosen == {0: 0, 1: 2} or chosen == {0: 0, 1: 1}
    assert iou == pytest.approx(1.0)


def test_density_clusters_and_kmeans(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(25, 4)) * 0.05 + c for c in np.eye(4)[:2] * 3] + [rng.normal(size=(3, 4))])
    points = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "shape_id long, pid long, feat array<double>")
    got = shape.density_clusters(points, 0.15, 20).orderBy("k").collect()
    assert [r["k"] for r in got] == [0, 1] and all(r["size"] >= 25 for r in got) and np.allclose(got[0]["centre"], x[0])
    gamma, centres = shape.weighted_kmeans(x[:50], x[[0, 30]])
    assert (gamma.argmax(1) == np.repeat([0, 1], 25)).all() and centres.shape == (2, 4)


def test_principal_colours(spark):
    got = shape.principal_colours(vec_points(spark, SF), DIM).agg(*[F.min(c) for c in "rgb"], *[F.max(c) for c in "rgb"]).first()
    assert np.allclose(got, [0, 0, 0, 1, 1, 1])


@pytest.mark.parametrize("mode", ["grid", "zcurve", "fps", "auto"])
def test_seeding_modes(spark, mode):
    points = vec_points(spark, SF)
    p = supervoxel.Params(voxel=0.05, seed=0.25, mode=mode, n_seeds=12, geodesic=mode == "fps")
    voxels = segment.voxel_mean(points, p.voxel)
    seeds, size = supervoxel.seeds_of(voxels, p)
    assert seeds.join(voxels, ["scene", *supervoxel.AT]).count() == seeds.count() > 0 and size.count() == 4
    got = supervoxel.vccs(points, p)
    assert got.count() == points.count() and got.where("seg < 0").count() == 0


def test_unknown_seeding_mode(spark):
    with pytest.raises(ValueError):
        supervoxel.seeds_of(segment.voxel_mean(vec_points(spark, SF), 0.1), supervoxel.Params(mode="x"))


def test_refinement_without_attention_is_pooling(spark):
    points = vec_points(spark, SF)
    edges = graph.grid_knn(points, 8, 0.2)
    out, regions = evaluate.refine(points, edges, DIM, 0.2, 0.3, gamma0=0.0)
    met = out.join(regions.select("scene", F.col("seg").alias("root"), "z"), ["scene", "root"])
    assert met.where("exists(zip_with(out, z, (a, b) -> abs(a - b)), d -> d > 1e-9)").count() == 0


def test_stores(spark, tmp_path):
    table = spark.createDataFrame([("a", "m", 0, 1, 3), ("b", "m", 1, 1, 2), ("a", "n", 0, 0, 1)], "scene string, method string, gt int, pred int, n long")
    path = str(tmp_path / "confusion")
    stores.write_confusion(table, path)
    stores.write_confusion(table.where("scene = 'b'"), path)
    assert stores.read_confusion(spark, path).count() == 3 and stores.read_confusion(spark, path, ["n"]).count() == 1
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert stores.class_table(spark, str(tmp_path / "classes"), "x", make).count() == 3
    assert len(calls) == 1
    points, seen = spark.createDataFrame([("a", 1), ("b", 2)], "scene string, pid long"), []

    def geometry_of(d):
        seen.append(sorted(r["scene"] for r in d.collect()))
        return d

    assert stores.fill_scenes(points.where("scene = 'a'"), str(tmp_path / "geo"), geometry_of).count() == 1
    assert stores.fill_scenes(points, str(tmp_path / "geo"), geometry_of).count() == 2 and seen == [["a"], ["b"]]
    stores.write_predictions(points.withColumn("pred", F.lit(4)), str(tmp_path / "pred"))
    assert spark.read.parquet(str(tmp_path / "pred")).schema["pred"].dataType.simpleString() == "smallint"
    stores.write_result(spark.createDataFrame([("m", 0.5)], "method string, miou double"), str(tmp_path / "res"), th_f=0.85)
    assert spark.read.json(str(tmp_path / "res")).first()["th_f"] == 0.85
    shapes = spark.createDataFrame([("cup", i) for i in range(5)] + [("bag", 0)], "category string, pid long")
    assert stores.of_class(shapes, "cup", 3).count() == 3
    assert [r["scene"] for r in stores.scans_with_features(points.select("scene"), points.where("pid = 2")).collect()] == ["b"]
    stores.write_view_features(shapes, str(tmp_path / "maps"))
    assert spark.read.parquet(str(tmp_path / "maps")).count() == 6


def test_text_colours_and_offsets(spark):
    rows = spark.createDataFrame([("a &amp;amp; b\n  &lt;c&gt;",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(text.basic_clean(F.col("t"))).collect()] == ["a & b <c>", None, ""]
    got = spark.createDataFrame([(0,), (1,), (2,), (None,)], "c int").select(colour.class_colour(F.col("c"), [(255, 0, 1), (2, 3, 4)])).collect()
    assert [r[0] for r in got] == ["ff0001", "020304", "3c3c3c", "3c3c3c"]
    assert spark.range(1).select(colour.fading(F.lit(1.0), 2.0), colour.fading(F.lit(1.0), 1.0, "exp")).first() == (0.75, math.exp(-1))
    offsets = spark.createDataFrame([(0, 2), (1, 2), (2, 5)], "batch long, offset long")
    assert [(r[0], r[1]) for r in curves.bin_count(offsets).orderBy("batch").collect()] == [(0, 2), (1, 0), (2, 3)]
    assert [(r[0], r[1]) for r in curves.offset_of_batch(curves.batch_of_offset(offsets)).orderBy("batch").collect()] == [(0, 2), (2, 5)]


def test_rich_scenes(spark):
    rows = spark.createDataFrame([(i, 9 if i < 2 else 4) for i in range(6)], "scene int, n_classes int")
    assert classify.rich_scenes(rows, 9, 3).count() == 6 and classify.rich_scenes(rows, 9, 2).count() == 2


def test_assembled_scenes_and_small_helpers(spark):
    from pointloom.operators import metrics
    from pointloom.sources import scenes

    points = spark.createDataFrame([("a", i, float(i)) for i in range(3)], "scene string, pid long, x double")
    feats = spark.createDataFrame([("a", 1, [1.0, 2.0])], "scene string, pid long, feat array<double>")
    seg = points.select("scene", "pid").withColumn("seg", F.col("pid") % 2)
    got = scenes.assembled(points, feats, points.select("scene", "pid", F.lit(0.5).alias("nz")), seg, seg).orderBy("pid").collect()
    assert [(r["valid"], r["feat"], r["nz"], r["seg"]) for r in got] == [(False, [0.0, 0.0], 0.5, 0), (True, [1.0, 2.0], 0.5, 1), (False, [0.0, 0.0], 0.5, 0)]
    shapes = spark.createDataFrame([(0, i, [0.0]) for i in range(3)], "shape_id long, pid long, feat array<double>")
    patch = spark.createDataFrame([(0, 0, 0, 1, [5.0]), (0, 2, 0, 1, [7.0])], "shape_id long, i long, slot int, j long, feat array<double>")
    assert [r["feat"] for r in shape.scatter_back(shapes, patch).orderBy("pid").collect()] == [[0.0], [7.0], [0.0]]
    assert metrics.averages(spark.createDataFrame([(1, 2.0), (3, 4.0)], "regions int, s double"), "regions", "s").first() == (2.0, 3.0, 2)
