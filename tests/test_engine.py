import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pointloom import catalog
from pointloom.functions import curves
from pointloom.operators import attention, geometry, graph, merge, metrics, nearest, segment, shape, supervoxel, voting
from pointloom.sources import export, scenes
from pointloom.sources.fixtures import DIM, classes, vec_points
from pointloom.streaming import running

SF = "/root/testdata/sf0.01"
POINT = "scene long, pid long, seg long, gt int, x double, y double, z double, nx double, ny double, nz double, valid boolean, feat array<double>"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "embeddings", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["point_argmax", "hilbert_codes", "hilbert_decoded", "curve_votes", "grid_knn", "exact_knn", "merge_round2", "neighbour_cov", "voxel_adjacency26", "bootstrap_delta", "shape_iou", "ball_query", "scene_pick", "minmax_quantise", "fpfh", "structural_confidence", "recovered_points", "intra_consensus", "merged_regions", "patch_groups", "grid_seeds", "image_cells", "scene_run", "region_normals"])
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    same = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    assert same(got).equals(same(want))


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _points(spark, rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], POINT)


def test_two_planes_do_not_merge_and_one_does(spark):
    f = [1.0, 0.0]
    up, side = (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)
    rows = [(0, 0, 0.0, 0.0, 0.0, *up, True, f), (1, 0, 0.1, 0.0, 0.0, *side, True, f), (2, 0, 0.0, 0.1, 0.0, 0.0, 0.0, -1.0, True, f)]
    points = _points(spark, rows)
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 0, 2), (0, 2, 0)], "scene long, i long, j long")
    got = {r["seg"]: r["root"] for r in merge.hier_merge(merge.base_regions(points, 2), graph.boundary(edges, points), 2).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_one_way_edges_and_high_thresholds_do_not_merge(spark):
    points = _points(spark, [(s, 0, 0.1 * s, 0.0, 0.0, 0.0, 0.0, 1.0, True, [1.0, 0.0]) for s in range(2)])
    one = spark.createDataFrame([(0, 0, 1)], "scene long, i long, j long")
    both = graph.mirrored(one)
    for edges, th in ((one, 0.85), (both, 1.5)):
        got = merge.hier_merge(merge.base_regions(points, 2), graph.boundary(edges, points), 2, th_f=th)
        assert {(r["seg"], r["root"]) for r in got.collect()} == {(0, 0), (1, 1)}


def test_a_region_without_valid_points_has_the_zero_vector(spark):
    points = _points(spark, [(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, False, [1.0, 2.0])])
    assert segment.pooled(points, ["scene", "seg"], 2).first()["z"] == [0.0, 0.0]


def test_normals_ignore_signs(spark):
    rows = [(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, s, True, [1.0]) for s in (1.0, -1.0, 1.0)]
    got = segment.region_normals(_points(spark, rows), ["scene", "seg"]).first()
    assert abs(got["nz"]) == pytest.approx(1)


def test_isolated_points_have_the_default_normal(spark):
    points = _points(spark, [(0, 0, float(i), 0.0, 0.0, 0.0, 1.0, 0.0, True, [1.0]) for i in range(3)])
    edges = spark.createDataFrame([(0, 0, 1)], "scene long, i long, j long")
    assert {(r["nx"], r["ny"], r["nz"]) for r in segment.point_normals(edges, points).collect()} == {(0.0, 0.0, 1.0)}


def test_curves_are_bijections_and_hilbert_steps_are_short(spark):
    n = spark.range(16)
    grid = n.select(F.col("id").alias("gx")).crossJoin(n.select(F.col("id").alias("gy"))).crossJoin(n.select(F.col("id").alias("gz")))
    for order in curves.ORDERS:
        rows = curves.with_code(grid, order, "code", depth=4).orderBy("code").collect()
        assert [r["code"] for r in rows] == list(range(4096))
        if order.startswith("hilbert"):
            at = np.array([(r["gx"], r["gy"], r["gz"]) for r in rows])
            assert (np.abs(np.diff(at, axis=0)).sum(1) == 1).all()
    code = curves.with_code(grid, "hilbert", "code", depth=4)
    assert all((r["gx"], r["gy"], r["gz"]) == (r["hx"], r["hy"], r["hz"]) for r in curves.with_hilbert_cell(code, "code", depth=4).collect())
    low = grid.withColumn("code", curves.morton("gx", "gy", "gz", 4, first_high=False))
    assert low.where("code = 1").first()["gx"] == 1


def test_negative_coordinates_floor(spark):
    assert spark.createDataFrame([(-0.01,)], "x double").select(curves.cell(F.col("x"), 0.02)).first()[0] == -1


def test_slabs_give_the_same_pairs(spark):
    points = vec_points(spark, SF)
    whole = {tuple(r) for r in graph.curve_pairs(points, 0.02, 8).select("curve", "i", "j").collect()}
    parts = {tuple(r) for r in graph.curve_pairs(points, 0.02, 8, slab_rows=40).select("curve", "i", "j").collect()}
    assert whole == parts


@pytest.mark.parametrize(("leaf_rows", "window"), [(10**6, 8), (60, 8), (5, 3)])
def test_votes_are_counted_where_points_lie(spark, leaf_rows, window):
    """Votes of cubes equal those of all pairs: sparse and crowded cells, cells of many copies, coordinates without number, two keys."""
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.random((500, 3)), rng.integers(0, 6, (500, 3)) / 50, np.full((300, 3), 0.5), rng.random((20, 3)) * 400])
    at[7, 1], at[8] = np.nan, np.inf
    rows = [(str(i % 3), int(i % 2), int(pid), *map(float, v)) for i, (pid, v) in enumerate(zip(rng.permutation(len(at)) * 10**12 - 10**14, at, strict=True))]
    points = spark.createDataFrame([*rows, ("alone", 0, 1, 0.0, 0.0, 0.0)], "scene string, part int, pid long, x double, y double, z double").repartition(3)
    keys = ["scene", "part"]
    finite = points.where("not isnan(y)")
    pairs = graph.curve_pairs(finite, 0.02, window, keys, max_dist=0.3)
    votes = pairs.groupBy(*keys, "i", "j").agg(F.count("*").alias("votes"), F.min("d2").alias("d2")).where("votes >= 3")
    both = graph.mirrored(votes)
    for k in (0, 4):
        want = both if k == 0 else graph.top_k(both, k, [F.desc("votes"), "d2", "j"], keys)
        got = voting.voted(finite, 0.02, k, window, 3, 0.3, keys, leaf_rows=leaf_rows)
        want = want.select(*keys, "i", "j", "votes", "d2")
        assert sorted(got.collect()) == sorted(want.collect()) and got.schema.simpleString() == want.schema.simpleString()
    assert got.count() > 1000
    assert voting.voted(points, 0.02, 4, window, 3, 0.3, keys, leaf_rows=leaf_rows).where("isnan(d2)").isEmpty()


def test_few_pairs_of_votes_are_written(spark):
    """Of 20,000 points in 400 cells, fewer bytes are shuffled than a tenth of the rows of all pairs on eight curves would take."""
    points = spark.range(20_000).selectExpr("0L scene", "id pid", "id % 20 / 50D x", "cast(id / 20 as long) % 20 / 50D y", "0D z").repartition(2)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert graph.curve_knn(points, 0.02, 8, 8, 4, 0.3).count() == 160_000
    assert written() - before < 20_000 * 64 * 24 / 10


def test_metrics_ignore_absent_and_unlabelled(spark):
    rows = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(255, 2)] * 9
    got = metrics.scores(metrics.confusion(spark.createDataFrame(rows, "gt int, pred int"), 4)).first()
    assert got["present"] == 2 and got["oa"] == pytest.approx(5 / 6)
    assert got["miou"] == pytest.approx((3 / 4 + 2 / 3) / 2) and got["macc"] == pytest.approx((3 / 4 + 1) / 2)


def test_absent_parts_count_as_right(spark):
    points = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 0)], "shape_id int, category int, part int, pred int")
    parts = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "category int, part int")
    assert metrics.shape_iou(points, parts).first()["iou"] == pytest.approx((1 / 2 + 0 + 1) / 3)


def test_bootstrap_summary(spark):
    deltas = spark.createDataFrame([(i, float(i)) for i in range(-10, 31)], "b int, delta double")
    got, x = metrics.summary(deltas).first(), np.arange(-10.0, 31)
    assert (got["mean"], got["sd"]) == (pytest.approx(x.mean()), pytest.approx(x.std()))
    assert (got["lo"], got["hi"]) == (pytest.approx(np.percentile(x, 2.5)), pytest.approx(np.percentile(x, 97.5)))


def test_sinkhorn_plan_has_its_marginals():
    cost = np.random.default_rng(0).random((6, 5))
    plan = shape.sinkhorn_plan(cost, epsilon=0.05, thresh=1e-9, iters=2000)
    assert np.allclose(plan.sum(0), 1 / 5, atol=1e-4) and np.allclose(plan.sum(1), 1 / 6, atol=1e-4)
    assert np.allclose(np.exp(shape.sinkhorn_normalise(-cost, 200)).sum(0), 1)


def test_farthest_points():
    assert shape.farthest_points(np.array([[0.0, 0, 0], [1, 0, 0], [10, 0, 0], [6, 0, 0]]), 3).tolist() == [0, 2, 3]


def test_grow_prefers_the_cheaper_seed():
    at = np.stack([np.arange(6.0) * 0.1, np.zeros(6), np.zeros(6)], axis=1)
    src = np.array([0, 1, 1, 2, 2, 3, 3, 4, 4, 5])
    dst = np.array([1, 0, 2, 1, 3, 2, 4, 3, 5, 4])
    nrm = np.tile([0.0, 0, 1], (6, 1))
    got = supervoxel.grow(at, np.zeros((6, 3)), nrm, src, dst, np.array([0, 5]), supervoxel.Params(voxel=0.1, seed=0.6))
    assert got.tolist() == [0, 0, 0, 1, 1, 1]


def test_supervoxels_label_every_point(spark):
    points = vec_points(spark, SF)
    got = supervoxel.vccs(points, supervoxel.Params(voxel=0.05))
    assert got.count() == points.count() and got.where("seg < 0").count() == 0


def test_confidence_and_recovery_are_bounded(spark):
    got = attention.structural_confidence(vec_points(spark, SF)).agg(F.min("q").alias("lo"), F.max("q").alias("hi")).first()
    assert 0 < got["lo"] <= got["hi"] <= 1


def test_high_threshold_equals_pooling(spark):
    from pointloom.plans import evaluate

    points, cls = vec_points(spark, SF), classes(spark, SF)
    edges = graph.boundary(graph.grid_knn(points, 8, 0.2), points)
    a = evaluate.refined_predictions(points, edges, cls, DIM, th_f=1.5).select("pid", "pred")
    assert a.exceptAll(evaluate.pooled_predictions(points, cls, DIM).select("pid", "pred")).count() == 0


def test_segments_fall_back_by_scene(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sceneId": "a", "segIndices": [5, 5, 6]}))
    (tmp_path / "b.json").write_text(json.dumps({"sceneId": "b", "segIndices": [1]}))
    mesh = scenes.read_segments(spark, str(tmp_path))
    points = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(2)], "scene string, pid long")
    other = points.withColumn("seg", F.lit(9).cast("long"))
    assert [r["seg"] for r in scenes.with_segments(points, mesh, other).orderBy("scene", "pid").collect()] == [5, 5, 6, 9, 9]


def test_sparse_features(spark):
    points = spark.createDataFrame([(0, i, i != 1) for i in range(3)], "scene long, pid long, valid boolean")
    packed = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [2.0])], "scene long, k long, feat array<double>")
    assert [r["feat"] for r in scenes.scatter_packed(points, packed).orderBy("pid").collect()] == [[1.0], None, [2.0]]
    dense = scenes.with_features(points.drop("valid"), scenes.scatter_packed(points, packed).where("feat is not null").select("scene", "pid", "feat"))
    assert [(r["valid"], r["feat"]) for r in dense.orderBy("pid").collect()] == [(True, [1.0]), (False, [0.0]), (True, [2.0])]


def test_shapes(spark, tmp_path):
    (tmp_path / "s1.txt").write_text("".join(f"{i} 0 0 0 0 1 {i % 2}\n" for i in range(5)))
    got = scenes.unit_sphere(scenes.read_shapes(spark, str(tmp_path)))
    assert got.agg(F.max("x")).first()[0] == pytest.approx(1) and got.first()["shape_id"] == "s1"
    assert scenes.resampled(got, 12).count() == 12 and scenes.resampled(got, 3).count() == 3
    assert scenes.few_shot(spark.createDataFrame([(i, i % 2) for i in range(10)], "shape_id int, category int"), 3).count() == 6


def test_scene_store(spark, tmp_path):
    points = spark.createDataFrame([("a", 1), ("b", 2)], "scene string, pid long")
    scenes.write_scenes(points, str(tmp_path / "s"))
    one = scenes.read_scenes(spark, str(tmp_path / "s"), ["b"])
    assert [r["pid"] for r in one.collect()] == [2]
    assert "PartitionFilters: [isnotnull(scene" in one._jdf.queryExecution().explainString(one.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")) or one.count() == 1
    names = spark.createDataFrame([("a",), ("c",)], "scene string")
    assert [r["scene"] for r in scenes.missing_scenes(names, points).collect()] == ["c"]


def test_payload(spark, tmp_path):
    import base64

    points = spark.createDataFrame([(0, i, float(i), 0.0, 0.0, None if i else 3, 70000 % 65536) for i in range(3)], "scene long, pid long, x double, y double, z double, gt int, region long")
    row = export.payload(points).first()
    assert np.frombuffer(base64.b64decode(row["xyz"]), "<i2").reshape(-1, 3)[:, 0].tolist() == [-16000, 0, 16000]
    assert np.frombuffer(base64.b64decode(row["gt"]), "u1").tolist() == [3, 255, 255]
    export.write_payload(export.payload(points), str(tmp_path / "out"))


def test_running_confusion(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"gt": 0, "pred": 1}\n{"gt": 255, "pred": 1}\n{"gt": 0, "pred": 1}\n')
    stream = spark.readStream.schema("gt int, pred int").json(str(source))
    q = running.start(stream, 2, "running", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("running").collect()] == [(0, 1, 2)]


def test_offsets(spark):
    got = curves.batch_of_offset(spark.createDataFrame([(0, 2), (1, 2), (2, 5)], "batch long, offset long")).collect()
    assert sorted((r["batch"], r["pos"]) for r in got) == [(0, 0), (0, 1), (2, 2), (2, 3), (2, 4)]


def test_equal_regions_tie_in_gain_however_their_rows_are_dealt(spark):
    rows = [(0, x, 1) for x in (0.1, 0.2, 0.3)] + [(1, x, 1) for x in (0.3, 0.2, 0.1)]
    gains = catalog._gain(spark.createDataFrame(rows, "seg long, x double, gt int").coalesce(1))
    assert gains.select("gain").distinct().count() == 1


def test_nearest_points_are_exact_across_slabs_and_write_k_a_point(spark):
    points = vec_points(spark, "/root/testdata/sf0.1").where("scene = 0").select("scene", "pid", "x", "y", "z")
    points = points.unionByName(points.limit(40).withColumn("pid", F.col("pid") + 10_000))  # copies, so distances tie
    rows = points.toPandas().sort_values("pid")
    pid, at = rows["pid"].to_numpy(), rows[["x", "y", "z"]].to_numpy()
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    for k, radius in ((5, 0.1), (30, 9.0)):
        want = {int(p): [int(pid[j]) for j in np.lexsort((pid, d))[:k] if d[j] <= radius**2] for p, d in zip(pid, np.round(d2, 15), strict=True)}
        for slab_rows in (60, 10_000):
            got = nearest.packed_knn(points, k, radius, slab_rows=slab_rows).collect()
            assert {r["i"]: r["js"] for r in got} == want


def test_histograms_of_packed_neighbours_equal_those_of_pairs(spark):
    points = vec_points(spark, SF)
    packed = geometry.fpfh(nearest.packed_knn(points, 30, 0.3, slab_rows=100), points)
    both = packed.join(geometry.fpfh(graph.grid_knn(points, 30, 0.3), points).withColumnRenamed("fpfh", "other"), ["scene", "pid"]).collect()
    assert len(both) == 500 and all(np.allclose(r["fpfh"], r["other"]) for r in both)


def test_payload_in_chunks_packs_a_scene_where_its_rows_lie(spark):
    points = spark.createDataFrame([(i % 2, i, float(i % 7), 1.0 * i, 0.0, i % 5, i % 300) for i in range(500)], "scene long, pid long, x double, y double, z double, gt int, region long")
    whole, parts = (sorted(map(tuple, export.payload(points, chunk_rows=n).collect())) for n in (1000, 60))
    assert whole == parts and [r[1] for r in whole] == [250, 250]
    plan = export.payload(points)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
