"""Scenes as tables: point clouds with sparse features, over-segmentations, lists and samples of scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_scenes(spark: SparkSession, path: str, scenes: Sequence[str] | None = None) -> DataFrame:
    """Point tables partitioned by scene; only the named scenes' folders are read."""
    points = spark.read.parquet(path)
    return points if scenes is None else points.where(F.col("scene").isin(list(scenes)))


def write_scenes(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder a scene; `mode` overwrite replaces only the scenes at hand."""
    points.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("scene").parquet(path)


def missing_scenes(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Scenes that a store does not have yet (skip what exists)."""
    return wanted.join(done.select("scene").distinct(), "scene", "left_anti")


def sampled(names: DataFrame, stride: int = 1, limit: int | None = None) -> DataFrame:
    """Every stride-th scene by name, up to a number of them. The list of scenes is small next to their points."""
    ranked = names.withColumn("at", F.row_number().over(Window.orderBy("scene")) - 1).where(F.col("at") % stride == 0)
    return (ranked if limit is None else ranked.where(F.col("at") < stride * limit)).drop("at")


def with_features(points: DataFrame, features: DataFrame, keys: Sequence[str] = ("scene", "pid")) -> DataFrame:
    """Sparse features joined on: `valid` tells which points have one; the others get the zero vector."""
    joined = points.join(features.withColumn("__has", F.lit(True)), list(keys), "left")
    width = features.select(F.size("feat").alias("n")).limit(1)
    zero = F.coalesce(F.col("feat"), F.array_repeat(F.lit(0.0), F.col("n")))
    return joined.join(F.broadcast(width), how="left").withColumns({"valid": F.coalesce("__has", F.lit(False)), "feat": zero}).drop("__has", "n")


def scatter_packed(points: DataFrame, packed: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Features stored for the valid points only, in order: the k-th packed row belongs to the k-th valid point.

    points: (keys, pid, valid); packed: (keys, k from 0, feat).
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("pid")) - 1
    numbered = points.where("valid").withColumn("k", rank.cast("long"))
    return points.join(numbered.join(packed, [*keys, "k"]).select(*keys, "pid", "feat"), [*keys, "pid"], "left")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(scene, pid, seg) of over-segmentation files in JSON, one object with `sceneId` and `segIndices` each."""
    raw = spark.read.schema("sceneId string, segIndices array<long>").option("multiLine", True).json(path)
    return raw.select(F.col("sceneId").alias("scene"), F.posexplode("segIndices").alias("pid", "seg")).withColumn("pid", F.col("pid").cast("long"))


def with_segments(points: DataFrame, mesh: DataFrame, fallback: DataFrame) -> DataFrame:
    """The mesh partition of each scene where it has as many entries as the scene has points; the other one elsewhere."""
    n = points.groupBy("scene").agg(F.count("*").alias("n"))
    good = mesh.groupBy("scene").agg(F.count("*").alias("m")).join(n, "scene").where("m = n").select("scene")
    chosen = mesh.join(good, "scene", "left_semi").select("scene", "pid", "seg").unionByName(fallback.join(good, "scene", "left_anti").select("scene", "pid", "seg"))
    return points.join(chosen, ["scene", "pid"])


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(shape_id, pid, x, y, z, nx, ny, nz, part) of text files with blanks between numbers, one file a shape."""
    number = "x double, y double, z double, nx double, ny double, nz double, part double"
    rows = spark.read.schema(number).option("sep", " ").csv(path).withColumn("file", F.input_file_name())
    rows = rows.withColumns({"shape_id": F.regexp_extract("file", "([^/]+)\\.[^./]+$", 1), "line": F.monotonically_increasing_id()})
    return rows.withColumn("pid", (F.row_number().over(Window.partitionBy("shape_id").orderBy("line")) - 1).cast("long")).withColumn("part", F.col("part").cast("int")).drop("file", "line")


def unit_sphere(points: DataFrame, key: str = "shape_id") -> DataFrame:
    """Centred on the mean and scaled to reach one."""
    mean = points.groupBy(key).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    moved = points.join(mean, key).withColumns({c: F.col(c) - F.col(f"m{c}") for c in "xyz"}).drop("mx", "my", "mz")
    far = moved.groupBy(key).agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("far"))
    return moved.join(far, key).withColumns({c: F.col(c) / F.greatest("far", F.lit(1e-12)) for c in "xyz"}).drop("far")


def resampled(points: DataFrame, n: int, seed: int = 0, key: str = "shape_id") -> DataFrame:
    """n points of each shape in the order of a seeded hash; a shape with fewer repeats its points in that order."""
    order = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), "pid"), "pid")
    size = points.groupBy(key).agg(F.count("*").alias("m"))
    ranked = points.withColumn("at", F.row_number().over(order) - 1).join(size, key).where(F.col("at") < n)
    again = F.sequence(F.col("at").cast("long"), F.lit(n - 1).cast("long"), F.col("m"))
    return ranked.withColumn("slot", F.explode(again)).drop("at", "m")


def few_shot(shapes: DataFrame, k: int = 16, seed: int = 0, label: str = "category", key: str = "shape_id") -> DataFrame:
    """k shapes of each label by a seeded hash."""
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return shapes.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def assembled(points: DataFrame, features: DataFrame, geometry: DataFrame | None = None, mesh: DataFrame | None = None, partition: DataFrame | None = None, keys: Sequence[str] = ("scene", "pid")) -> DataFrame:
    """Points with sparse features (`valid`, `feat`), geometry columns where there are any, and `seg` of the mesh or else of the other partition."""
    out = with_features(points, features, keys)
    if geometry is not None:
        out = out.join(geometry, list(keys), "left")
    if mesh is not None and partition is not None:
        return with_segments(out, mesh, partition)
    one = mesh if partition is None else partition
    return out if one is None else out.join(one.select(*keys, "seg"), list(keys))
