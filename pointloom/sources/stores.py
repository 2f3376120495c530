"""Stores that queries fill once and read again: confusions by scene, class tables, predictions, view features, results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.sources.scenes import missing_scenes


def write_by(rows: DataFrame, path: str, keys: Sequence[str] = ("scene",)) -> None:
    """Folders by key; only the folders of the rows at hand are replaced, so parts can be written again on their own."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fill_scenes(points: DataFrame, path: str, make) -> DataFrame:
    """The store at `path` with `make(points)` added for the scenes that it does not have: a pre-pass that can be resumed."""
    spark = points.sparkSession
    todo = points
    if exists(spark, path):
        todo = points.join(missing_scenes(points.select("scene").distinct(), spark.read.parquet(path)), "scene", "left_semi")
    if not todo.isEmpty():
        write_by(make(todo), path)
    return spark.read.parquet(path)


def write_confusion(table: DataFrame, path: str) -> None:
    """(scene, method, gt, pred, n), a folder a scene: what bootstraps are drawn from."""
    write_by(table.select("scene", "method", "gt", "pred", "n"), path)


def read_confusion(spark: SparkSession, path: str, methods: Sequence[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if methods is None else table.where(F.col("method").isin(list(methods)))


def class_table(spark: SparkSession, path: str, dataset: str, make) -> DataFrame:
    """The class vectors of a dataset, made once and then read."""
    at = f"{path}/dataset={dataset}"
    if not exists(spark, at):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_predictions(rows: DataFrame, path: str) -> None:
    """(scene, pid, pred), a folder a scene, small integers."""
    write_by(rows.select("scene", "pid", F.col("pred").cast("smallint").alias("pred")), path)


def write_view_features(maps: DataFrame, path: str) -> None:
    """Feature maps (category, shape_id, view, cell, feat), a folder a category."""
    write_by(maps, path, ["category"])


def write_result(scores: DataFrame, path: str, **settings) -> None:
    """Scores with the settings they were made with, as JSON lines."""
    for name, value in settings.items():
        scores = scores.withColumn(name, F.lit(value))
    scores.coalesce(1).write.mode("overwrite").json(path)  # a row a method


def of_class(shapes: DataFrame, category: str, n_points: int | None = None) -> DataFrame:
    """Shapes of one category (pushed down to the files), each cut to its first points."""
    found = shapes.where(F.col("category") == category)
    return found if n_points is None else found.where(F.col("pid") < n_points)


def scans_with_features(names: DataFrame, features: DataFrame) -> DataFrame:
    """The scans that have features, for lists that are taken from a folder of features."""
    return names.join(features.select("scene").distinct(), "scene", "left_semi")
