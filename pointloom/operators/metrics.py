"""Confusion tables and what follows from them: IoU, accuracy, bootstrap, split halves, shape scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORE = 255


def confusion(rows: DataFrame, n_classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, gt, pred, n); labels outside 0..n_classes-1 do not count."""
    return rows.where(F.col("gt").between(0, n_classes - 1)).groupBy(*keys, F.col("gt").cast("int").alias("gt"), F.col("pred").cast("int").alias("pred")).agg(F.count("*").alias("n"))


def class_scores(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cls, tp, gt_n, pred_n, iou, acc), from one pass: a cell counts for its row, its column and the diagonal."""
    cells = table.select(*keys, F.explode(F.array(F.struct(F.col("gt").alias("cls"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("cls"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("e"), "gt", "pred", "n")
    got = cells.groupBy(*keys, F.col("e.cls").alias("cls")).agg(F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n") * F.col("e.g")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("e.g")).alias("gt_n"), F.sum(F.col("n") * F.col("e.p")).alias("pred_n"))
    iou = F.col("tp") / F.greatest(F.col("gt_n") + F.col("pred_n") - F.col("tp"), F.lit(1))
    return got.withColumns({"iou": iou, "acc": F.col("tp") / F.greatest(F.col("gt_n"), F.lit(1))})


def scores(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, miou, macc, oa, present): means over classes that occur in the ground truth; zero if none does."""
    here = F.col("gt_n") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(here, F.col(c))), F.lit(0.0))
    oa = F.coalesce(F.sum("tp") / F.greatest(F.sum("gt_n"), F.lit(1)), F.lit(0.0))
    aggs = [mean("iou").alias("miou"), mean("acc").alias("macc"), oa.alias("oa"), F.count(F.when(here, 1)).alias("present")]
    return class_scores(table, keys).groupBy(*keys).agg(*aggs)


def bootstrap_draws(n: int, b: int, seed: int = 0, halves: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Multiplicities (b, n) of scenes drawn with replacement; then, from the same generator, `halves` random halves."""
    rng = np.random.default_rng(seed)
    mult = np.stack([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(b)]) if b else np.zeros((0, n), int)
    half = np.zeros((halves, n), int)
    for i in range(halves):
        half[i, rng.permutation(n)[: n // 2]] = 1
    return mult, half


def draws_table(spark: SparkSession, scenes: Sequence[int], mult: np.ndarray) -> DataFrame:
    """(b, scene, mult): a row for each draw and drawn scene, made from literals of a bounded number of draws."""
    rows = [(int(b), int(s), int(m)) for b, line in enumerate(mult) for s, m in zip(scenes, line, strict=True) if m]
    return spark.createDataFrame(rows, "b int, scene int, mult int")


def resampled(tables: DataFrame, draws: DataFrame, a: str, b: str) -> DataFrame:
    """(b, delta): mIoU of method `b` minus that of `a` in every draw; tables has (scene, method, gt, pred, n).

    Draws grow with the number of scenes, so whether they are broadcast is left to Spark, which knows their size.
    """
    drawn = tables.join(draws, "scene").groupBy("b", "method", "gt", "pred").agg(F.sum(F.col("n") * F.col("mult")).alias("n"))
    each = scores(drawn, ["b", "method"])
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("miou")))
    return each.groupBy("b").agg((pick(b) - pick(a)).alias("delta"))


def summary(deltas: DataFrame) -> DataFrame:
    """Mean, population deviation, 2.5 and 97.5 percentiles and the share above zero."""
    return deltas.agg(F.avg("delta").alias("mean"), F.stddev_pop("delta").alias("sd"), F.expr("percentile(delta, 0.025)").alias("lo"), F.expr("percentile(delta, 0.975)").alias("hi"), F.avg((F.col("delta") > 0).cast("double")).alias("p_above"))


def shape_iou(points: DataFrame, parts: DataFrame) -> DataFrame:
    """(shape_id, category, iou): mean over a category's parts; a part that neither has counts as 1.

    points: (shape_id, category, part, pred); parts: (category, part), small.
    """
    per = points.select("shape_id", "category", F.explode(F.array(F.struct(F.col("part").alias("p"), F.lit(1).alias("g"), F.lit(0).alias("q")), F.struct(F.col("pred").alias("p"), F.lit(0).alias("g"), F.lit(1).alias("q")))).alias("e"), (F.col("part") == F.col("pred")).cast("int").alias("hit"))
    counts = per.groupBy("shape_id", "category", F.col("e.p").alias("part")).agg(F.sum(F.col("hit") * F.col("e.g")).alias("tp"), F.sum("e.g").alias("g"), F.sum("e.q").alias("q"))
    every = points.select("shape_id", "category").distinct().join(parts, "category")
    got = every.join(counts, ["shape_id", "category", "part"], "left").withColumn("u", F.coalesce(F.col("g") + F.col("q") - F.col("tp"), F.lit(0)))
    return got.withColumn("iou", F.when(F.col("u") == 0, 1.0).otherwise(F.col("tp") / F.col("u"))).groupBy("shape_id", "category").agg(F.avg("iou").alias("iou"))


def shape_accuracy(points: DataFrame) -> DataFrame:
    """Mean over shapes of the percentage of points with the right part."""
    each = points.groupBy("shape_id").agg(F.avg((F.col("part") == F.col("pred")).cast("double")).alias("a"))
    return each.agg((100 * F.avg("a")).alias("accuracy"))


def averages(rows: DataFrame, *columns: str, keys: Sequence[str] = ()) -> DataFrame:
    """Means of columns over scenes, such as numbers of regions or seconds, and how many scenes there are."""
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("scenes"))
