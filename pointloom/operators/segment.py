"""Aggregates over regions: pooled vectors, covariances, normals, voxels, softmax, robust scales."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.curves import cell
from pointloom.functions.vectors import EPS, TINY, norm, scaled, sums, with_unit

UNROLLED = 90  # with other columns, within the fields that Spark generates code for (spark.sql.codegen.maxFields)
PAIRS = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))


def summed(rows: DataFrame, keys: Sequence[str], vector: str, dim: int, weight: str, out: str = "z", unrolled: int = UNROLLED) -> DataFrame:
    """(keys, out, w, n): weighted sum of a vector column by group, sum of the weights, and rows.

    Up to `unrolled` components are an aggregate each, in generated code. Longer vectors would leave it and hash a buffer
    a component, so tasks sum theirs over Arrow batches and one row a task and group is summed after the shuffle. A null
    vector counts as zero.
    """
    if dim <= unrolled:
        return rows.groupBy(*keys).agg(sums(vector, dim, F.col(weight)).alias(out), F.sum(weight).alias("w"), F.count("*").alias("n"))
    keys = list(keys)
    source = rows.select(*keys, F.col(vector).cast("array<double>").alias("v"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"), F.lit(1).cast("long").alias("n"))
    schema = source.schema
    kinds = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys) + ", v array<double>, w double, n long"

    def matrix(column: pa.Array, w: np.ndarray) -> np.ndarray:
        x = np.zeros((len(column), dim))
        there = column.is_valid().to_numpy(zero_copy_only=False)
        x[there] = np.nan_to_num(pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim))
        return x * w[:, None]

    def grouped(table: pa.Table, x: np.ndarray) -> pa.Table:
        frame = table.select(keys).to_pandas()
        of = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.diff(of[order], prepend=-1))
        take = pa.array(order[first])
        add = lambda v: np.add.reduceat(v[order], first, axis=0)
        v, w, n = add(x), add(table.column("w").to_numpy()), add(table.column("n").to_numpy())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel()))
        return pa.table([*(c for c in table.select(keys).take(take).columns), lists, pa.array(w), pa.array(n)], names=[*keys, "v", "w", "n"])

    def partial(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            part = grouped(own, matrix(batch.column(len(keys)), batch.column(len(keys) + 1).to_numpy()))
            held = part if held is None else _resum(pa.concat_tables([held, part]))
            if held.num_rows * dim > 1 << 23:  # 64 MB
                yield from held.combine_chunks().to_batches()
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches()

    def _resum(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return grouped(table, matrix(table.column("v").chunk(0), np.ones(table.num_rows)))

    got = source.mapInArrow(partial, kinds).groupBy(*keys).applyInArrow(_resum, kinds)
    return got.select(*keys, F.col("v").alias(out), "w", "n")


def segment_mean(points: DataFrame, keys: Sequence[str], dim: int, vector: str = "feat", weight: str = "w", out: str = "z") -> DataFrame:
    """Weighted mean of a vector by region; a region without weight has the zero vector."""
    total = summed(points, keys, vector, dim, weight, out)
    return total.withColumn(out, scaled(F.col(out), 1 / F.greatest(F.col("w"), F.lit(EPS))))


def pooled(points: DataFrame, keys: Sequence[str], dim: int, vector: str = "feat", valid: str = "valid") -> DataFrame:
    """Unit mean of the valid points' unit vectors by region: (keys, z, w, n)."""
    # the length goes into the weight, one number a row; scaling the vector itself would touch every component twice
    weighted = points.withColumn("__w", F.col(valid).cast("double") / F.greatest(norm(F.col(vector)), F.lit(TINY)))
    return with_unit(segment_mean(weighted, keys, dim, vector, "__w"), "z")


def moments(points: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("nx", "ny", "nz")) -> DataFrame:
    """The six sums of products of three columns by region, which add up over merged regions."""
    at = dict(zip("xyz", axes, strict=True))
    return points.groupBy(*keys).agg(*[F.sum(F.col(at[a]) * F.col(at[b])).alias(f"c{a}{b}") for a, b in PAIRS], F.count("*").alias("n"))


def covariances(edges: DataFrame, points: DataFrame, keys: Sequence[str] = ("scene",), with_self: bool = False) -> DataFrame:
    """Covariance of each point's out-neighbours about their mean: (keys, pid, cnt, cxx, ..., czz), with 1e-9 on the diagonal.

    `with_self` adds the point to its own neighbourhood.
    """
    to = points.select(*keys, F.col("pid").alias("j"), "x", "y", "z")
    edges = edges.select(*keys, "i", "j")
    edges = edges.unionByName(points.select(*keys, F.col("pid").alias("i"), F.col("pid").alias("j"))) if with_self else edges
    got = edges.join(to, [*keys, "j"]).groupBy(*keys, "i").agg(F.count("*").alias("cnt"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in PAIRS])
    cov = [((F.col(f"s{a}{b}") - F.col("cnt") * F.col(f"m{a}") * F.col(f"m{b}")) / F.greatest("cnt", F.lit(1)) + (1e-9 if a == b else 0.0)).alias(f"c{a}{b}") for a, b in PAIRS]
    return got.select(*keys, F.col("i").alias("pid"), "cnt", *cov)


def eigenvector(largest: bool) -> Column:
    """Unit eigenvector (struct x, y, z) of the symmetric matrix cxx..czz, of the largest or smallest value; Arrow batches.

    Its sign is such that the component of the largest size is positive.
    """

    @F.pandas_udf("x double, y double, z double")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for six in batches:
            xx, xy, xz, yy, yz, zz = (np.nan_to_num(s.to_numpy(np.float64)) for s in six)
            matrix = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
            found = np.linalg.eigh(matrix)[1][:, :, 2 if largest else 0]
            lead = np.take_along_axis(found, np.abs(found).argmax(1)[:, None], 1)
            found = found * np.where(lead < 0, -1.0, 1.0)
            yield pd.DataFrame(found, columns=["x", "y", "z"])

    return of(*[F.col(f"c{a}{b}") for a, b in PAIRS])


def region_normals(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean direction of a region's normals whichever way each points: (keys, nx, ny, nz, n)."""
    got = moments(points, keys).withColumn("v", eigenvector(True))
    return got.select(*keys, F.col("v.x").alias("nx"), F.col("v.y").alias("ny"), F.col("v.z").alias("nz"), "n")


def point_normals(edges: DataFrame, points: DataFrame, keys: Sequence[str] = ("scene",), with_self: bool = False) -> DataFrame:
    """Normals from a neighbour graph; points with fewer than three neighbours, or none, get (0, 0, 1).

    With grid_knn of a radius as edges and `with_self`, normals of a bounded neighbourhood; with exact_knn, of the k nearest.
    """
    got = covariances(edges, points, keys, with_self).withColumn("v", eigenvector(False))
    few = (F.col("cnt") < 3) | F.col("cnt").isNull()
    up = {"x": 0.0, "y": 0.0, "z": 1.0}
    return points.select(*keys, "pid").join(got, [*keys, "pid"], "left").select(*keys, "pid", *[F.when(few, F.lit(up[c])).otherwise(F.col(f"v.{c}")).alias(f"n{c}") for c in "xyz"])


def segment_softmax(edges: DataFrame, keys: Sequence[str], score: str, out: str = "a") -> DataFrame:
    """Softmax of a score within each group, by grouped sums and joins: a group needs no window of its own."""
    keys = list(keys)
    top = edges.groupBy(*keys).agg(F.max(score).alias("__max"))
    raised = edges.join(top, keys).withColumn("__e", F.exp(F.col(score) - F.col("__max")))
    total = raised.groupBy(*keys).agg(F.sum("__e").alias("__sum"))
    return raised.join(total, keys).withColumn(out, F.col("__e") / F.greatest("__sum", F.lit(EPS))).drop("__max", "__e", "__sum")


def robust_scale(points: DataFrame, keys: Sequence[str], value: str, mode: str = "mean", out: str = "scale") -> DataFrame:
    """Scale of a residual by region, mean or upper median, at least a hundredth of the mean over everything."""
    if mode == "mean":
        got = points.groupBy(*keys).agg(F.avg(value).alias("__s"))
    else:
        # the upper median by rank: sorted by the shuffle, never a region in one array
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1
        n = points.groupBy(*keys).agg(F.count(value).alias("__n"))
        ranked = points.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__s"), at.alias("__at"))
        got = ranked.join(n, list(keys)).where("__at = __n div 2").select(*keys, "__s")
    whole = points.agg(F.avg(value).alias("__g"))  # one row
    return got.join(F.broadcast(whole)).select(*keys, F.greatest("__s", 0.01 * F.col("__g"), F.lit(EPS)).alias(out))


def voxel_mean(points: DataFrame, size: float, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Voxels with mean position, colour and unit normal: (keys, cx, cy, cz, n, x, y, z, ...)."""
    extra = [c for c in ("r", "g", "b", "nx", "ny", "nz") if c in points.columns]
    cells = [cell(F.col(c), size).alias(f"c{c}") for c in "xyz"]
    got = points.select(*keys, *cells, "x", "y", "z", *extra).groupBy(*keys, "cx", "cy", "cz").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "z", *extra)])
    if "nx" in extra:
        length = F.greatest(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), F.lit(1e-8))
        got = got.withColumn("__l", length)
        got = got.withColumns({c: F.col(c) / F.col("__l") for c in ("nx", "ny", "nz")}).drop("__l")
    return got


def voxel_first(points: DataFrame, size: float, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """The point with the smallest pid of every voxel."""
    return points.groupBy(*keys, *[cell(F.col(c), size).alias(f"c{c}") for c in "xyz"]).agg(F.min("pid").alias("pid"), F.count("*").alias("n"))


def dense_labels(rows: DataFrame, label: str, keys: Sequence[str] = ("scene",), out: str = "dense") -> DataFrame:
    """Numbers 0.. for the labels of each scene, in order; ranks the distinct labels, not the rows."""
    distinct = rows.select(*keys, label).distinct()
    ranked = distinct.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(label)) - 1)
    return rows.join(ranked, [*keys, label])
