"""Viewer payloads: quantised coordinates and packed columns a scene, as JSON."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.segment import voxel_first

PACKED = ["xyz", "gt", "region"]


def _boxes(points: DataFrame, steps: int) -> DataFrame:
    box = points.groupBy("scene").agg(*[F.min(c).alias(f"lo{c}") for c in "xyz"], *[F.max(c).alias(f"hi{c}") for c in "xyz"])
    return box.select("scene", (F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"]) / steps).alias("scale"), *[((F.col(f"hi{c}") + F.col(f"lo{c}")) / 2).alias(f"mid{c}") for c in "xyz"])


def quantised(points: DataFrame, steps: int = 32_000) -> DataFrame:
    """Coordinates as whole numbers of 1/steps of the scene's largest extent, from its middle; halves go to even."""
    got = points.join(_boxes(points, steps), "scene")
    return got.withColumns({f"q{c}": F.rint((F.col(c) - F.col(f"mid{c}")) / F.col("scale")).cast("int") for c in "xyz"}).drop("midx", "midy", "midz")


def payload(points: DataFrame, ignore: int = 255, voxel: float | None = None, chunk_rows: int = 200_000) -> DataFrame:
    """(scene, n_points, n_points_full, scale, xyz, gt, region): a row a scene for the viewer, points by pid.

    A viewer holds a whole scene, so a scene is a row here; `voxel` thins it to a point a cell before. Points are dealt
    by ranges of (scene, pid) and packed to bytes where they lie, so a scene meets only as bytes (9 a point).
    """
    full = points.groupBy("scene").agg(F.count("*").alias("n_points_full"))
    if voxel is not None:
        points = points.join(voxel_first(points, voxel).select("scene", "pid"), ["scene", "pid"], "left_semi")
    # three coordinates as 21 bits each of one number, which sorts as they do: the shuffle is most of the disk
    cells = sum((F.coalesce(f"q{c}", F.lit(0)).cast("long") + (1 << 20)) * (1 << 21 * i) for i, c in enumerate("zyx"))
    rows = quantised(points).select("scene", "pid", cells.alias("q"), F.coalesce("gt", F.lit(ignore)).alias("gt"), "region")
    kind = rows.schema["scene"].dataType.simpleString()
    parts = max(1, -(-points.count() // chunk_rows))
    order = ["scene", "pid", "q", "gt", "region"]  # as structs of them are ordered
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def chunks(batches):
        from pyspark import TaskContext

        at, n = TaskContext.get().partitionId(), 0
        number = lambda t, c, kind: t.column(c).cast("float64").to_numpy(zero_copy_only=False).astype(kind)
        for batch in batches:
            scenes = batch.column("scene")
            new = pc.fill_null(pc.not_equal(scenes[1:], scenes[:-1]), True).to_numpy(zero_copy_only=False) if batch.num_rows > 1 else np.zeros(0, bool)
            cut = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cut, cut[1:], strict=False):
                t = batch.slice(a, b - a)
                q = t.column("q").to_numpy()
                xyz = np.stack([((q >> shift) & (1 << 21) - 1) - (1 << 20) for shift in (42, 21, 0)], axis=1).astype("<i2").tobytes()
                cells = [[at], [n], [b - a], [xyz], [number(t, "gt", "<u1").tobytes()], [number(t, "region", "<u2").tobytes()]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([t.column("scene").slice(0, 1), *(pa.array(v, k) for v, k in zip(cells, kinds, strict=True))], names=["scene", "part", "at", "n", *PACKED])
                n += 1

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("at", "ascending")])
        lines = lambda c: base64.encodebytes(b"".join(t.column(c).to_pylist())).rstrip(b"\n").replace(b"\n", b"\r\n")
        whole = [[lines(c).decode()] for c in PACKED]  # in lines of 76, as Spark's own base64
        return pa.table([t.column("scene").slice(0, 1), pa.array([pc.sum(t.column("n")).as_py()], pa.int32()), *whole], names=["scene", "n_points", *PACKED])

    pieces = rows.mapInArrow(chunks, f"scene {kind}, part long, at long, n long, xyz binary, gt binary, region binary")
    one = pieces.groupBy("scene").applyInArrow(joined, f"scene {kind}, n_points int, xyz string, gt string, region string")
    return one.join(full, "scene").join(_boxes(points, 32_000), "scene").select("scene", "n_points", "n_points_full", "scale", *PACKED)


def write_payload(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("scene").json(path)
