"""Exact nearest neighbours: slabs of points along a curve, a kernel over boxes of points, and a second step across slabs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.curves import interleave
from pointloom.plans.storage import stored

LEAF = 32  # points a box
SLAB = 25_000  # points a task
BOX = 512  # points a box that other slabs see
HOME, ASKED = 1, 2  # roles of a row: may be found, asks


def _gap(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Squared least distance of boxes; never above that of two of their points, also as rounded."""
    d = np.maximum(np.maximum(lo - other_hi, other_lo - hi), 0.0)
    return d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2


def _boxes(xyz: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(xyz), size)
    return np.minimum.reduceat(xyz, at), np.maximum.reduceat(xyz, at)


def nearest(home: np.ndarray, home_pid: np.ndarray, xyz: np.ndarray, pid: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest other points of each asking one, at squared distance `most` at most: (row, j, d2) by row, d2 and j, and how far a better one may be.

    Both sides should follow a curve: rows are asked in runs of LEAF, of boxes of LEAF points.
    """
    found, far = [], most.copy()
    if not len(home):
        return np.zeros(0, np.int64), home_pid[:0], np.zeros(0), far
    lo, hi = _boxes(home, LEAF)

    def squares(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = (xyz[q, 0][:, None] - home[at, 0]) ** 2
        d += (xyz[q, 1][:, None] - home[at, 1]) ** 2
        d += (xyz[q, 2][:, None] - home[at, 2]) ** 2
        return d

    def points_of(leaves: np.ndarray) -> np.ndarray:
        at = (np.sort(leaves)[:, None] * LEAF + np.arange(LEAF)).ravel()
        return at[at < len(home)]

    for a in range(0, len(xyz), LEAF):
        q = np.arange(a, min(a + LEAF, len(xyz)))
        gap = _gap(lo, hi, xyz[q].min(0), xyz[q].max(0))
        order = np.argsort(gap, kind="stable")
        at = points_of(order[: 4 + 2 * k // LEAF])
        if len(at) > k:  # one of them may be the asking point itself
            far[q] = np.minimum(far[q], np.partition(squares(q, at), k, axis=1)[:, k])
        at = points_of(order[gap[order] <= far[q].max()])
        step = max(1, (1 << 17) // max(1, len(at)))
        for b in range(0, len(q), step):
            part = q[b : b + step]
            d = squares(part, at)
            row, col = np.nonzero(d <= far[part][:, None])
            other = home_pid[at[col]] != pid[part[row]]
            row, col = row[other], col[other]
            d2, j = d[row, col], home_pid[at[col]]
            order_ = np.lexsort((j, d2, row))
            row, d2, j = row[order_], d2[order_], j[order_]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            last = rank == k - 1
            far[part[row[last]]] = d2[last]
            row, d2, j = row[rank < k], d2[rank < k], j[rank < k]
            found.append((part[row], j, d2))
    return *(np.concatenate(v) for v in zip(*found, strict=True)), far


def _lists(rows: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """A list a row of values ordered by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values))


def packed_knn(points: DataFrame, k: int, radius: float, keys: Sequence[str] = ("scene",), asked: DataFrame | None = None, slab_rows: int = SLAB) -> DataFrame:
    """Up to k nearest others within a radius of points (or those of `asked`): (keys, slab, i, js, d2s), a row a point, nearest first.

    Rows are dealt by ranges of a curve's codes into slabs. A slab answers for its own rows; those whose k-th neighbour
    is farther than a box of another slab's points ask that slab too. So pairs are compared where boxes meet, and only
    k of them a point and slab are ever written, whatever the radius. Coordinates that are not finite meet nothing.
    """
    keys, n = list(keys), len(keys)
    xyz = [F.col(c).cast("double").alias(c) for c in "xyz"]
    rows = points.select(*keys, "pid", *xyz, F.lit(HOME if asked is not None else HOME | ASKED).alias("role"))
    if asked is not None:
        rows = rows.unionByName(asked.select(*keys, "pid", *xyz, F.lit(ASKED).alias("role")))
    finite = [F.col(c).isNotNull() & (F.abs(c) < float("inf")) for c in "xyz"]
    rows = rows.where(finite[0] & finite[1] & finite[2])
    box = rows.groupBy(*keys).agg(*[F.min(c).alias(f"lo{c}") for c in "xyz"], *[F.max(c).alias(f"hi{c}") for c in "xyz"])
    cells = [F.floor((F.col(c) - F.col(f"lo{c}")) / F.greatest(F.col(f"hi{c}") - F.col(f"lo{c}"), F.lit(1e-300)) * 16383).cast("long") for c in "xyz"]
    slabs = -(-rows.count() // slab_rows)
    rows = rows.join(box, keys).select(*keys, "pid", "x", "y", "z", "role", interleave(*cells).alias("code"))
    order = [*keys, "code", "pid"]
    rows = stored(rows.repartitionByRange(slabs, *order).sortWithinPartitions(*order)) if slabs > 1 else rows.coalesce(1).sortWithinPartitions(*order)
    kind = rows.schema["pid"].dataType.simpleString()
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    def runs(batches):
        """(first row's keys, table) of each run of keys; a slab is bounded, so it is held."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        new = np.ones(whole.num_rows, bool)
        if whole.num_rows > 1:
            new[1:] = False
            for c in range(n):
                v = whole.column(c).chunk(0)
                new[1:] |= np.array([x != y for x, y in zip(v[1:].to_pylist(), v[:-1].to_pylist(), strict=True)]) if pa.types.is_nested(v.type) else pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
        cut = [*np.flatnonzero(new).tolist(), whole.num_rows]
        for a, b in zip(cut, cut[1:], strict=False):
            yield tuple(whole.column(c)[a].as_py() for c in range(n)), whole.slice(a, b - a)

    def arrays(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return part.column("pid").to_numpy(), np.stack([part.column(c).to_numpy() for c in "xyz"], axis=1)

    def ranges(batches):
        from pyspark import TaskContext

        for key, part in runs(batches):
            pid, at = arrays(part.filter(pc.equal(pc.bit_wise_and(part.column("role"), HOME), HOME)))
            if len(pid):
                lo, hi = _boxes(at, BOX)
                fixed = [pa.array([v] * len(lo), part.schema.field(c).type) for c, v in enumerate(key)]
                slab = pa.array(np.full(len(lo), TaskContext.get().partitionId(), np.int32))
                yield pa.RecordBatch.from_arrays([*fixed, slab, *(pa.array(v[:, i]) for v in (lo, hi) for i in range(3))], names=[*keys, "slab", *(f"{s}{c}" for s in ("lo", "hi") for c in "xyz")])

    places: dict[tuple, np.ndarray] = {}
    if slabs > 1:
        # a row for BOX points of scenes that lie in several slabs
        ends = rows.mapInArrow(ranges, f"{kinds}, slab int, {', '.join(f'{s}{c} double' for s in ('lo', 'hi') for c in 'xyz')}")
        cut = ends.groupBy(*keys).agg(F.count_distinct("slab").alias("__n")).where("__n > 1").drop("__n")
        for r in ends.join(cut, keys).collect():
            places.setdefault(tuple(r[c] for c in keys), []).append([r[c] for c in ("slab", "lox", "loy", "loz", "hix", "hiy", "hiz")])
        places = {key: np.array(v, np.float64) for key, v in places.items()}
    others = rows.sparkSession.sparkContext.broadcast(places)

    def first(batches):
        from pyspark import TaskContext

        slab = TaskContext.get().partitionId()
        for key, part in runs(batches):
            role = part.column("role").to_numpy()
            asks = part.filter(pa.array(role & ASKED > 0))
            home_pid, home = arrays(part.filter(pa.array(role & HOME > 0)))
            pid, at = arrays(asks)
            if not len(pid):
                continue
            row, j, d2, far = nearest(home, home_pid, at, pid, np.full(len(pid), float(radius) ** 2), k)
            away = others.value.get(key)
            ask_row, ask_slab = np.zeros(0, np.int64), np.zeros(0, np.int32)
            if away is not None:
                away = away[away[:, 0] != slab]
                met = []
                for a in range(0, len(pid), LEAF):
                    q = slice(a, a + LEAF)
                    near = away[_gap(away[:, 1:4], away[:, 4:7], at[q].min(0), at[q].max(0)) <= far[q].max()]
                    r, c = np.nonzero(_gap(near[None, :, 1:4], near[None, :, 4:7], at[q][:, None], at[q][:, None]) <= far[q][:, None])
                    met.append(np.stack([r + a, near[c, 0].astype(np.int64)], axis=1))
                met = np.unique(np.concatenate(met), axis=0)
                ask_row, ask_slab = met[:, 0], met[:, 1].astype(np.int32)
            fixed = [c.combine_chunks() for c in asks.columns[:n]]
            yield pa.RecordBatch.from_arrays(
                [*fixed, pa.array(np.full(len(pid), slab, np.int32)), asks.column("pid").combine_chunks(), _lists(row, len(pid), j), _lists(row, len(pid), d2), *(pa.array(at[:, i]) for i in range(3)), pa.array(far), _lists(ask_row, len(pid), ask_slab)],
                names=[*keys, "slab", "i", "js", "d2s", "x", "y", "z", "far", "to"],
            )

    out = [*keys, "slab", "i", "js", "d2s"]
    found = rows.mapInArrow(first, f"{kinds}, slab int, i {kind}, js array<{kind}>, d2s array<double>, x double, y double, z double, far double, to array<int>")
    if not places:
        return found.select(*out)
    found = stored(found)
    open_ = found.where("size(to) > 0")
    asking = open_.select(*keys, F.explode("to").alias("to"), "slab", "i", "x", "y", "z", "far")
    home = rows.where(F.col("role").bitwiseAND(F.lit(HOME)) > 0).select(*keys, F.spark_partition_id().alias("to"), "pid", "x", "y", "z", "code")

    def second(q: pa.Table, part: pa.Table) -> pa.Table:
        names = [*out]
        if q.num_rows and part.num_rows:
            home_pid, at = arrays(part.sort_by([("code", "ascending"), ("pid", "ascending")]))
            q = q.sort_by([("slab", "ascending"), ("x", "ascending")])
            ask = np.stack([q.column(c).to_numpy() for c in "xyz"], axis=1)
            pid, most = q.column("i").to_numpy(), q.column("far").to_numpy()
            row, j, d2, _ = nearest(at, home_pid, ask, pid, most.copy(), k)
        else:
            row, j, d2 = np.zeros(0, np.int64), q.column("i").to_numpy()[:0], np.zeros(0)
        return pa.table([*(q.column(c) for c in [*keys, "slab", "i"]), _lists(row, q.num_rows, j), _lists(row, q.num_rows, d2)], names=names)

    more = asking.groupBy(*keys, "to").cogroup(home.groupBy(*keys, "to")).applyInArrow(second, f"{kinds}, slab int, i {kind}, js array<{kind}>, d2s array<double>")
    both = open_.select(*out).unionByName(more.where("size(js) > 0"))
    both = both.groupBy(*keys, "slab", "i").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d2s", "js")))), 1, k).alias("__b"))
    return found.where("size(to) = 0").select(*out).unionByName(both.select(*keys, "slab", "i", F.col("__b.js").alias("js"), F.col("__b.d2s").alias("d2s")))
