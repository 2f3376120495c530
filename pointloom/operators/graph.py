"""Neighbour graphs by sorts and equi-joins: curve voting, grid nearest neighbours, voxel adjacency, region graphs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.curves import ORDERS, coded, with_cells, with_code
from pointloom.operators.nearest import packed_knn
from pointloom.operators.voting import voted
from pointloom.plans.storage import stored


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of (i, j) pairs."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), *rest))


def top_k(edges: DataFrame, k: int, order: Sequence, keys: Sequence[str] = ("scene",), source: str = "i") -> DataFrame:
    """The first k edges of each source; Catalyst limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys, source).orderBy(*order))
    return edges.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def curve_codes(points: DataFrame, voxel: float, shift: float, order: str, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, pid, x, y, z, code) of one curve."""
    return with_code(with_cells(points.select(*keys, "pid", "x", "y", "z"), voxel, shift, keys), order, "code").select(*keys, "pid", "x", "y", "z", "code")


def _runs(batch: pa.RecordBatch | pa.Table, n: int) -> np.ndarray:
    """First rows of the runs of one scene and curve, which are the first n columns."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for column in batch.columns[:n]:
        new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False) if batch.num_rows > 1 else False
    return np.flatnonzero(new)


def curve_pairs(points: DataFrame, voxel: float, window: int, keys: Sequence[str] = ("scene",), shifts: Sequence[float] = (0.0, 0.5), slab_rows: int = 1_000_000, max_dist: float | None = None) -> DataFrame:
    """Points that follow each other within `window` places on one of eight curves: (keys, curve, i, j, d2).

    All codes come from one pass. Rows are dealt by ranges of (scene, curve, code, point) into slabs of about
    `slab_rows`, so neither a scene nor a curve is one task, and each slab walks its sorted rows. Pairs across slabs
    come from the `window` rows at either end of each slab alone. `max_dist` drops farther pairs where they are made.
    """
    slabs = max(1, -(-points.count() * len(ORDERS) * len(shifts) // slab_rows))
    place, n = [*keys, "curve"], len(keys) + 1
    rows = coded(points, voxel, shifts, ORDERS, keys)
    order = [*place, "code", "pid"]
    rows = stored((rows.repartitionByRange(slabs, *order) if slabs > 1 else rows.coalesce(1)).sortWithinPartitions(*order))
    most = float("inf") if max_dist is None else max_dist**2
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in place)
    kind = rows.schema["pid"].dataType.simpleString()

    def near(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def within(batches):
        held = None
        for batch in batches:
            both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            old = both.num_rows - batch.num_rows
            run = np.zeros(both.num_rows, np.int64)
            run[_runs(both, n)] = 1
            run = np.cumsum(run)
            pid, at = both.column("pid").to_numpy(), [both.column(c).to_numpy() for c in "xyz"]
            first, i_out, j_out, d_out = [], [], [], []
            for s in range(1, window + 1):
                a = np.arange(max(0, old - s), both.num_rows - s)
                a = a[run[a] == run[a + s]]
                d2 = near([v[a] for v in at], [v[a + s] for v in at])
                a, d2 = a[d2 <= most], d2[d2 <= most]
                first.append(a)
                i_out.append(np.minimum(pid[a], pid[a + s]))
                j_out.append(np.maximum(pid[a], pid[a + s]))
                d_out.append(d2)
            own = both.select(place).take(pa.array(np.concatenate(first))).combine_chunks()
            columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in own.columns]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.concatenate(v)) for v in (i_out, j_out, d_out))], names=[*place, "i", "j", "d2"])
            held = both.slice(max(0, both.num_rows - window))

    found = rows.mapInArrow(within, f"{kinds}, i {kind}, j {kind}, d2 double")
    if slabs == 1:
        return found

    def ends(batches):
        """Rows at the ends of this slab's first and last run: (place, slab, size of the run, number within it, point)."""
        from pyspark import TaskContext

        slab = TaskContext.get().partitionId()
        head = tail = None
        size, first = 0, True

        def out():
            at = np.concatenate([np.arange(min(size, window)), np.arange(max(window, size - window), size)])
            kept = pa.concat_tables([head, tail.slice(tail.num_rows - max(0, len(at) - head.num_rows))])
            fixed = [pa.array(np.full(len(at), v)) for v in (slab, size)]
            whole = kept.combine_chunks()
            return pa.RecordBatch.from_arrays([*(c.chunk(0) for c in whole.columns[:n]), *fixed, pa.array(at), *(c.chunk(0) for c in whole.columns[n + 1 :])], names=[*place, "slab", "size", "at", "pid", "x", "y", "z"])

        for batch in batches:
            batch = pa.Table.from_batches([batch])
            if not batch.num_rows:
                continue
            cut = _runs(batch, n)
            if head is not None and all(head.column(c)[0].as_py() == batch.column(c)[0].as_py() for c in place):
                cut = cut[1:]
            for a, b in zip([0, *cut[cut > 0].tolist()], [*cut[cut > 0].tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if head is None or a in cut:
                    if head is not None and first:
                        yield out()
                        first = False
                    head, tail, size = part.slice(0, 0), part.slice(0, 0), 0
                take = max(0, window - head.num_rows)
                head = pa.concat_tables([head, part.slice(0, take)])
                tail = pa.concat_tables([tail, part.slice(take)])
                tail = tail.slice(max(0, tail.num_rows - window))
                size += part.num_rows
        if head is not None:
            yield out()

    edge = stored(rows.mapInArrow(ends, f"{kinds}, slab long, size long, at long, pid {kind}, x double, y double, z double"))
    sizes = edge.select(*place, "slab", "size").distinct()
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*place).orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = edge.join(sizes.select(*place, "slab", before.alias("before")), [*place, "slab"]).withColumn("rank", F.col("before") + F.col("at"))
    w = Window.partitionBy(*place).orderBy("rank")
    ahead = [F.struct(*[F.lead(v, s).over(w).alias(v) for v in ("slab", "rank", "pid", "x", "y", "z")]) for s in range(1, window + 1)]
    met = ranked.withColumn("next", F.array(*ahead)).withColumn("o", F.explode("next")).where(f"o.slab <> slab and o.rank <= rank + {window}")
    d2 = sum((F.col(c) - F.col(f"o.{c}")) ** 2 for c in "xyz")
    across = met.select(*place, F.least("pid", "o.pid").alias("i"), F.greatest("pid", "o.pid").alias("j"), d2.alias("d2")).where(F.col("d2") <= most)
    return found.unionByName(across)


def curve_votes(points: DataFrame, voxel: float, window: int, min_votes: int, max_dist: float, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Pairs with enough votes that lie close: (keys, i, j, votes, d2)."""
    return voted(points, voxel, 0, window, min_votes, max_dist, keys).where("i < j")


def curve_knn(points: DataFrame, voxel: float, k: int = 8, window: int = 8, min_votes: int = 4, max_dist: float = 0.3, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Directed neighbour graph: of each point the k partners with most votes, nearer ones and lower ids first."""
    return voted(points, voxel, k, window, min_votes, max_dist, keys)


def grid_knn(points: DataFrame, k: int, radius: float, keys: Sequence[str] = ("scene",), asked: DataFrame | None = None) -> DataFrame:
    """Up to k nearest others within a radius of points (or those of `asked`): (keys, i, j, d2)."""
    found = packed_knn(points, k, radius, keys, asked).select(*keys, "i", F.explode(F.arrays_zip("js", "d2s")).alias("__e"))
    return found.select(*keys, "i", F.col("__e.js").alias("j"), F.col("__e.d2s").alias("d2"))


def exact_knn(points: DataFrame, k: int, radius: float, keys: Sequence[str] = ("scene",), rounds: int = 64) -> DataFrame:
    """k nearest others of every point: the radius doubles for the points that have fewer than k within it.

    Each round is stored, so none is computed twice; raises where `rounds` doublings do not reach k neighbours.
    """
    points = stored(points.select(*keys, "pid", "x", "y", "z"))
    size = points.groupBy(*keys).count().select(*keys, F.least(F.col("count") - 1, F.lit(k)).alias("__want"))
    done, open_ = [], points
    for _ in range(rounds):
        found = stored(grid_knn(points, k, radius, keys, open_))
        counts = open_.select(*keys, F.col("pid").alias("i")).join(found.groupBy(*keys, "i").count(), [*keys, "i"], "left").join(size, list(keys))
        short = stored(counts.where(F.coalesce("count", F.lit(0)) < F.col("__want")).select(*keys, F.col("i").alias("pid")))
        if short.isEmpty():
            return reduce(DataFrame.unionByName, [*done, found])
        done.append(found.join(short.withColumnRenamed("pid", "i"), [*keys, "i"], "left_anti"))
        open_ = points.join(short, [*keys, "pid"], "left_semi")
        radius *= 2
    raise RuntimeError(f"points without {k} neighbours after {rounds} doublings")


def voxel_adjacency(voxels: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """26-neighbourhood of occupied cells: (keys, cx, cy, cz, ox, oy, oz)."""
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    own = voxels.select(*keys, "cx", "cy", "cz")
    asked = own
    for c in "xyz":
        asked = asked.withColumn("__s", F.explode(step)).withColumn(f"o{c}", F.col(f"c{c}") + F.col("__s")).drop("__s")
    other = own.select(*keys, *[F.col(f"c{c}").alias(f"o{c}") for c in "xyz"])
    return asked.where("not (ox = cx and oy = cy and oz = cz)").join(other, [*keys, "ox", "oy", "oz"])


def boundary(edges: DataFrame, points: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Directed region pairs that edges straddle: (keys, m, n, cnt, bsum), bsum the summed agreement of normals."""
    one = lambda end, out: points.select(*keys, F.col("pid").alias(end), F.col("seg").alias(out), *[F.col(f"n{c}").alias(f"{out}{c}") for c in "xyz"])
    both = edges.select(*keys, "i", "j").join(one("i", "m"), [*keys, "i"]).join(one("j", "n"), [*keys, "j"]).where("m <> n")
    agree = F.abs(F.col("mx") * F.col("nx") + F.col("my") * F.col("ny") + F.col("mz") * F.col("nz"))
    return both.groupBy(*keys, "m", "n").agg(F.count("*").alias("cnt"), F.sum(agree).alias("bsum"))


def degree_cap(region_edges: DataFrame, k: int = 12, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """The k neighbours with most contacts of every region."""
    return top_k(region_edges, k, [F.desc("cnt"), "n"], keys, "m")
