"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A table turns every vector `k` times (random signs and a Hadamard transform, three rounds) and takes the signed axis
that it lies closest to; the `k` axes name its bucket. A vector also stands in the buckets where one of its axes gives
way to the second closest, cheapest changes first (multiprobe). The number of tables follows from k, so that pairs right
at the threshold are found as often at any size (`tables_for`), and k from the number of vectors: the one that sends the
fewest bytes (`plan`), as more axes cost more tables but bring fewer vectors together that are not alike.

Only names of buckets and vectors are shuffled at first. Buckets of one vector fall away, and of buckets that hold the
same vectors one stays. Vectors then go to the buckets that are left, and all pairs there are compared in double
precision; nothing below the threshold links. A pair that meets in several buckets counts in the first of them only,
which the names that every vector carries tell.

Equal vectors are one row with a count before anything is compared. Buckets have a bounded size: a larger one is cut
into blocks of `BLOCK` vectors and each pair of blocks is compared in a task of its own, without listing pairs: a block
returns the number of links of each vector and one link to the smallest vector of its group, for the components.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: one row, no links. Vectors
of different lengths never link. Repeated vec_ids count as vectors of their own. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import Scratch, arrow_map, components, mix, roots, spread_join, table

TABLES, PROBES, BLOCK, SMALL = 6, 3, 8192, 48
RECALL = 0.997  # of pairs right at the threshold; about what 6 tables find with k = 2 in 64 dimensions
DENSE = 512  # dimensions up to which a rotation is applied as one matrix


def turn(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform, over rows of a power of two."""
    n, d = x.shape
    for i in range(3):
        sign = np.random.default_rng([seed, i, d]).integers(0, 2, d) * 2.0 - 1
        x = x * sign
        step = 1
        while step < d:
            x = x.reshape(n, -1, 2, step)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
            step *= 2
        x = x / math.sqrt(d)
    return x


@lru_cache(maxsize=512)
def rotation(wide: int, seed: int) -> np.ndarray:
    """The matrix of `turn`, which is what a vector is multiplied with where it is narrow."""
    return turn(np.eye(wide), seed)


def buckets(x: np.ndarray, k: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(vectors, tables, probes) names of the buckets of unit vectors; the first probe is the home bucket."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - d)))
    out = np.zeros((n, tables, probes), np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        first, second, loss = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k))
        for j in range(k):
            y = x @ rotation(wide, 1000 * t + j) if wide <= DENSE else turn(x, 1000 * t + j)
            size = np.abs(y)
            a = size.argmax(1)
            top = size[rows, a]
            size[rows, a] = -1
            b = size.argmax(1)
            first[:, j] = 2 * a + (y[rows, a] < 0)
            second[:, j] = 2 * b + (y[rows, b] < 0)
            loss[:, j] = top - size[rows, b]
        order = loss.argsort(1, kind="stable")
        for p in range(probes):
            axes = first
            if 0 < p <= k:
                axes = first.copy()
                axes[rows, order[:, p - 1]] = second[rows, order[:, p - 1]]
            elif p > k:
                axes = second
            name = np.full(n, t + 1, np.uint64)
            for j in range(k):
                name = mix(name * np.uint64(0x9E3779B97F4A7C15) + axes[:, j].astype(np.uint64))
            out[:, t, p] = name
    return out


@lru_cache(maxsize=64)
def tables_for(k: int, wide: int, at_least: float, tables: int = TABLES, probes: int = PROBES) -> int:
    """Tables, `tables` or more, of which one at least holds a pair at the threshold with probability RECALL; tried on random pairs."""
    rng, met, tried = np.random.default_rng([k, wide]), 0, 0
    while tried < 8000 or met < 400 and tried < 256_000:  # pairs that rarely meet are tried more often
        x, y = rng.normal(size=(2, 250, wide))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(1, keepdims=True) * x
        y = at_least * x + math.sqrt(max(0.0, 1 - at_least**2)) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        a, b = buckets(x, k, 4, probes), buckets(y, k, 4, probes)
        met += int((a[:, :, :, None] == b[:, :, None, :]).any((2, 3)).sum())
        tried += 4 * len(x)
    apart = 1 - max(met, 1) / tried
    return max(tables, math.ceil(math.log(1 - RECALL) / math.log(apart))) if apart > 0 else tables


def plan(n: int, dimensions: list[int], at_least: float, tables: int = TABLES, probes: int = PROBES) -> tuple[int, int]:
    """(k, tables) that cost least for n vectors: bytes of bucket names, bytes of vectors sent to buckets that random vectors
    share (once a block), and comparisons there, one of which takes about as long as a byte."""
    widths = sorted({1 << max(1, (d - 1).bit_length()) for d in dimensions}) or [2]
    best = None
    for k in range(1, 9):
        placed = probes * (t := max(tables_for(k, w, at_least, tables, probes) for w in widths))
        met = n * probes / (2.0 * widths[0]) ** k
        shared = 1 - math.exp(-met)
        cost = placed * (48 + shared * max(1.0, met / BLOCK) * (8 * widths[-1] + 8 * placed * shared + 24) + met)
        if best is None or cost < best[0]:
            best = cost, k, t
        if placed * 48 > best[0]:
            break
    return best[1:]


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, in double precision, and which rows can be scaled."""
    x = x.astype(np.float64)
    x = np.where(x == 0, 0.0, x)  # no negative zero
    ok = np.isfinite(x).all(1)
    top = np.where(ok, np.abs(np.where(ok[:, None], x, 0.0)).max(1), 0.0)
    ok &= top > 0
    x = np.where(ok[:, None], x, 0.0) / np.where(ok, top, 1.0)[:, None]
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1.0)[:, None], ok


def by_length(column: pa.Array, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) of an array column, a length at a time; null components are not finite."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = column.offsets.to_numpy().astype(np.int64)[:-1]
    values = column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        for lo in range(0, len(rows), 2048):
            own = rows[lo : lo + 2048]
            yield own, values[first[own][:, None] + np.arange(d)]


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of equal length from a binary column."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def first_met(names: np.ndarray, u: np.ndarray, v: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether bucket `name` is the first that both rows of a pair stand in; names rise, and end in the highest number."""
    ok, live = np.ones(len(u), bool), np.arange(len(u))
    for p in range(names.shape[1]):
        own = names[u[live], p]
        before = own < name[live]
        live, own = live[before], own[before]
        if not len(live):
            break
        met = (names[v[live]] == own[:, None]).any(1)
        ok[live[met]] = False
        live = live[~met]
    return ok


def linked(x: np.ndarray, left: np.ndarray, right: np.ndarray, at_least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows at or over the threshold, a bounded number at a time: of two blocks, or of one with itself."""
    same = left is right
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        near = x[rows] @ x[right].T >= at_least
        if same:
            near &= np.arange(lo, lo + len(rows))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(near)
        for s in range(0, len(i), 1 << 16):
            yield rows[i[s : s + (1 << 16)]], right[j[s : s + (1 << 16)]]


def linked_small(x: np.ndarray, segment: np.ndarray, widest: int, at_least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many small buckets at once; rows of one bucket stand in a row."""
    for step in range(1, widest):
        i = np.flatnonzero(segment[:-step] == segment[step:])
        for s in range(0, len(i), 1 << 14):
            u = i[s : s + (1 << 14)]
            near = np.einsum("ij,ij->i", x[u], x[u + step]) >= at_least
            if near.any():
                yield u[near], u[near] + step


def near_vectors(vectors: DataFrame, at_least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, k: int | None = None) -> DataFrame:
    """Rows (vec_id, n_links, component_id), one per input row. `tables` is the least number of tables; `k` is chosen where not given."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    element = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    kind, sql_kind = (np.float32, "float") if isinstance(element, T.FloatType) else (np.float64, "double")

    def read(batch):
        digest, raw = [None] * batch.num_rows, [None] * batch.num_rows
        for rows, x in by_length(batch.column(1), kind):
            unit, ok = units(x)
            for i, a, b, good in zip(rows.tolist(), x, unit, ok.tolist(), strict=True):
                if good:
                    digest[i], raw[i] = xxhash.xxh3_128_digest(b.tobytes()), a.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["id", "digest", "raw"])

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{sql_kind}>").alias("v"))
    every = scratch.table(arrow_map(source, read, "id long, digest binary, raw binary"), "units")
    # a class is what has one unit vector; classes have numbers of their own, as an id may repeat with different vectors
    classes = every.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("raw").alias("raw"))
    classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    bounds = classes.agg(F.min(F.length("raw")), F.max(F.length("raw"))).first()
    dimensions = [x // kind().itemsize for x in bounds if x is not None]
    k, tables = plan(n, dimensions, at_least, tables, probes) if k is None else (k, max(tables_for(k, 1 << max(1, (d - 1).bit_length()), at_least, tables, probes) for d in dimensions or [2]))

    def place(batch):
        """A row for each vector and bucket."""
        length = pc.binary_length(batch.column(1)).to_numpy()
        for size in np.unique(length):
            own = batch.take(pa.array(np.flatnonzero(length == size)))
            for lo in range(0, own.num_rows, 2048):
                part = own.slice(lo, 2048)
                names = buckets(units(matrix(part.column(1), kind))[0], k, tables, probes)
                names = np.sort(mix(names + np.uint64(size)).reshape(part.num_rows, -1).view(np.int64), axis=1)
                new = np.ones(names.shape, bool)
                new[:, 1:] = names[:, 1:] != names[:, :-1]
                node = np.repeat(part.column(0).to_numpy(), new.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(names[new]), pa.array(node)], names=["bucket", "node"])

    placed = scratch.table(arrow_map(classes.select("node", "raw"), place, "bucket long, node long"), "placed")
    # single vectors of a bucket have no partner; of buckets that hold the same vectors, one is enough
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"same{i}") for i in range(2)])
    shared = shared.where("n > 1").groupBy("n", "lo", "hi", "same0", "same1").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    shared = scratch.table(shared, "shared")
    rows = shared.agg(F.coalesce(F.sum(F.col("n") * F.ceil(F.col("n") / block)), F.lit(0))).first()[0]
    groups = max(64, int(rows) // 16_384)  # each of many buckets
    members = spread_join(placed, shared.select("bucket", "n", F.col("n").alias("__n")), "bucket", "__n", n * tables * probes)
    stands = members.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("at"))
    met = classes.select("node", "copies", "raw").join(stands, "node").select("node", "copies", "raw", F.col("at.bucket").alias("names"), F.explode("at").alias("e"))
    # blocks of large buckets meet pairwise
    met = met.withColumn("blocks", F.ceil(F.col("e.n") / block).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.col("e.bucket").alias("bucket"), F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node", "copies", "raw", "names")
    met = met.withColumn("group", F.pmod(F.xxhash64("bucket", "x", "y"), F.lit(groups)))

    def meet(group: pa.Table) -> pa.Table:
        length = pc.binary_length(group.column("raw"))
        group = group.append_column("length", length).sort_by([("length", "ascending"), ("bucket", "ascending"), ("x", "ascending"), ("y", "ascending")])
        parts = [of_length(group.filter(pc.equal(group.column("length"), size))) for size in pc.unique(length).to_pylist()]
        return pa.concat_tables(parts)

    def of_length(group: pa.Table) -> pa.Table:
        ids, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        x = units(matrix(group.column("raw"), kind))[0]
        many = pc.list_value_length(group.column("names")).to_numpy()
        names = np.full((len(ids), int(many.max())), 2**63 - 1, np.int64)
        names[np.arange(names.shape[1]) < many[:, None]] = pc.list_flatten(group.column("names")).to_numpy()
        bucket, a, b, mine = (group.column(c).to_numpy() for c in ("bucket", "x", "y", "mine"))
        new = np.ones(len(ids), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        cut = np.append(np.flatnonzero(new), len(ids))
        size = np.diff(cut)
        small = np.repeat((size <= SMALL) & (a[cut[:-1]] == b[cut[:-1]]), size)
        pick = np.flatnonzero(small)

        def pairs():
            segment = (np.cumsum(new) - 1)[pick]
            if len(pick):
                for u, v in linked_small(x[pick], segment, int(size[size <= SMALL].max()), at_least):
                    yield pick[u], pick[v]
            for i in np.flatnonzero((size > SMALL) | (a[cut[:-1]] != b[cut[:-1]])).tolist():
                rows = np.arange(cut[i], cut[i + 1])
                left = rows[mine[rows] == a[rows]]
                yield from linked(x, left, left if a[rows[0]] == b[rows[0]] else rows[mine[rows] == b[rows]], at_least)

        found, a_out, b_out = np.zeros(len(ids), np.int64), [], []
        for u, v in pairs():
            ok = first_met(names, u, v, bucket[u])
            u, v = u[ok], v[ok]
            np.add.at(found, u, copies[v])
            np.add.at(found, v, copies[u])
            m, r = roots(ids[u], ids[v])
            a_out.append(m)
            b_out.append(r)
        m, r = roots(np.concatenate(a_out), np.concatenate(b_out)) if a_out else (np.zeros(0, np.int64),) * 2
        on = np.flatnonzero(found)
        return pa.table({"a": np.concatenate([ids[on], m]), "b": np.concatenate([ids[on], r]), "n": np.concatenate([found[on], np.zeros(len(m), np.int64)])})

    links = scratch.table(met.groupBy("group").applyInArrow(meet, "a long, b long, n long"), "links")
    star = components(links.where("a <> b").select("a", "b"), scratch)
    counts = links.where("a = b").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    named = classes.select("node", "digest", "rep", "copies").join(star, "node", "left").join(counts, "node", "left")
    named = named.selectExpr("digest", "rep", "copies", "coalesce(root, node) root", "copies - 1 + coalesce(n, 0) n_links")
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("many"))
    known = scratch.table(spread_join(named, lowest, "root", "many", n).select("digest", "copies", "n_links", "component_id"), "known")
    ids = every.select("id", "digest")
    out = spread_join(ids.where("digest is not null"), known, "digest", "copies", int(total)).unionByName(ids.where("digest is null"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"), 0.9)
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
