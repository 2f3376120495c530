"""SimHash near-duplicates: segment bit counts as an embedding, grid range join under Manhattan distance, exact check.

A 64-bit fingerprint is cut into 16 segments of 4 bits and mapped to its 16 bit counts. Differing bits are at least
the Manhattan distance of two count vectors, so all fingerprints within 2 bits lie in grid cells at Manhattan distance
0, 1 or 2. Each distinct fingerprint stands in its own cell and asks one of every two opposite neighbour cells
(273 cells), so each link is found from one side; a found pair is verified by its differing bits.

Cells are dealt to buckets as packed arrays (a few rows for many keys), each bucket is joined by binary search, and its
size is bounded by the number of buckets, which grows with the number of distinct fingerprints. Copies meet before that:
equal fingerprints are one row. A fingerprint has at most 2080 others within 2 bits, so links stay linear in rows.

Null and empty texts have no words: their fingerprint is zero, linked like any other. Repeated rows keep one row each.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import Parts, Scratch, arrow_map, components, flat, mix, spread_join, table

SEED = 42
SEGMENTS = 16
PER_BUCKET = 400_000  # probe keys that one bucket gets on average


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of `width` words, repeats included; of the whole sequence if it has fewer words."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), runs), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes; as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65_280):
        part = hashes[lo : lo + 65_280]
        full = np.zeros((-(-len(part) // 255) * 255, 8), np.uint8)
        full[: len(part)] = part.view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(full, axis=1, bitorder="little").reshape(-1, 255, 64)
        counts += bits.sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows (id, fp long), one per input row."""

    def of(batch):
        data, offsets = flat(batch.column(1))
        raw = data.tobytes()
        found = [fingerprint(shingle_hashes(raw[a:b], words)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), of, "id long, fp long")


def bit_counts(fp: np.ndarray) -> np.ndarray:
    """The 16 segment counts of each fingerprint, 4 bits apiece in one number."""
    x = fp.astype(np.uint64)
    x = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))


def neighbour_steps(radius: int) -> np.ndarray:
    """Differences of packed counts to the cells at Manhattan distance `radius` at most, one of each two opposite ones."""
    frontier = {tuple([0] * SEGMENTS)}
    every = set(frontier)
    for _ in range(radius):
        frontier = {s[:i] + (s[i] + d,) + s[i + 1 :] for s in frontier for i in range(SEGMENTS) for d in (1, -1)}
        every |= frontier
    half = [s for s in every if sum(map(abs, s)) <= radius and s >= tuple([0] * SEGMENTS)]
    return np.array([sum(v << (4 * i) for i, v in enumerate(s)) & (2**64 - 1) for s in sorted(half)], np.uint64)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def fingerprint_links(distinct: DataFrame, radius: int = 2, n: int | None = None) -> DataFrame:
    """Links (a, b) between the fingerprints of column fp (distinct values) that differ in 1 to `radius` bits."""
    steps = neighbour_steps(radius)
    n = distinct.count() if n is None else n
    buckets = max(64, -(-n * len(steps) // PER_BUCKET))

    def deal(batches):
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(every), 4000):
                fp = every[lo : lo + 4000]
                home = bit_counts(fp)
                for kind, key, own in ((0, mix(home), fp), (1, mix((home[:, None] + steps[None, :]).ravel()), np.repeat(fp, len(steps)))):
                    at = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                    order = np.argsort(at, kind="stable")
                    at, key, own = at[order], key[order].astype(np.uint32), own[order]
                    cut = np.flatnonzero(np.diff(at, prepend=-1))
                    ends = np.append(cut[1:], len(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at[cut]), pa.array(np.full(len(cut), kind, np.int32)), pa.array([key[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([own[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
                        names=["bucket", "kind", "key", "fp"],
                    )

    def meet(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        keys, fps = group.column("key").to_pylist(), group.column("fp").to_pylist()
        of = lambda x, t, k: np.frombuffer(b"".join(v for v, at in zip(x, kind, strict=True) if at == k), t)
        cell, home = of(keys, np.uint32, 0), of(fps, np.uint64, 0)
        order = np.argsort(cell, kind="stable")
        cell, home = cell[order], home[order]
        ask, own = of(keys, np.uint32, 1), of(fps, np.uint64, 1)
        a_out, b_out = [], []
        for lo in range(0, len(ask), 1 << 20):
            k, o = ask[lo : lo + (1 << 20)], own[lo : lo + (1 << 20)]
            first, last = np.searchsorted(cell, k, "left"), np.searchsorted(cell, k, "right")
            many = last - first
            hit = np.flatnonzero(many)
            step = 0
            while len(hit):  # the step-th fingerprint of each cell that was asked
                x, y = o[hit], home[first[hit] + step]
                near = (x != y) & (popcount(x ^ y) <= radius)
                a_out.append(x[near])
                b_out.append(y[near])
                step += 1
                hit = hit[many[hit] > step]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a_out, b_out))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "bucket int, kind int, key binary, fp binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """Rows (doc_id, fp, component_id): component_id is the smallest id reachable over links of at most `radius` bits."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.table(fingerprints(docs, id_col, text_col, words), "fps")
    distinct = scratch.table(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "distinct")
    links = scratch.table(fingerprint_links(distinct.select("fp"), radius), "links")
    star = components(links, scratch)
    # the component of a fingerprint is named by its smallest member fingerprint; its smallest id follows from that
    named = distinct.join(star.withColumnRenamed("node", "fp"), "fp", "left").selectExpr("fp", "first", "copies", "coalesce(root, fp) root")
    total, n = (int(x or 0) for x in distinct.agg(F.sum("copies"), F.count("*")).first())
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("many"))
    known = scratch.table(spread_join(named, lowest, "root", "many", n).select("fp", "copies", "component_id"), "known")
    scratch.keep("fps", "known")
    return spread_join(fps, known, "fp", "copies", total).select(F.col("id").alias(id_col), "fp", "component_id")


HASHES, BANDS = 256, 32
CROWD, CROWD_BYTES = 512, 8 << 20  # classes and bytes of sets that a block holds on average
_FACTORS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64)).astype(np.uint32)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """32 keys of 8 minima each, of 256 hash functions of the shingles; none for a text without words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    short = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for lo in range(0, len(short), 1024):
        low = np.minimum(low, (short[lo : lo + 1024, None] * (_FACTORS[:HASHES] | np.uint32(1)) + _FACTORS[HASHES:]).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, -1).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def jaccard(a: bytes | pa.Buffer, b: bytes | pa.Buffer) -> float:
    """Of two sets of 64-bit hashes, ordered; two empty sets are equal."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def joined_sets(data: np.ndarray, sizes: np.ndarray, labels: np.ndarray, side: np.ndarray | None, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that join the components of Jaccard similarity `at_least` among sets that stand one after another.

    Rows of one label are joined already. Every other pair is compared, or only those of different sides, unless links
    found before have joined its rows. Rows just linked are compared next, so that a group ends once its centre is met.
    """
    order = np.argsort(sizes, kind="stable")
    starts = np.cumsum(sizes) - sizes
    _, code = np.unique(data, return_inverse=True)
    code = np.concatenate([code[starts[i] : starts[i] + sizes[i]] for i in order.tolist()]) if len(data) else np.zeros(0, np.int64)
    sizes = sizes[order]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    label = np.unique(labels[order], return_inverse=True)[1]
    side = None if side is None else side[order]
    done, flag = np.zeros(len(order), bool), np.zeros(int(code.max(initial=-1)) + 1, np.int32)
    a_out, b_out = [], []
    for start in range(len(order)):
        stack = [start]
        while stack:
            q = stack.pop()
            if done[q]:
                continue
            done[q] = True
            lo = int(np.searchsorted(sizes, sizes[q] * at_least - 1, "left"))
            hi = int(np.searchsorted(sizes, sizes[q] / max(at_least, 1e-9) + 1, "right"))
            open_ = ~done[lo:hi] & (label[lo:hi] != label[q])
            if side is not None:
                open_ &= side[lo:hi] != side[q]
            to = lo + np.flatnonzero(open_)
            if not len(to):
                continue
            own = code[ends[q] : ends[q + 1]]
            flag[own] = 1
            if len(to) <= 16:
                both = np.array([flag[code[ends[i] : ends[i + 1]]].sum() for i in to.tolist()])
            else:
                upto = np.concatenate([[0], np.cumsum(flag[code[ends[lo] : ends[hi]]])])
                both = upto[ends[to + 1] - ends[lo]] - upto[ends[to] - ends[lo]]
            flag[own] = 0
            either = sizes[to] + sizes[q] - both
            hit = to[np.where(either > 0, both / np.maximum(either, 1), 1.0) >= at_least]
            if len(hit):
                a_out.append(np.full(len(hit), order[q]))
                b_out.append(order[hit])
                label[np.isin(label, label[hit])] = label[q]
                stack.extend(hit.tolist())
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_out, b_out))


def crowd_links(members: DataFrame, held: DataFrame, at_least: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join what is alike in each group of members (key, node, root), given their sets (node, set).

    A large group is cut into blocks and each pair of blocks is compared in a task of its own.
    """
    sized = scratch.table(members.join(held.select("node", F.octet_length("set").alias("bytes")), "node"), "crowd")
    cuts = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    cuts = cuts.select("key", F.greatest(F.ceil(F.col("n") / CROWD), F.ceil(F.col("bytes") / CROWD_BYTES)).cast("int").alias("blocks"))
    met = sized.join(cuts, "key").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node", "root", "bytes")
    met = scratch.table(met, "blocks")
    total = met.selectExpr("coalesce(sum(bytes), 0) n").first()["n"]
    groups = max(64, total // CROWD_BYTES)  # each of many small bands
    met = met.drop("bytes").join(held, "node").withColumn("group", F.pmod(F.xxhash64("key", "x", "y"), F.lit(groups)))

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("x", "ascending"), ("y", "ascending")])
        key, x, y, mine, node, root = (group.column(c).to_numpy() for c in ("key", "x", "y", "mine", "node", "root"))
        sizes = pc.binary_length(group.column("set")).to_numpy() // 8
        raw = group.column("set").combine_chunks()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        cut = np.append(np.flatnonzero(new), len(key))
        a_out, b_out = [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if len(np.unique(root[lo:hi])) == 1:
                continue
            data, _ = flat(raw.slice(lo, hi - lo))
            side = None if x[lo] == y[lo] else mine[lo:hi] == x[lo]
            a, b = joined_sets(np.frombuffer(data.tobytes(), np.uint64), sizes[lo:hi].astype(np.int64), root[lo:hi], side, at_least)
            a_out.append(node[lo + a])
            b_out.append(node[lo + b])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a_out, b_out))
        return pa.table({"a": a, "b": b})

    return met.groupBy("group").applyInArrow(meet, "a long, b long")


def drop_near_duplicates(docs: DataFrame, words: int = 5, at_least: float = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group linked by Jaccard similarity `at_least` of their sets
    of shingles, the row with the smallest id stays.

    Equal texts meet first, as one class. Candidates are classes whose fingerprints differ by `radius` bits at most (the
    grid join above) and, since fingerprints of texts of similarity 0.8 may differ by sixteen bits, where bit counts no
    longer part anything, classes that share a band of eight minima of their shingles (0.997 of all pairs at 0.8 share
    one of 32). All candidates are compared on whole sets of shingles, in two steps: a class first meets the smallest
    and the largest of every band it stands in and the smallest of its fingerprint and of near ones. Where a band, a
    fingerprint or two near ones then still hold classes of several groups, all their other pairs are compared in blocks
    until links join them, so the result does not depend on the order of rows. Null and empty texts are one class.
    Texts pass no shuffle; see Parts.
    """
    scratch = Scratch(docs.sparkSession, "simhash-texts")
    parts = Parts(scratch, docs)
    columns = [id_col, text_col]

    def prints(part, batch, rid):
        data, offsets = flat(batch.column(1))
        raw = data.tobytes()
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            hashes = shingle_hashes(raw[a:b], words)
            out.append((xxhash.xxh3_128_digest(raw[a:b]), fingerprint(hashes), band_keys(hashes)))
        digest, fp, keys = zip(*out, strict=True)
        ids = pc.fill_null(pc.cast(batch.column(0), pa.int64()), 2**63 - 1)  # rows without id come last
        yield pa.RecordBatch.from_arrays([pa.array(rid), ids, pa.array(digest, pa.binary()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["rid", "id", "digest", "fp", "keys"])

    rows = scratch.table(parts.map(prints, "rid long, id long, digest binary, fp long, keys array<long>", columns), "prints")
    classes = scratch.table(rows.groupBy("digest").agg(F.min(F.struct("id", "rid")).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("copies")).select("digest", F.col("first.rid").alias("node"), "fp", "keys", "copies"), "classes")
    banded = classes.select("node", F.explode("keys").alias("key"))
    bands = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"same{i}") for i in range(2)])
    # of bands that hold the same classes, one
    bands = bands.where("n > 1").groupBy("n", "low", "high", "same0", "same1").agg(F.min("key").alias("key"))
    bands = scratch.table(bands.select("key", "n", "low", "high"), "bands")
    members = scratch.table(banded.join(bands.where("n > 2"), "key").select("key", "node", "low", "high"), "members")
    met = members.select("node", F.explode(F.array("low", "high")).alias("other")).unionByName(bands.where("n = 2").selectExpr("low node", "high other"))
    by_fp = scratch.table(classes.groupBy("fp").agg(F.min("node").alias("low")), "by-fp")
    alike = classes.join(by_fp, "fp").selectExpr("node", "low other")
    near_fps = scratch.table(fingerprint_links(by_fp.select("fp"), radius), "near-fps")
    near = near_fps.join(by_fp.selectExpr("fp a", "low node"), "a").join(by_fp.selectExpr("fp b", "low other"), "b").select("node", "other")
    pairs = met.unionByName(alike).unionByName(near).selectExpr("least(node, other) a", "greatest(node, other) b").where("a < b").distinct()
    pairs = scratch.table(pairs, "pairs")
    wanted = parts.deliver(pairs.selectExpr("a rid").union(pairs.selectExpr("b rid")).distinct(), "wanted")

    def sets(part, batch, rid):
        on = np.flatnonzero(np.isin(rid, wanted(part), assume_unique=True))
        own = batch.take(pa.array(on))
        data, offsets = flat(own.column(1))
        raw = data.tobytes()
        found = [np.unique(shingle_hashes(raw[a:b], words)).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rid[on]), pa.array(found, pa.binary())], names=["node", "set"])

    held = scratch.table(parts.map(sets, "node long, set binary", columns), "sets")

    def verify(batch):
        ok = [jaccard(x.as_buffer(), y.as_buffer()) >= at_least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok))

    both = pairs.join(held.selectExpr("node a", "set x"), "a").join(held.selectExpr("node b", "set y"), "b").select("a", "b", "x", "y")
    links = scratch.table(arrow_map(both, verify, "a long, b long"), "links")
    star = scratch.table(components(links, scratch, "cc-first"), "star")

    # what is left: bands, fingerprints and pairs of near fingerprints that hold several groups and a pair not yet compared
    root = F.coalesce("root", "node").alias("root")
    rooted = members.join(star, "node", "left").select("key", "node", root)
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    of_fp = scratch.table(classes.select("node", "fp").join(star, "node", "left").select("fp", "node", root), "of-fp")
    spread = scratch.table(of_fp.groupBy("fp").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")), "spread")
    one = spread.where("n > 2 and lo < hi").selectExpr("xxhash64(fp) key", "fp")
    a, b = (spread.selectExpr(f"fp {x}", f"n n{x}", f"lo lo{x}", f"hi hi{x}") for x in "ab")
    two = near_fps.join(a, "a").join(b, "b").where("na + nb > 2 and least(loa, lob) < greatest(hia, hib)")
    two = two.selectExpr("xxhash64(a, b) key", "explode(array(a, b)) fp")
    rest = rooted.join(several, "key").unionByName(of_fp.join(one.unionByName(two), "fp").select("key", "node", "root")).distinct()
    more = scratch.table(crowd_links(rest, held, at_least, scratch), "more")
    star = components(star.selectExpr("node a", "root b").unionByName(more), scratch)
    roots_of = scratch.table(classes.select("digest", "node", "copies").join(star, "node", "left").select("digest", "copies", F.coalesce("root", "node").alias("root")), "roots")
    total = int(roots_of.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    grouped = spread_join(rows.select("rid", "id", "digest"), roots_of, "digest", "copies", total).select("rid", "id", "root")
    stay = grouped.groupBy("root").agg(F.min(F.struct("id", "rid")).alias("first")).select(F.col("first.rid").alias("rid"))
    kept = parts.deliver(stay, "kept")
    scratch.keep(parts.name, "kept")

    def keep(part, batch, rid):
        yield batch.filter(pa.array(np.isin(rid, kept(part), assume_unique=True)))

    return parts.map(keep, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
