"""Shared plumbing of the training-data operators: scratch tables, Arrow text access, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; a temporary one only where one JVM runs everything (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Written tables under the shared folder; they cut lineage and survive lost executors.

    Every table is deleted when the JVM ends; `drop` removes one earlier.
    """

    def __init__(self, spark: SparkSession, what: str):
        # whole texts come in Arrow batches: where the session has Spark's default, fewer rows a batch
        if spark.conf.get(ROWS_A_BATCH) == "10000":
            spark.conf.set(ROWS_A_BATCH, "2000")
        self.spark, self.base = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        path, fs = self._fs(self.base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path, fs = self._fs(self.path(name))
        fs.delete(path, True)


    def keep(self, *names: str) -> None:
        """Deletes all tables and files but these, once nothing reads the others any more."""
        path, fs = self._fs(self.base)
        for status in fs.listStatus(path):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)


def plain_scan(df: DataFrame) -> bool:
    """Whether a frame is columns of files and nothing else, so that each reading has the same partitions."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    heads = [re.sub(r"^[\s:+*-]*", "", line) for line in lines]
    return bool(heads) and all(h.startswith(("Project [", "Relation [")) for h in heads)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `budget` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


#: What operators keep in a worker between tasks, by name, with what empties it.
CACHES: dict[str, Callable[[], None]] = {}


def release(uses: str = "") -> None:
    """Gives memory back to the system, for the workers and the JVM that share an executor with this one.

    A worker that has gone on to another operator drops what the last one kept; `uses` names the cache still in use.
    """
    for name, clear in CACHES.items():
        if name != uses:
            clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, uses: str = "") -> DataFrame:
    """mapInArrow with a function of one batch; `uses` names a cache that outlives the task."""

    def over(batches):
        release(uses)
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
            del batch
            release(uses)

    return df.mapInArrow(over, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64 steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, smallest member) of the components of links a-b; members equal to their root are left out."""
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def _stars(batches):
    """Replaces the links of a partition, a bounded number at a time, by the stars of their components."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held, n = [], 0

    def contracted():
        m, r = roots(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(m), pa.array(r)], schema=kind)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > 1 << 20:
            yield contracted()
            held, n = [], 0
    if n:
        yield contracted()


HUBS, LEAST = 1000, 100_000


def spread_join(rows: DataFrame, known: DataFrame, key: str, weight: str, total: int, least: int = LEAST) -> DataFrame:
    """rows joined with `known`, which has a row a key and in column `weight` the number of rows that carry it.

    A key of over a HUBS-th of `total` rows (and over `least`, which one task takes easily) would gather them in one
    task. There are fewer than HUBS such keys, whatever the size of the input, so where there are any, their rows of
    `known` are broadcast and `rows` stay where they are.
    """
    bound = max(total // HUBS, least)
    if total <= bound or known.where(F.col(weight) > bound).isEmpty():
        return rows.join(known.drop(weight), key)
    heavy, light = known.where(F.col(weight) > bound).drop(weight), known.where(F.col(weight) <= bound).drop(weight)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def components(links: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 200, least: int = LEAST) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the smallest node; nodes equal to their root are left out.

    Alternates large-star and small-star steps (each contracts every neighbourhood onto its smallest node) until the
    set of links stays as it is; each round is a written table, and its partitions contract what they hold first.
    Memory is bounded by Spark's joins: nothing is collected, and the neighbourhoods of hubs are not gathered (see
    spread_join). Raises where `rounds` do not reach the end.
    """
    now = links.selectExpr("greatest(a, b) a", "least(a, b) b").where("a <> b").mapInArrow(_stars, "a long, b long").distinct()
    now = scratch.table(now, f"{name}-0")
    mark = ("count(*) n", "sum(cast(xxhash64(a, b) as decimal(38, 0))) h", "bit_xor(xxhash64(b, a)) x")
    seen = now.selectExpr(*mark).first()
    for i in range(1, rounds):
        if not seen["n"]:
            return now.selectExpr("a node", "b root")
        both = now.unionByName(now.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).selectExpr("a", "least(a, m) m", "n")
        large = spread_join(both.where("b > a"), low, "a", "n", seen["n"], least).selectExpr("b a", "m b").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = spread_join(large, low, "a", "n", seen["n"], least)
        small = joined.selectExpr("a", "m b").unionByName(joined.where("b <> m").selectExpr("b a", "m b")).distinct()
        now = scratch.table(small.mapInArrow(_stars, "a long, b long").distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        before, seen = seen, now.selectExpr(*mark).first()
        if before == seen:
            return now.selectExpr("a node", "b root")
    raise RuntimeError(f"links still change after {rounds} rounds")


class Parts:
    """A table in files whose partitions are read several times, and answers that come back to each of them.

    What is not a plain reading of files is written first.

    Texts then need no shuffle: what is found about rows elsewhere goes to a file for each partition in the shared
    folder, and the next pass over a partition reads its own. A row is named by partition and number within it.
    """

    def __init__(self, scratch: Scratch, df: DataFrame, name: str = "rows"):
        self.scratch, self.name = scratch, name
        self.df = df if plain_scan(df) else scratch.table(df, name)

    def map(self, fn: Callable[[int, pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str, columns: list[str] | None = None) -> DataFrame:
        """fn(partition, batch, row names) over the batches of each partition; row names rise by one from partition << 40."""

        def over(batches):
            from pyspark import TaskContext

            part, n = TaskContext.get().partitionId(), 0
            for batch in batches:
                yield from fn(part, batch, (part << 40) + n + np.arange(batch.num_rows))
                n += batch.num_rows
                del batch
                release()

        return (self.df.select(*columns) if columns else self.df).mapInArrow(over, schema)

    def deliver(self, rows: DataFrame, name: str) -> Callable[[int], np.ndarray]:
        """Sends row names (column rid) to their partitions; returns what reads those of a partition, in order."""
        base = self.scratch.path(name)

        def save(group: pa.Table) -> pa.Table:
            part = group.column("part")[0].as_py()
            fs, root = arrow_fs.FileSystem.from_uri(base)
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(own := f"{root}/.{part}-{uuid.uuid4().hex}") as sink:
                sink.write(np.sort(group.column("rid").to_numpy()).astype("<i8").tobytes())
            fs.move(own, f"{root}/{part}")
            return pa.table({"part": pa.array([part], pa.int32())})

        sent = rows.select(F.shiftright("rid", 40).cast("int").alias("part"), "rid")
        self.scratch.table(sent.groupBy("part").applyInArrow(save, "part int"), f"{name}-done")

        def load(part: int) -> np.ndarray:
            fs, root = arrow_fs.FileSystem.from_uri(base)
            if fs.get_file_info(f"{root}/{part}").type == arrow_fs.FileType.NotFound:
                return np.zeros(0, np.int64)
            with fs.open_input_stream(f"{root}/{part}") as source:
                return np.frombuffer(source.read(), "<i8")

        return load
