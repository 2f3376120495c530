"""Token files: Arrow files whose batches hold fixed-size lists of ids and masks, for random access without copies.

A store is a folder of shards in ascending order of documents. A shard holds whole documents: their ids run on through
rows of `width` ids, each a fixed-size list beside a list of booleans that are true for real ids; only a shard's last
row is padded. Ids take 16 bits where the vocabulary allows it. A second Arrow file beside it has each document's id
and first position. As all rows have one size, position p lies in row p // width, and a reader that maps the file
reaches it without reading others. Batches are not compressed, for that reason.

Each task writes files named by its attempt and returns their names, so a repeated task leaves a file that no one reads.
Null text is stored as the end id alone. Repeated rows are stored each; rows of one id may be dealt over many shards.
Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, table
from pointloom.llm.tokens import default_vocabulary, word_ids

ROWS = 256  # rows of a batch
KEPT = 600_000  # known chunks of text a worker keeps, twice; nothing else fills its memory here


class ShardWriter:
    """Appends ids of documents; writes a batch whenever ROWS rows are full."""

    def __init__(self, sink, width: int, kind: pa.DataType):
        self.width, self.kind, self.kept, self.n_kept, self.n = width, kind, [], 0, 0
        self.schema = pa.schema([("ids", pa.list_(kind, width)), ("mask", pa.list_(pa.bool_(), width))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.kept.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n_kept += len(ids)
        self.n += len(ids)
        if self.n_kept >= ROWS * self.width:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.kept) if self.kept else np.zeros(0, self.kind.to_pandas_dtype())
        size = ROWS * self.width
        full = len(ids) // size * size
        for lo in range(0, full, size):
            self._batch(ids[lo : lo + size], size)
        rest = ids[full:]
        if last and len(rest):
            self._batch(np.pad(rest, (0, -len(rest) % self.width)), len(rest))
            rest = rest[:0]
        self.kept, self.n_kept = [rest], len(rest)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.width), pa.FixedSizeListArray.from_arrays(mask, self.width)], schema=self.schema))

    def close(self) -> None:
        self._write(True)
        self.out.close()


def write_store(docs: DataFrame, scratch: Scratch, width: int = 2048, end_id: int = 2, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; returns the manifest: rows (shard, path, n_docs, n_tokens, start), start counting over all shards."""
    path, base = vocabulary or default_vocabulary(), scratch.path("store")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, 2 * source.rdd.getNumPartitions())
    # the second key only parts rows of one id, if they are too many for a shard
    dealt = source.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches):
        from pyspark import TaskContext

        ids, shard = word_ids(path, KEPT), TaskContext.get().partitionId()
        kind = pa.uint16() if len(ids.last) <= 65_536 and end_id < 65_536 else pa.uint32()
        fs, root = arrow_fs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        name = f"{shard:07d}-{uuid.uuid4().hex}"
        out, keys, starts, end = None, [], [], np.array([end_id], "<u4")
        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), ids.each(batch.column(1)), strict=True):
                if out is None:
                    sink = fs.open_output_stream(f"{root}/{name}.arrow")
                    out = ShardWriter(sink, width, kind)
                keys.append(doc)
                starts.append(out.n)
                out.add(np.append(found, end))
        if out is not None:
            out.close()
            sink.close()
            with fs.open_output_stream(f"{root}/{name}.index.arrow") as sink, pa.ipc.new_file(sink, pa.schema([("doc_id", pa.int64()), ("start", pa.int64())])) as index:
                index.write_table(pa.table({"doc_id": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64())}))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{base}/{name}"], "n_docs": [len(keys)], "n_tokens": [out.n]})

    manifest = scratch.table(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def open_shard(path: str) -> tuple[pa.ipc.RecordBatchFileReader, pa.Table]:
    """Reader of a shard's rows, and its index."""
    fs, file = arrow_fs.FileSystem.from_uri(path)
    with pa.ipc.open_file(fs.open_input_file(f"{file}.index.arrow")) as index:
        table = index.read_all()
    source = pa.memory_map(f"{file}.arrow") if isinstance(fs, arrow_fs.LocalFileSystem) else fs.open_input_file(f"{file}.arrow")
    return pa.ipc.open_file(source), table


def span(reader: pa.ipc.RecordBatchFileReader, start: int, n: int) -> np.ndarray:
    """Ids start to start + n of a shard; only the batches that they touch are read."""
    width = reader.schema.field("ids").type.list_size
    size, out = ROWS * width, []
    while n:
        ids = reader.get_batch(start // size).column(0).flatten().to_numpy()
        part = ids[start % size : start % size + n]
        out.append(part)
        start, n = start + len(part), n - len(part)
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def documents_of(path: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, start, ids) of a shard's documents in order, a batch in memory at a time; the mask ends the last one."""
    reader, index = open_shard(path)
    size = ROWS * reader.schema.field("ids").type.list_size
    last = reader.get_batch(reader.num_record_batches - 1)
    real = (reader.num_record_batches - 1) * size + int(last.column(1).flatten().to_numpy(zero_copy_only=False).sum())
    starts = index.column("start").to_pylist()
    held, at = None, -1
    for doc, a, b in zip(index.column("doc_id").to_pylist(), starts, [*starts[1:], real], strict=True):
        if a // size == (b - 1) // size:
            if at != a // size:
                at = a // size
                held = reader.get_batch(at).column(0).flatten().to_numpy()
            yield doc, a, held[a - at * size : b - at * size]
        else:
            yield doc, a, span(reader, a, b - a)


def read_store(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files of a manifest."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(doc, base + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, a, ids in documents_of(path)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, manifest.count())
    return manifest.select("path", "start").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(write_store(table(spark, sf_dir, "documents"), Scratch(spark, "tokenstore")))
