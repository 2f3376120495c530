"""Best-fit packing by minimum bin slack.

Every text becomes token ids and an end id; documents over the capacity are cut into pieces of it. What decides a
packing is only how many pieces there are of each length, a table of `capacity` rows at most. The driver fills bins over
that table: the largest length that is left opens a bin, a bitset of reachable sums over the other available lengths
finds the fullest feasible combination, and the combination is removed, as often at once as the counts allow. Each such
step exhausts a length, so the list of patterns is bounded by the capacity and not by the number of documents.

Pieces find their places by rank within their length. The rank comes from two levels: a task numbers its pieces of each
length as it writes them, and the counts of each task and length, summed up, tell how many lie ahead. So pieces are
neither sorted nor grouped, and a length with a third of all pieces gathers nowhere. The pattern list, bounded as said,
goes to the tasks, which search it with the rank.

Null text packs as empty: the end id alone. Repeated rows are packed each. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, arrow_map, release, table
from pointloom.llm.tokens import default_vocabulary, word_ids

KEPT = 800_000  # known chunks and parts of text a worker keeps, twice

def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """How many of each length make up the largest sum of at most `room`."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in order:
        if length > room:
            continue
        left, chunk = min(counts[length], room // length), 1
        while left > 0:
            n = min(chunk, left)
            steps.append((reach, length, n))
            reach |= reach << (length * n) & mask
            left, chunk = left - n, chunk * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, length, n in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + n
            at -= length * n
    return taken


def patterns(lengths: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Bins as (how many of each length, how often)."""
    counts = {k: v for k, v in sorted(lengths.items(), reverse=True) if v}
    while counts:
        order = list(counts)
        first = order[0]
        counts[first] -= 1
        taken = fullest(counts, order, capacity - first)
        counts[first] += 1
        taken[first] = taken.get(first, 0) + 1
        times = min(counts[k] // n for k, n in taken.items())
        for k, n in taken.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        yield taken, times


def places(lengths: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks of one length that go to a run of bins, ordered by (length, first rank)."""
    rows, used, bins = [], {}, 0
    for taken, times in patterns(lengths, capacity):
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            rows.append((length, used.get(length, 0), bins, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        bins += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "bin", "n", "offset"), columns, strict=True))


def token_pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", kept: int | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, number): number counts the pieces of a length within a partition."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def of(batches):
        from pyspark import TaskContext

        part, seen, end = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), np.array([end_id], "<u4").tobytes()
        release("tokens")
        for batch in batches:
            ids, out = word_ids(vocabulary, kept or KEPT), []
            for doc, found in zip(batch.column(0).to_pylist(), ids.each(batch.column(1)), strict=True):
                n = len(found) + 1
                for piece, start in enumerate(range(0, n, capacity)):
                    size, crc = min(capacity, n - start), zlib.crc32(found[start : start + capacity])
                    out.append((doc, piece, start, size, zlib.crc32(end, crc) if start + size == n else crc, part, int(seen[size])))
                    seen[size] += 1
            if out:
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])
            del batch, ids, out
            release("tokens")

    return source.mapInArrow(of, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, number long")


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", kept: int | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document lies.

    `kept` bounds the entries of a worker's token cache, which trades memory for time and changes no result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.table(token_pieces(docs, capacity, end_id, vocabulary or default_vocabulary(), id_col, text_col, kept), "pieces")
    sizes = scratch.table(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "sizes")  # capacity rows a partition at most
    lengths = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = places(lengths, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("ahead"))
    ranked = cut.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("number")).alias("rank"))
    shift = np.int64(1 << 48)
    keys = plan["length"] * shift + plan["rank"]

    def seat(batch):
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        at = np.searchsorted(keys, length * shift + rank, "right") - 1
        nth = rank - plan["rank"][at]
        sequence, offset = plan["bin"][at] + nth // plan["n"][at], plan["offset"][at] + nth % plan["n"][at] * length
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return arrow_map(ranked, seat, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), 4096, 1)
