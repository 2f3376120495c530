"""Benchmark decontamination by winnowing.

Of every 10 words in a row the smallest hash of 4 words is kept (7 hashes to a window), on both sides by the same rule,
so any 10 words that a document and a benchmark item share leave at least one common fingerprint. Fingerprints are
joined, and a document's words around each that meets are extended to all 10-word windows that cover it, which count
where an item has the same window. So a meeting costs seven windows whatever repeats: a document of one word and an item
of the same word meet at every position, but no pairs of positions are listed, and items are listed once for each
different window of a document. Items of fewer words are looked up whole, by the hash of as many words.

The benchmark goes to the tasks as an index. Its size is checked: an index has `BLOCK_WORDS` words at most, and a larger
benchmark is cut into several, written to the shared folder, which every task reads one after the other over each
`LARGE` bytes of text. Documents are never shuffled, so common passages or long documents gather nowhere.

Null and empty texts have no words and no hits; so have null or empty items. An item without id marks words as hit but
is not listed. Repeated items count once by id. Other columns of the inputs are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, arrow_map, flat, pieces, table
from pointloom.llm.wordscan import leftmost_minimum, runs, words

WINDOW, GRAM = 10, 4
BLOCK_WORDS = 2_000_000
BUDGET, LARGE = 1 << 21, 1 << 24  # bytes of text that are handled at a time, with one index and with several


class Index:
    """Fingerprints and windows of the items of a block."""

    def __init__(self, ids: list[str | None], texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        self.ids, self.window, self.gram = np.array(ids, object), window, gram
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        hashes, item, first = words(data, offsets)
        n = np.diff(first)
        self.keys = np.unique(fingerprints(hashes, item, window, gram)[0])
        self.whole = {}  # number of words -> hashes of windows or of whole items, in order, and their items
        for k in np.unique(np.minimum(n[n > 0], window)).tolist():
            found = runs(hashes, k)
            at = np.flatnonzero(item[: len(found)] == item[k - 1 :]) if k == window else first[:-1][n == k]
            self.whole[k] = distinct(found[at], item[at])


def fingerprints(hashes: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and the positions of their first words."""
    grams = runs(hashes, gram)
    at = leftmost_minimum(grams, window - gram + 1)
    at = at[doc[: len(at)] == doc[window - 1 :]] if len(at) else at  # windows of one document
    at = np.unique(at)
    return grams[at], at


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def meetings(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in keys, in sorted_keys) of all equal pairs."""
    lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
    n = hi - lo
    of = np.repeat(np.arange(len(keys)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def hits(index: Index, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word) of the stretches that an item has too, and the (document, item) pairs that meet."""
    starts, ends, docs, items = ([np.zeros(0, np.int64)] for _ in range(4))
    for k, (whole, item) in index.whole.items():
        grams = runs(hashes, k)
        if k < index.window:
            at = np.flatnonzero(doc[: len(grams)] == doc[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
        else:
            keys, kept = fingerprints(hashes, doc, index.window, index.gram)
            kept = kept[index.keys[np.minimum(np.searchsorted(index.keys, keys), len(index.keys) - 1)] == keys]
            near = np.zeros(len(grams) + 1, np.int32)  # windows that cover a fingerprint which an item has
            np.add.at(near, np.maximum(kept - (index.window - index.gram), 0), 1)
            np.add.at(near, np.minimum(kept + 1, len(grams)), -1)
            at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            at = at[doc[at] == doc[at + k - 1]]
        place = np.minimum(np.searchsorted(whole, grams[at]), len(whole) - 1)
        hit = whole[place] == grams[at]
        at, place = at[hit], place[hit]
        starts.append(at)
        ends.append(at + k)
        own, place = distinct(doc[at], place)  # a window that a document repeats asks once
        of, to = meetings(whole, whole[place])
        own, found = distinct(own[of], item[to])
        docs.append(own)
        items.append(found)
    return tuple(np.concatenate(x) for x in (starts, ends, docs, items))


def item_blocks(benchmark: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> Callable[[], list[Callable[[], Index]]]:
    """Indexes of the benchmark, each of a bounded number of words, as functions that load them in a task."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    size = items.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-size // (2 * BLOCK_WORDS)) or 1  # a word takes two bytes at least, with what parts it from the next
    if blocks == 1:
        rows = items.collect()
        index = Index([r["id"] for r in rows], [bytes(r["text"]) for r in rows])
        return [lambda: index]
    fs, root = arrow_fs.FileSystem.from_uri(scratch.path("items"))
    fs.create_dir(root, recursive=True)
    items, out = scratch.table(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition(blocks, "block"), "item_rows"), []
    for block in range(blocks):
        rows = items.where(F.col("block") == block).collect()
        with fs.open_output_stream(f"{root}/{block}") as sink:
            sink.write(pickle.dumps(Index([r["id"] for r in rows], [bytes(r["text"]) for r in rows])))
        out.append(lambda uri=scratch.path(f"items/{block}"): _load(uri))
    return out


def _load(uri: str) -> Index:
    fs, path = arrow_fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as source:
        return pickle.loads(source.read())


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, *keep, n_words, spans array of (start, end) in words, items array of strings), one per document."""
    load = item_blocks(benchmark, Scratch(docs.sparkSession, "decontaminate"), item_col, item_text_col)
    columns = list(dict.fromkeys([id_col, *keep]))
    source = docs.select(*columns, *([] if text_col in columns else [text_col]))
    at = source.columns.index(text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def of(batch):
        data, offsets = flat(batch.column(at))
        for lo, hi in pieces(offsets, BUDGET if len(load) == 1 else LARGE):
            part = data[offsets[lo] : offsets[hi]]
            hashes, doc, bounds = words(part, offsets[lo : hi + 1] - offsets[lo])
            items, marks = [set() for _ in range(hi - lo)], np.zeros(len(hashes) + 1, np.int32)
            for one in load:
                index = one()
                start, end, docs_, found = hits(index, hashes, doc)
                np.add.at(marks, start, 1)
                np.add.at(marks, end, -1)
                for d, i in zip(docs_.tolist(), index.ids[found].tolist(), strict=True):
                    if i is not None:
                        items[d].add(i)
            spans = [[] for _ in range(hi - lo)]
            for d, a, b in zip(*(x.tolist() for x in covered(np.cumsum(marks[:-1]) > 0, doc, bounds)), strict=True):
                spans[d].append({"start": a, "end": b})
            out = [c.slice(lo, hi - lo) for c in batch.columns[: len(columns)]]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(bounds), pa.int64()), pa.array(spans, span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=[*columns, "n_words", "spans", "items"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in columns)
    return arrow_map(source, of, f"{kinds}, n_words long, spans array<struct<start:int,end:int>>, items array<string>")


def covered(live: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the runs of marked words, in words of their document."""
    edge = np.ones(len(live) + 1, bool)
    edge[1:-1] = (live[1:] != live[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(edge) if len(live) else np.zeros(1, np.int64)
    begin, end = at[:-1][live[at[:-1]]], at[1:][live[at[:-1]]]
    return doc[begin], begin - bounds[doc[begin]], end - bounds[doc[begin]]


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
