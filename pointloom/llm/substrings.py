"""Exact removal of repeated substrings by prefix-free parsing.

A rolling hash over 16 bytes marks triggers: the leftmost smallest hash of every 50-byte window. Each window thus has
one trigger that its own bytes decide, wherever it lies, and a phrase is the stretch of all neighbouring windows with
one trigger (phrases overlap by 49 bytes, so the parse loses no window). Documents are parsed to phrases in three
passes over the same written table:

1. Parse. A phrase is sent as (trigger, content hash) to the bucket of its trigger, once a chunk of text with the
   smallest document that has it there. The bucket orders the dictionary of phrases by (trigger, content, document): a
   phrase whose content is in a smaller document repeats as a whole; one that shares its trigger with other contents
   may repeat in part.
2. The bytes of the latter alone, the first of each content, are sent to the bucket of their trigger. There all their
   50-byte suffixes are put in lexicographic order (the suffix array of that part of the dictionary, cut at 50 bytes)
   and every one learns the smallest document it starts in. A trigger of over `HOT` contents (a passage that very many
   documents set in different words) is not gathered: the windows of its phrases go by their own hashes to further
   buckets, each once a chunk with the smallest document that has it there.
3. The parse takes the corpus order of its phrases' windows from both answers and removes what the repeated ones cover.

What orders the corpus here is the dictionary alone. Suffixes are compared over 50 bytes, and as phrases overlap by 49,
each window lies whole in a phrase: suffixes of phrases that agree that far are one group, whichever phrases follow. The
suffix array of the parse would only order the members of a group among each other by what follows them, which the
smallest document of the group does not ask for, so the parse is not sorted; its list of documents by phrase is used.

Texts are never shuffled: answers go to a file for each partition of the table, and a partition reads its own. Sizes
are bounded: chunks by CHUNK bytes (a longer text is parsed in segments that overlap by 49 bytes), buckets by their
number, which grows with the text, and a phrase that very many documents share comes once a chunk.

Null text counts as empty; a null id counts as larger than any other; rows with equal ids never remove each other's
bytes. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, flat, mix, pieces, plain_scan, release, table
from pointloom.llm.wordscan import prefix_hash, stretch_hash

GRAM = 16
CHUNK = 1 << 20
HOT = 20_000  # contents that a trigger may have in a bucket; about 2 MB of phrases
PER_BUCKET = 4_000_000  # bytes of text a bucket answers for, on average
_SALT = mix(np.arange(1000, 1256, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit rolling hashes of all 16-byte stretches."""
    h, step = _SALT[data], 1
    for factor in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        h = h[:-step] * np.uint64(factor | 1) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    return h


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(segment, first window, number of windows, trigger hash, content hash) of the phrases of each segment."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = gram_hashes(data)
    where = np.uint64((1 << 24) - 1)
    low = (grams * np.uint64(0x9E3779B97F4A7C15)) & ~where | np.arange(len(grams), dtype=np.uint64)
    width, want = 1, length - GRAM + 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < want:
        low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
    at = (low & where).astype(np.int64)  # of the window that starts here
    n = len(data) - length + 1
    inside = np.zeros(n + 1, np.int32)
    start, end = offsets[:-1], offsets[1:] - length + 1
    some = end > start
    np.add.at(inside, start[some], 1)
    np.add.at(inside, end[some], -1)
    ok = np.cumsum(inside[:n]) > 0
    turn = np.ones(n, bool)
    turn[1:] = at[1:] != at[:-1]
    edge = np.zeros(n + 1, bool)
    edge[start[some]] = True
    first = ok & (turn | edge[:n])
    first[1:] |= ok[1:] & ~ok[:-1]
    p = np.flatnonzero(first)
    stop = np.zeros(n, bool)
    stop[:-1] = ok[:-1] & (first[1:] | ~ok[1:])
    stop[-1] = ok[-1]
    many = np.flatnonzero(stop) + 1 - p
    segment = np.searchsorted(offsets, p, "right") - 1
    return segment, p, many, mix(grams[at[p]]), stretch_hash(prefix_hash(data), p, p + many + length - 1)


def chunks(column: pa.Array, ids: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, first byte, bytes, offsets, ids) of chunks; a long row comes in segments that overlap."""
    data, offsets = flat(column)
    for lo, hi in pieces(offsets, CHUNK):
        size = int(offsets[hi] - offsets[lo])
        if hi - lo > 1 or size <= 2 * CHUNK:
            yield lo, hi, 0, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ids[lo:hi]
        else:
            for a in range(0, size - length + 1, CHUNK):
                b = min(size, a + CHUNK + length - 1)
                yield lo, hi, a, data[offsets[lo] + a : offsets[lo] + b], np.array([0, b - a]), ids[lo:hi]


class Parsed:
    """Phrases of a chunk and those of them that are sent: the first of each (trigger, content) by id, by bucket."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int, buckets: int):
        self.segment, self.at, self.many, trigger, content = phrases(data, offsets, length)
        self.doc = ids[self.segment]
        order = np.lexsort((self.doc, content, trigger))
        t, c = trigger[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        group = np.cumsum(new) - 1
        head = order[new]  # in order of trigger, hence of bucket
        self.of = np.empty(len(order), np.int64)  # the sent phrase that stands for each
        self.of[order] = group
        self.head = head
        self.repeats = self.doc > self.doc[head][self.of] if len(order) else np.zeros(0, bool)
        self.trigger, self.content = trigger[head], content[head]
        self.bucket = bucket_of(self.trigger, buckets)


class Windows:
    """Windows of the phrases `asked` of a chunk and those of them that are sent: the first of each (window, trigger) by id."""

    def __init__(self, p: Parsed, asked: np.ndarray, data: np.ndarray, length: int, buckets: int):
        head = p.head[asked]
        many = p.many[head]
        self.many = many
        at = np.repeat(p.at[head], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own, trigger = np.repeat(p.doc[head], many), np.repeat(p.trigger[asked], many)
        window = stretch_hash(prefix_hash(data), at, at + length)
        order = np.lexsort((own, trigger, window))
        w, t = window[order], trigger[order]
        new = np.ones(len(order), bool)
        new[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        first = order[new]
        self.window, self.trigger, self.doc = window[first], trigger[first], own[first]
        self.repeats = own > self.doc[self.of] if len(order) else np.zeros(0, bool)
        self.bucket = buckets + bucket_of(self.window, buckets)


def bucket_of(trigger: np.ndarray, buckets: int) -> np.ndarray:
    return ((trigger >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(bucket[a]), slice(a, b)


def packed(*arrays: np.ndarray) -> bytes:
    """Numbers with small differences, small."""
    return zlib.compress(b"".join(np.diff(a, prepend=a.dtype.type(0)).tobytes() for a in arrays), 1)


ASK = pa.schema([("bucket", pa.int32()), ("split", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("docs", pa.binary()), ("body", pa.binary())])
ASK_SQL = "bucket int, split int, chunk int, n int, docs binary, body binary"
ANSWER = pa.schema([("split", pa.int32()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
ANSWER_SQL = "split int, chunk int, bucket int, body binary"


def _columns(group: pa.Table) -> tuple[list[int], np.ndarray, list[bytes]]:
    n = group.column("n").to_pylist()
    docs = [np.cumsum(np.frombuffer(zlib.decompress(x), np.int64)) for x in group.column("docs").to_pylist()]
    return n, np.concatenate(docs), group.column("body").to_pylist()


def _answers(group: pa.Table, bodies: list[bytes]) -> pa.Table:
    return pa.table([group.column("split"), group.column("chunk"), group.column("bucket"), pa.array(bodies, pa.binary())], schema=ANSWER)


def whole(group: pa.Table, hot: int = HOT) -> pa.Table:
    """0: no other document has the phrase or its trigger; 1: a smaller document has the phrase; 2: parts may repeat; 3: they
    may, and the trigger has over `hot` contents."""
    n, doc, bodies = _columns(group)
    numbers = [np.frombuffer(b, np.uint64) for b in bodies]
    trigger = np.concatenate([x[: len(x) // 2] for x in numbers])
    content = np.concatenate([x[len(x) // 2 :] for x in numbers])
    order = np.lexsort((doc, content, trigger))
    t, c, d = trigger[order], content[order], doc[order]
    new_t = np.ones(len(t), bool)
    new_t[1:] = t[1:] != t[:-1]
    new_c = new_t.copy()
    new_c[1:] |= c[1:] != c[:-1]
    of_t, of_c = np.cumsum(new_t) - 1, np.cumsum(new_c) - 1
    contents = np.bincount(of_t, new_c)
    lowest, highest = np.minimum.reduceat(d, np.flatnonzero(new_t)), np.maximum.reduceat(d, np.flatnonzero(new_t))
    shared = np.where(contents > hot, 3, 2)[of_t]
    state = np.where(d > d[new_c][of_c], 1, np.where((contents[of_t] > 1) & (lowest < highest)[of_t], shared, 0)).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = state
    ends = np.cumsum(n).tolist()
    return _answers(group, [zlib.compress(out[a:b].tobytes(), 1) for a, b in zip([0, *ends[:-1]], ends, strict=True)])


def by_window(group: pa.Table) -> pa.Table:
    """Bits of the windows that were sent: whether a smaller document has one."""
    n, doc, bodies = _columns(group)
    numbers = [np.frombuffer(b, np.uint64) for b in bodies]
    window = np.concatenate([x[: len(x) // 2] for x in numbers])
    trigger = np.concatenate([x[len(x) // 2 :] for x in numbers])
    order = np.lexsort((doc, trigger, window))
    w, t, d = window[order], trigger[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
    out = np.empty(len(order), bool)
    out[order] = d > d[new][np.cumsum(new) - 1]
    ends = np.cumsum(n).tolist()
    return _answers(group, [zlib.compress(np.packbits(out[a:b]).tobytes(), 1) for a, b in zip([0, *ends[:-1]], ends, strict=True)])


def in_part(length: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Bits of the windows of each phrase, in turn: whether a smaller document has the window. Buckets from `buckets` on are of windows."""

    def answer(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() >= buckets:
            return by_window(group)
        n, doc, bodies = _columns(group)
        sizes, texts = [], []
        for k, body in zip(n, bodies, strict=True):
            sizes.append(np.frombuffer(body, np.int32, k))
            texts.append(body[4 * k :])
        size = np.concatenate(sizes).astype(np.int64)
        text = np.frombuffer(b"".join(texts), np.uint8)
        many = size - length + 1
        begin = np.cumsum(size) - size
        start = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        # order of suffixes by their first `length` bytes, as big-endian words from the last to the first
        pad = np.concatenate([text, np.zeros(8, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(pad, 8)
        keys = [view[start + max(0, min(i, length - 8))].copy().view(">u8").ravel().astype(np.uint64) for i in range(0, length, 8)]
        owner = np.repeat(doc, many)
        order = np.lexsort((owner, *keys[::-1]))
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        own = owner[order]
        out = np.empty(len(order), bool)
        out[order] = own > own[new][np.cumsum(new) - 1]
        windows = [int(x) for x in np.cumsum([m.sum() for m in np.split(many, np.cumsum(n)[:-1])])]
        return _answers(group, [zlib.compress(np.packbits(out[a:b]).tobytes(), 1) for a, b in zip([0, *windows[:-1]], windows, strict=True)])

    return answer


def lean(by: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """Gives a group's memory back before the next one comes."""

    def of(group: pa.Table) -> pa.Table:
        out = by(group)
        release()
        return out

    return of


def save(base: str) -> Callable[[pa.Table], pa.Table]:
    """Writes the answers of a partition to its file."""

    def of(group: pa.Table) -> pa.Table:
        split = group.column("split")[0].as_py()
        fs, root = arrow_fs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        found = {(c, b): body for c, b, body in zip(*(group.column(k).to_pylist() for k in ("chunk", "bucket", "body")), strict=True)}
        with fs.open_output_stream(own := f"{root}/.{split}-{uuid.uuid4().hex}") as sink:
            sink.write(pickle.dumps(found))
        fs.move(own, f"{root}/{split}")
        return pa.table({"split": pa.array([split], pa.int32())})

    return of


def load(base: str, split: int) -> dict[tuple[int, int], bytes]:
    fs, root = arrow_fs.FileSystem.from_uri(base)
    if fs.get_file_info(f"{root}/{split}").type == arrow_fs.FileType.NotFound:
        return {}
    with fs.open_input_stream(f"{root}/{split}") as source:
        return pickle.loads(source.read())


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, then_schema: str = "", hot: int = HOT) -> DataFrame:
    """Rows (doc_id, text binary, *keep, spans array of (start, end) in bytes): what repeats a smaller document.

    `then` turns batches of these rows into others of `then_schema` in the same worker.

    A byte belongs to a span if a stretch of `length` bytes that covers it also starts in a document with a smaller id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    source = docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("__text"), *keep)
    source = source if plain_scan(source) else scratch.table(source, "docs")
    size = source.select(F.coalesce(F.sum(F.length("__text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(96, -(-size // PER_BUCKET))
    first_dir, second_dir = scratch.path("whole"), scratch.path("parts")

    def parsed(batches):
        """(split, chunk number, batch, where of the chunk, its bytes, its phrases) of a partition, the same each time."""
        from pyspark import TaskContext

        split, chunk = TaskContext.get().partitionId(), -1
        for batch in batches:
            ids = pc.fill_null(batch.column(0), 2**63 - 1).to_numpy()
            for lo, hi, a, data, offsets, own in chunks(batch.column(1), ids, length):
                chunk += 1
                yield split, chunk, batch, (lo, hi, a), data, Parsed(data, offsets, own, length, buckets)
                del data, offsets, own
            release()

    def rows(split: int, chunk: int, found: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        n = len(found)
        bucket, many, docs_, body = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([split] * n, pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array(many, pa.int32()), pa.array(docs_, pa.binary()), pa.array(body, pa.binary())], schema=ASK)

    def ask_whole(batches):
        for split, chunk, _, _, _, p in parsed(batches):
            doc = p.doc[p.head]
            found = [(b, s.stop - s.start, packed(doc[s]), p.trigger[s].tobytes() + p.content[s].tobytes()) for b, s in by_bucket(p.bucket)]
            if found:
                yield rows(split, chunk, found)

    def states(known: dict, chunk: int, p: Parsed) -> np.ndarray:
        out = np.zeros(len(p.head), np.uint8)
        for b, s in by_bucket(p.bucket):
            body = np.frombuffer(zlib.decompress(known[chunk, b]), np.uint8)
            if len(body) != s.stop - s.start:
                raise RuntimeError("the partitions of the written table changed between passes")
            out[s] = body
        return out

    def ask_parts(batches):
        known = None
        for split, chunk, _, _, data, p in parsed(batches):
            known = load(first_dir, split) if known is None else known
            state = states(known, chunk, p)
            asked = np.flatnonzero(state == 2)
            head = p.head[asked]
            doc, start, size = p.doc[head], p.at[head], p.many[head] + length - 1
            found = []
            for b, s in by_bucket(p.bucket[asked]):
                body = b"".join(data[x : x + n].tobytes() for x, n in zip(start[s].tolist(), size[s].tolist(), strict=True))
                found.append((b, s.stop - s.start, packed(doc[s]), size[s].astype(np.int32).tobytes() + body))
            if (state == 3).any():
                w = Windows(p, np.flatnonzero(state == 3), data, length, buckets)
                found += [(b, s.stop - s.start, packed(w.doc[s]), w.window[s].tobytes() + w.trigger[s].tobytes()) for b, s in by_bucket(w.bucket)]
            if found:
                yield rows(split, chunk, found)

    def covered(batches):
        """(batch, first row, end row, first byte, marks): whether each byte of the chunk is to go."""
        known = parts = None
        for split, chunk, batch, where, data, p in parsed(batches):
            if known is None:
                known, parts = load(first_dir, split), load(second_dir, split)
            state = states(known, chunk, p)
            asked = np.flatnonzero(state == 2)
            many = p.many[p.head]
            bits = np.zeros(int(many[asked].sum()), bool)
            ends = np.cumsum(many[asked])
            for b, s in by_bucket(p.bucket[asked]):
                lo, hi = int(ends[s.start] - many[asked[s.start]]), int(ends[s.stop - 1])
                bits[lo:hi] = np.unpackbits(np.frombuffer(zlib.decompress(parts[chunk, b]), np.uint8), count=hi - lo)
            place = np.full(len(p.head), -1)
            place[asked] = ends - many[asked]
            if (state == 3).any():
                w = Windows(p, np.flatnonzero(state == 3), data, length, buckets)
                smaller = np.zeros(len(w.window), bool)
                for b, s in by_bucket(w.bucket):
                    smaller[s] = np.unpackbits(np.frombuffer(zlib.decompress(parts[chunk, b]), np.uint8), count=s.stop - s.start)
                place[state == 3] = len(bits) + np.cumsum(w.many) - w.many
                bits = np.concatenate([bits, w.repeats | smaller[w.of]])
            gone = np.zeros(len(data) + 1, np.int32)
            full = p.repeats | (state[p.of] == 1)
            np.add.at(gone, p.at[full], 1)
            np.add.at(gone, p.at[full] + p.many[full] + length - 1, -1)
            if len(bits):
                mine = np.flatnonzero(~full & (state[p.of] >= 2))
                n = p.many[mine]
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hit = bits[np.repeat(place[p.of[mine]], n) + i]
                start = (np.repeat(p.at[mine], n) + i)[hit]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + length, -1)
            yield batch, where, np.cumsum(gone[:-1]) > 0

    plain, then = then is None, then or (lambda batch: batch)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kept_kinds = "".join(f", `{c}` {source.schema[c].dataType.simpleString()}" for c in keep)

    def out(batches):
        held: dict[int, tuple[pa.RecordBatch, int, np.ndarray]] = {}

        def emit(batch, lo, hi, marks):
            offsets = flat(batch.column(1))[1]
            offsets = offsets[lo : hi + 1] - offsets[lo]
            step = np.zeros(len(marks) + 1, np.int8)
            step[:-1] = marks
            step[1:] -= marks
            change = np.zeros(len(marks) + 1, bool)
            change[1:-1] = marks[1:] != marks[:-1]
            change[offsets] = True
            at = np.flatnonzero(change)
            begin, end = at[:-1], at[1:]
            live = marks[begin] if len(begin) else np.zeros(0, bool)
            begin, end = begin[live], end[live]
            row = np.searchsorted(offsets, begin, "right") - 1
            counts = np.bincount(row, minlength=hi - lo)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays([pa.array(begin - offsets[row]), pa.array(end - offsets[row])], fields=list(span.value_type)))
            columns = [c.slice(lo, hi - lo) for c in batch.columns]
            return pa.RecordBatch.from_arrays([*columns, lists], names=[*batch.schema.names, "spans"])

        for batch, (lo, hi, a), marks in covered(batches):
            if hi - lo > 1 or not (a or lo in held) and len(marks) == int(flat(batch.column(1).slice(lo, 1))[1][1]):
                yield then(emit(batch, lo, hi, marks))
                continue
            size = int(flat(batch.column(1).slice(lo, 1))[1][1])
            total = held.setdefault(lo, (batch, hi, np.zeros(size, bool)))[2]
            total[a : a + len(marks)] |= marks
            if a + len(marks) == size:
                held.pop(lo)
                yield then(emit(batch, lo, hi, total))

    def answers(ask, by, base):
        asked = source.select("__id", "__text").mapInArrow(ask, ASK_SQL)
        found = asked.groupBy("bucket").applyInArrow(lean(by), ANSWER_SQL)
        scratch.table(found.groupBy("split").applyInArrow(save(base), "split int"), base.rsplit("/", 1)[1] + "-done")

    answers(ask_whole, partial(whole, hot=hot), first_dir)
    answers(ask_parts, in_part(length, buckets), second_dir)
    scratch.keep("docs", "whole", "parts")
    if not plain:
        return source.mapInArrow(out, then_schema)
    found = source.mapInArrow(out, f"__id long, __text binary{kept_kinds}, spans array<struct<start:long,end:long>>")
    return found.withColumnsRenamed({"__id": id_col, "__text": text_col})


def cut(raw: bytes, spans: list) -> bytes:
    """The bytes outside the spans."""
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    out.append(raw[at:])
    return b"".join(out)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batch):
        n, kept = [], []
        for r, s in zip(batch.column(1), batch.column(2), strict=True):
            raw = r.as_py()
            n.append(len(raw))
            left = cut(raw, s.as_py())
            kept.append((len(raw) - len(left), hashlib.sha256(left).hexdigest()))
        spans = pc.cast(pc.list_value_length(batch.column(2)), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([k[0] for k in kept], pa.int64()), spans, pa.array([k[1] for k in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_spans(table(spark, sf_dir, "documents"), then=digest, then_schema="doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
