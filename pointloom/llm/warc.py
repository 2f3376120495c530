"""WARC archives compressed record by record with Zstandard and a shared dictionary.

An archive starts with a skippable frame that holds the dictionary; every record is a frame of its own, so a reader
loads the dictionary and then decodes one record at a time. The reader checks the archive's magic numbers, each
record's version line, header fields, lengths and payload digest.

Of records with one payload, that with the smallest page id is written in full and the others are `revisit` records
that name it. Payload digests decide which, by a grouped minimum; the pages themselves are shuffled once, by their
unique id, to meet the answer, so a payload with very many copies gathers nowhere. Each task writes archives, a new one
after every `ROLL` bytes, with a dictionary of bounded size trained on the task's first records.

Null html counts as empty. Rows that repeat the smallest page id of a payload are responses too. A null page id counts
as larger than any other; a null url is written as `about:blank`. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, table

#: Fixed values of the WARC and Zstandard formats.
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TRAINED_ON, DICTIONARY_SIZE = 200, 64 * 1024
ROLL = 1 << 28  # compressed bytes after which an archive is closed


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """Bytes of a record, before compression. A revisit has no block; its digest is that of the full payload."""
    block = payload if kind == "response" else b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", "about:blank" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Writes the dictionary frame and then one frame a record."""

    def __init__(self, sink: BinaryIO, samples: list[bytes], level: int = 3):
        self.sink = sink
        dictionary = make_dictionary(samples)
        raw = dictionary.as_bytes()
        sink.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
        self.n = self.size = 0

    def add(self, raw: bytes) -> None:
        frame = self.compressor.compress(raw)
        self.sink.write(frame)
        self.n += 1
        self.size += len(frame)


def make_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; where they are too few for training, the ends of the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_SIZE, samples)
    except zstandard.ZstdError:
        raw = b"".join(s[:1024] for s in samples)[-DICTIONARY_SIZE:]
        return zstandard.ZstdCompressionDict(raw.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of an archive's records; raises ValueError where the archive breaks the format."""
    head = source.read(8)
    if len(head) < 8:
        raise ValueError("archive without a dictionary frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError(f"archive starts with {magic:#x}, not with a dictionary frame")
    raw = source.read(size)
    if len(raw) != size:
        raise ValueError("dictionary frame is cut off")
    if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may be a compressed frame itself
        raw = zstandard.ZstdDecompressor().decompress(raw)
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    held, end = b"", False
    while True:
        one, out = decompressor.decompressobj(), []
        if not held and not end:
            held = source.read(1 << 20)
            end = not held
        if not held:
            return
        while not one.eof:
            if not held:
                held = source.read(1 << 20)
                if not held:
                    raise ValueError("record frame is cut off")
            out.append(one.decompress(held))
            held = one.unused_data if one.eof else b""
        yield parse(b"".join(out))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ValueError(f"record starts with {lines[0][:20]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(": ")
        if not colon or name in fields:
            raise ValueError(f"header line {line[:40]!r}")
        fields[name] = value
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest"):
        if name not in fields:
            raise ValueError(f"record without {name}")
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("record's length differs from its Content-Length")
    if fields["WARC-Type"] == "response" and f"sha1:{digest(block)}" != fields["WARC-Payload-Digest"]:
        raise ValueError("payload differs from its digest")
    if fields["WARC-Type"] == "revisit" and not fields.get("WARC-Refers-To"):
        raise ValueError("revisit without WARC-Refers-To")
    return fields, block


def write_archives(pages: DataFrame, scratch: Scratch, least_revisit: int = 0, roll: int = ROLL, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages; returns the manifest: rows (path, n). Payloads under `least_revisit` bytes are always responses."""
    base = scratch.path("archives")
    text = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("payload"))
    keys = source.select("page_id", F.when(F.length("payload") >= least_revisit, F.sha1("payload")).alias("digest")).where("digest is not null")
    keys = scratch.table(keys, "digests")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    ids = F.col("page_id").eqNullSafe(F.col("again_id"))
    # a row of each page id and payload: equal ids with different payloads keep their own answers
    again = keys.join(first, "digest").where("page_id is null or page_id > refers_to").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to").distinct()
    dealt = source.withColumn("digest", F.sha1("payload")).join(again, ids & (F.col("digest") == F.col("again_digest")), "left").select("page_id", "url", "payload", "refers_to")

    def write(batches):
        fs, root = arrow_fs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        name, out, sink, waiting = "", None, None, []

        def start():
            nonlocal name, out, sink
            name = f"{uuid.uuid4().hex}.warc.zst"
            sink = fs.open_output_stream(f"{root}/{name}")
            out = ArchiveWriter(sink, waiting)

        def stop() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [f"{base}/{name}"], "n": pa.array([out.n], pa.int64())})

        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = record("response" if refers is None else "revisit", page, url, payload, refers)
                if len(waiting) < TRAINED_ON:  # the dictionary is made from these, then they are written
                    waiting.append(raw)
                    if len(waiting) < TRAINED_ON:
                        continue
                    start()
                    for one in waiting:
                        out.add(one)
                    continue
                if out.size > roll:
                    yield stop()
                    start()
                out.add(raw)
        if out is None and waiting:
            start()
            for one in waiting:
                out.add(one)
        if out is not None:
            yield stop()

    return scratch.table(dealt.mapInArrow(write, "path string, n long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Rows (page_id, url, record_type, payload_bytes, payload_digest, refers_to, html) of all records.

    html is null for revisits, whose payload lies in the record that they refer to.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def number(urn: str | None) -> int | None:
        tail = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(tail) if tail else None

    def read(batches):
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, file = arrow_fs.FileSystem.from_uri(path)
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(file) as source:
                    for f, block in read_records(source):
                        full = f["WARC-Type"] == "response"
                        rows.append((number(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Type"], int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), number(f.get("WARC-Refers-To")), block if full else None))
                        held, seen = held + len(block), seen + 1
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if seen != n:
                    raise ValueError(f"{path} has {seen} records of {n}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    tasks = max(1, manifest.count())
    return manifest.repartition(tasks).mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html binary")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "warc"), 0)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
