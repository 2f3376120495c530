import io
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import decontaminate, embeddings, langid, packing, preferences, sharding, simhash, substrings, tokens, tokenstore, warc
from pointloom.llm.common import Scratch, components, shared_dir, spread_join
from tests.llm import cases


@pytest.mark.parametrize("make", [cases.documents, cases.repeated, cases.empty])
def test_sharding(spark, make):
    docs = make(spark)
    got = sharding.shard_rows(docs, 5).collect()
    n = docs.count()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(5)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    by_id = {r["doc_id"]: r for r in got}
    if n:
        import zlib

        assert by_id[0]["size"] == 1 and by_id[0]["text_crc32"] == 0
        assert by_id[4]["text_crc32"] == zlib.crc32(cases.texts()[4].encode())


def test_sharding_moves_little():
    counts = {p: 10 for p in range(sharding.PLACES)}

    def owner(shards):
        out = {}
        for place, lo, hi, shard, _ in sharding.walk(counts, shards):
            out |= {(place, r): shard for r in range(lo, hi)}
        return out

    a, b = owner(16), owner(17)
    assert len(a) == len(b) == 10 * sharding.PLACES
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.35  # hashing by remainder moves 94 %


def test_sharding_splits_many_copies(spark):
    docs = spark.range(1).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.explode(F.sequence(F.lit(1), F.lit(100_000))).alias("x"))
    got = sharding.shard_rows(docs, 3).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d")).collect()
    assert sorted(r["n"] for r in got) == [33333, 33333, 33334] and all(r["n"] == r["d"] for r in got)


def test_walk_on_few_rows():
    assert sharding.walk({}, 4) == []
    assert sum(b - a for _, a, b, _, _ in sharding.walk({3: 2}, 16)) == 2


@pytest.mark.parametrize("make", [cases.documents, cases.repeated, cases.empty])
def test_simhash(spark, make):
    docs = make(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [cases.simhash(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    root = cases.groups(len(rows), lambda a, b: bin(prints[order[a]] ^ prints[order[b]]).count("1") <= 2)
    expected = Counter((rows[order[i]][0], prints[order[i]], rows[order[root[i]]][0]) for i in range(len(rows)))
    got = Counter((r["doc_id"], r["fp"] & 2**64 - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == expected


def test_fingerprint_links_are_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    every = set(base.tolist()) | {int(b) ^ int(np.int64(np.uint64(1) << np.uint64(i))) for b in base[:10] for i in range(0, 64, 5)}
    every |= {int(np.int64(np.uint64(b & 2**64 - 1) ^ np.uint64(3 << i))) for b in base[:5].tolist() for i in range(0, 62, 7)} | {0, -1, 1, 3, 7, -2}
    every = sorted(every)
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.fingerprint_links(spark.createDataFrame([(e,) for e in every], "fp long")).collect()}
    expected = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if bin((a ^ b) & 2**64 - 1).count("1") <= 2}
    assert got == expected


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 500).astype(np.uint64) for _ in range(2))
    split = lambda x: np.stack([simhash.bit_counts(x) >> np.uint64(4 * i) & np.uint64(15) for i in range(16)]).astype(int)
    assert (np.abs(split(a) - split(b)).sum(0) <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("make", [cases.documents, cases.repeated, cases.empty])
def test_drop_near_duplicates(spark, make):
    docs = make(spark)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is None, r[0]))
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for _, t in rows]
    like = lambda a, b: (rows[a][1] or "") == (rows[b][1] or "") or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = cases.groups(len(rows), like)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = {r["doc_id"] for r in got.collect()}
    expected = {rows[i][0] for i in range(len(rows)) if root[i] == i}
    assert kept - {None} == expected - {None} and got.count() == len(set(root))


def _star(edits, at):
    """A text of 400 words among its edits: each like it (0.86), but not like each other (about 0.75)."""
    rng = np.random.default_rng(7)
    original = [f"w{i}" for i in rng.integers(0, 10**6, 404)]
    texts = []
    for e in range(edits):
        words = list(original)
        for i in rng.permutation(40)[:6]:
            words[10 * i + 7] = f"x{e}-{i}"
        texts.append(" ".join(words))
    texts.insert(at, " ".join(original))
    return texts


@pytest.mark.parametrize("block", [512, 50])
def test_drop_near_duplicates_star(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", block, raising=False)
    texts = _star(300, 150)
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    root = cases.groups(len(texts), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted(set(root)) == [0]


def test_joined_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (6, 60)).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(0, 2**63, 60).astype(np.uint64), base[i % 6])) for i in range(120)]
    sets += [np.zeros(0, np.uint64), np.zeros(0, np.uint64), base[0][:50]]
    n = len(sets)
    data, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    expected = cases.groups(n, lambda a, b: simhash.jaccard(sets[a].tobytes(), sets[b].tobytes()) >= 0.8)
    for side in (None, np.arange(n) % 2 == 0):
        want = expected if side is None else cases.groups(n, lambda a, b: side[a] != side[b] and simhash.jaccard(sets[a].tobytes(), sets[b].tobytes()) >= 0.8)
        a, b = simhash.joined_sets(data, sizes, np.arange(n), side, 0.8)
        pairs = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert cases.groups(n, lambda i, j: frozenset((i, j)) in pairs) == want


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (7, 5)], [(i, i + 1) for i in range(60)] + [(100, 1000 + i) for i in range(50)]])
def test_components(spark, edges):
    links = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r["node"]: r["root"] for r in components(links, Scratch(spark, "t")).collect()}
    assert got == {r["node"]: r["root"] for r in components(links, Scratch(spark, "t"), least=10).collect()}
    ids = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(ids)}
    links = {(at[a], at[b]) for a, b in edges} | {(at[b], at[a]) for a, b in edges}
    root = cases.groups(len(ids), lambda a, b: (a, b) in links)
    assert got == {x: ids[root[i]] for i, x in enumerate(ids) if root[i] != i}


def test_components_raise_where_rounds_are_too_few(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(8)
    with pytest.raises(RuntimeError):
        components(links, Scratch(spark, "t"), rounds=1)


def test_a_shared_folder_is_required_beyond_one_machine():
    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared_dir(Session)


def test_spread_join(spark):
    rows = spark.createDataFrame([(i % 7 if i < 5000 else 7 + i,) for i in range(6000)], "key long")
    known = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("v", F.col("key") * 2)
    for least in (100, 100_000):
        got = spread_join(rows, known, "key", "n", 6000, least)
        assert got.count() == 6000 and got.where("v <> key * 2").count() == 0


def _settings(spark):
    """A passage that many documents set in different words, so that its triggers have many contents."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    line = "permission is hereby granted free of charge to any person obtaining a copy of this and that"
    rows = [(i, f"{word()} {word()} {line if i % 3 else line[:70]} {word()} {word()} {line[20:] if i % 5 == 0 else ''}", "s") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
@pytest.mark.parametrize("make", [cases.documents, cases.empty, _settings])
def test_substrings(spark, make, hot):
    docs = make(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r for r in substrings.repeated_spans(docs, keep=("source",), hot=hot).collect()}
    expected = cases.substrings(rows)
    assert got.keys() == expected.keys()
    import hashlib

    for i, (n, gone, spans, digest) in expected.items():
        raw, s = bytes(got[i]["text"]), got[i]["spans"]
        assert (len(raw), sum(x["end"] - x["start"] for x in s), len(s), hashlib.sha256(substrings.cut(raw, s)).hexdigest()) == (n, gone, spans, digest)


def test_substrings_of_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 4096)  # workers import the module anew, so lengthen the text too
    rng = np.random.default_rng(1)
    long = bytes(rng.integers(97, 123, 5_000_000).astype(np.uint8)).decode()
    docs = spark.createDataFrame([(1, long[2_000_000:2_200_000]), (2, long), (3, long[4_190_000:4_400_000])], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in substrings.repeated_spans(docs).collect()}
    assert got == {1: [], 2: [(2_000_000, 2_200_000)], 3: [(0, 210_000)]}


def test_equal_ids_do_not_remove_each_other(spark):
    docs = spark.createDataFrame([(1, "q" * 80 + "x"), (1, "q" * 80 + "y"), (None, "q" * 80)], "doc_id long, text string")
    got = sorted(((r["doc_id"], len(r["spans"])) for r in substrings.repeated_spans(docs).collect()), key=str)
    assert got == [(1, 0), (1, 0), (None, 1)]


@pytest.mark.parametrize("make", [cases.documents, cases.empty])
@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 30])
def test_decontamination(spark, make, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    t = cases.texts()
    items = [(1, t[5]), (2, " ".join(t[8].split()[50:75])), (3, "lazy dog"), (4, None), (5, ""), (6, "lime"), (7, t[9]), (10, "never seen"), (1, t[5])]
    docs = make(spark)
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == cases.contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_decontamination_of_repetitive_text(spark):
    import time

    docs = [(1, "a " * 20_000), (2, "a b " * 6_000 + "c"), (3, "a " * 9), (4, "b a " * 30)]
    items = [(1, "a " * 1_000), (2, "b a " * 500), (3, "a a a")]
    index = decontaminate.Index(["1", "2", "3"], [t.encode() for _, t in items])
    began = time.perf_counter()
    data = docs[0][1].encode()
    hashes, doc, _ = decontaminate.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    start, end, _, found = decontaminate.hits(index, hashes, doc)
    assert time.perf_counter() - began < 5 and len(start) == 19_991 + 19_998 and found.tolist() == [2, 0]
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == cases.contamination(docs, items)


def test_items_without_id_mark_words(spark):
    docs = spark.createDataFrame([(1, "x lazy dog y"), (2, "none")], "doc_id long, text string")
    got = {r["doc_id"]: (len(r["spans"]), r["items"]) for r in decontaminate.contamination(docs, spark.createDataFrame([(None, "lazy dog")], "item_id long, text string")).collect()}
    assert got == {1: (1, []), 2: (0, [])}


def test_decontamination_without_items(spark):
    got = decontaminate.contamination(cases.documents(spark), spark.createDataFrame([], "item_id long, text string"))
    assert got.where(F.size("items") > 0).count() == 0 and got.count() == len(cases.texts())


def _library():
    ids = tokens.word_ids(tokens.default_vocabulary())
    return lambda text: ids.library.encode(text or "", add_special_tokens=False).ids


def test_tokens_equal_the_library():
    ids, library = tokens.WordIds(tokens.default_vocabulary()), _library()
    more = ["", "a'S b's don't I'LL", "''ss 'Ve 'RE", "é ́a İstanbul ẞ", "<|endoftext|>", "12 3½ ²", "\x1c a\x1cb \x85c", "a\x00b", "ﬁ Å Ω", "힣 ᄀ ᅡ", "🙂👍🏽", "ſ'ſ K"]
    for text in [t or "" for t in cases.texts()] + more:
        assert np.frombuffer(ids.encode(text.encode()), "<u4").tolist() == library(text)


def test_tokens_survive_a_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 8)
    ids, library = tokens.WordIds(tokens.default_vocabulary()), _library()
    for text in [t or "" for t in cases.texts()]:
        assert np.frombuffer(ids.encode(text.encode()), "<u4").tolist() == library(text)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("room", [1, 40, 4 << 20])
def test_tokens_of_a_column(monkeypatch, kind, room):
    monkeypatch.setattr(tokens, "GROUP", room)
    ids, library = tokens.WordIds(tokens.default_vocabulary(), 20), _library()
    texts = [None, "", " \t\n", "  led and  trailing\r\n", None, "a,b. A,b a,b.", "é" * 50, "no-space" * 30, "NBSP\u00a0in it", *cases.texts(), None]
    column = pa.array(["cut off", *texts], kind).slice(1)
    got = [x.tolist() for x in ids.each(column)]
    assert got == [library(t) for t in texts]
    assert not list(ids.each(column.slice(0, 0)))


@pytest.mark.parametrize("make", [cases.documents, cases.repeated, cases.empty])
def test_packing(spark, make):
    docs, library = make(spark), _library()
    got = packing.pack(docs, 512, 1).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for doc, rows in by_doc.items():
        ids = library(texts[doc]) + [1]
        for r in rows:
            own = ids[r["start"] : r["start"] + 512]
            assert (r["start"], r["length"], r["ids_crc32"]) == (512 * r["piece"], len(own), cases.crc(own))
        assert len({r["piece"] for r in rows}) == -(-len(ids) // 512)
    for rows in bins.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= 512
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 512) + 1


def test_fullest_combination():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 40, 6)}
        order, room = sorted(counts, reverse=True), int(rng.integers(0, 60))
        taken = packing.fullest(counts, order, room)
        sums = {0}
        for k in counts:
            for _ in range(counts[k]):
                sums |= {s + k for s in sums if s + k <= room}
        assert sum(k * n for k, n in taken.items()) == max(sums) and all(n <= counts[k] for k, n in taken.items())


@pytest.mark.parametrize("make", [cases.documents, cases.repeated, cases.empty])
def test_token_store(spark, make):
    docs, library = make(spark), _library()
    manifest = tokenstore.write_store(docs, Scratch(spark, "t"), width=64)
    got = sorted(tokenstore.read_store(manifest).collect(), key=lambda r: r["start"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(library(t)) + 1, cases.crc(library(t) + [2])) for i, t in rows)
    at, last = 0, -1
    for r in got:
        assert r["start"] == at and (r["doc_id"] is None or r["doc_id"] >= last)
        at, last = at + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]


def test_token_store_random_access(spark):
    manifest = tokenstore.write_store(cases.documents(spark), Scratch(spark, "t"), width=16).collect()
    for m in manifest:
        reader, index = tokenstore.open_shard(m["path"])
        whole = np.concatenate([ids for _, _, ids in tokenstore.documents_of(m["path"])])
        assert len(whole) == m["n_tokens"] and index.num_rows == m["n_docs"]
        assert reader.schema.field("ids").type.list_size == 16
        for start in (0, 5, len(whole) // 2):
            assert tokenstore.span(reader, start, 3).tolist() == whole[start : start + 3].tolist()


PAGES = "page_id long, url string, html string, digest string, payload string, refers_to long"


@pytest.mark.parametrize("n", [0, 9])
def test_warc_round_trip(spark, n):
    html = [None, "", "<p>a</p>", "<p>a</p>", "é" * 300_000, "<p>a</p>", "\r\n\r\nx", "b", "b"]
    rows = [(i, None if i == 7 else f"http://x/{i}\r\n", h, "d", "p", 3) for i, h in enumerate(html)][:n]
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), Scratch(spark, "t"))).collect()}
    first = {}
    for i, _, h, *_ in rows:
        first.setdefault(h or "", i)
    assert len(got) == n
    for i, _, h, *_ in rows:
        raw, r = (h or "").encode(), got[i]
        again = first[h or ""] != i
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), cases.sha1_32(raw), "revisit" if again else "response", first[h or ""] if again else None)
        assert (r["html"] is None) if again else bytes(r["html"]) == raw


def test_warc_repeated_rows_and_small_payloads(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (None, "u", "same"), (3, "u", "x"), (4, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["record_type"]) for r in warc.read_archives(warc.write_archives(pages, Scratch(spark, "t"), 2)).collect()), key=str)
    assert got == [(1, "response"), (1, "response"), (2, "revisit"), (3, "response"), (4, "response"), (None, "revisit")]


def test_warc_archives_roll(spark):
    pages = spark.range(900).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p"), F.col("id"), F.sha2(F.col("id").cast("string"), 512)).alias("html")).repartition(1)
    manifest = warc.write_archives(pages, Scratch(spark, "t"), roll=20_000)
    assert manifest.count() > 2 and warc.read_archives(manifest).select("page_id").distinct().count() == 900


def _archive(*payloads: bytes) -> bytes:
    sink = io.BytesIO()
    raw = [warc.record("response", i, "u", p, None) for i, p in enumerate(payloads)]
    out = warc.ArchiveWriter(sink, raw)
    for r in raw:
        out.add(r)
    return sink.getvalue()


def test_warc_reader_rejects_broken_archives():
    good = _archive(b"one", b"two" * 1000)
    assert [b for _, b in warc.read_records(io.BytesIO(good))] == [b"one", b"two" * 1000]
    for bad in (b"", good[:6], struct.pack("<I", 1) + good[4:], good[:40], good[:-3]):
        with pytest.raises(Exception):
            list(warc.read_records(io.BytesIO(bad)))
    one = warc.record("response", 1, "u", b"abc", None)
    for bad in (one.replace(b"abc", b"abd"), one.replace(b"WARC/1.1", b"WARC/9.9"), one[:-1], one.replace(b"Content-Length: 3", b"Content-Length: 2"), one.replace(b"WARC-Date", b"WARC-Data")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_warc_trained_dictionary():
    many = [f"<html><head><title>{i}</title></head><body class='page main'>{i * 7919}</body></html>".encode() * 3 for i in range(400)]
    got = list(warc.read_records(io.BytesIO(_archive(*many))))
    assert [b for _, b in got] == many


def _brute_vectors(rows, least=0.9):
    units = []
    for _, v in rows:
        ok = v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        units.append(np.array(v) / np.linalg.norm(v) if ok else None)
    n = len(rows)
    link = lambda a, b: units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= least
    return [sum(link(a, b) for b in range(n) if a != b) for a in range(n)], cases.groups(n, link)


@pytest.mark.parametrize("block", [2048, 20])
def test_embeddings(spark, block):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 24))
    rows = [(centre[i % 4] + rng.normal(size=24) * (0.1 if i < 120 else 3.0)).tolist() for i in range(200)]
    rows += [rows[3], rows[3], None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [-0.0, 1.0, 0.0], [1e-300] * 24]
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n long, unit string, names int")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(table, block=block).collect()}
    links, root = _brute_vectors(list(enumerate(rows)))
    assert len(got) == len(rows)
    assert [got[i]["component_id"] for i in range(len(rows))] == root
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(links)
    assert all(got[i]["n_links"] <= links[i] for i in range(len(rows)))


def _pairs_at_threshold(n, seed, dim=64):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    return x, (0.9 + 1e-9) * x + np.sqrt(1 - (0.9 + 1e-9) ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)


@pytest.mark.parametrize("k", [3, 4])
def test_embeddings_recall_at_threshold(spark, k):
    """Pairs at cosine 0.9 with the k of larger tables, which n follows from."""
    x, y = _pairs_at_threshold(1500, k)
    table = spark.createDataFrame(list(enumerate(np.concatenate([x, y]).tolist())), "vec_id long, embedding array<double>")
    found = embeddings.near_vectors(table, k=k).where("vec_id < 1500 and n_links > 0").count()
    assert found >= 0.99 * 1500


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6])
def test_tables_hold_recall_for_every_k(k):
    x, y = _pairs_at_threshold(1000, 40 + k)
    t = embeddings.tables_for(k, 64, 0.9)
    a, b = (embeddings.buckets(v, k, t).reshape(1000, -1) for v in (x, y))
    met = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)])
    assert met >= 0.98


def test_plan_follows_the_number_of_vectors():
    found = [embeddings.plan(n, [64], 0.9)[0] for n in (10, 10**4, 10**6, 10**9)]
    assert found == sorted(found) and found[-1] > found[0]


def test_rotation_is_the_transform():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(x @ embeddings.rotation(32, 9), embeddings.turn(x, 9)) and np.allclose(np.linalg.norm(embeddings.turn(x, 9), axis=1), np.linalg.norm(x, axis=1))


def test_embeddings_of_floats_in_one_hot_group(spark):
    """A third of all rows equal, another third near each other: counted, not dropped."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    rows = [[1.0] * 16] * 60 + (centre + rng.normal(size=(60, 16)) * 0.02).tolist() + rng.normal(size=(60, 16)).tolist() + [None, [], [0.0] * 16]
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").repartition(4)
    links, root = _brute_vectors([(i, v and np.array(v, np.float32).astype(float).tolist()) for i, v in enumerate(rows)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(table, block=16).collect()}
    assert got == {i: (links[i], root[i]) for i in range(len(rows))}


def test_embeddings_empty(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_identification(spark):
    rng = np.random.default_rng(0)
    words = {"aa": ["tra", "lo", "mi", "sen"], "bb": ["kvo", "zum", "ich", "pf"], "cc": ["yy", "wxe", "ooq", "dd"]}
    rows = [(i, " ".join(rng.choice(words[l], 12)), l) for i, l in enumerate(rng.choice(list(words), 300).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id < 200"), 60)
    more = spark.createDataFrame([(1000, None, "x"), (1001, "", "y"), (1002, "123 !?", None), (1003, "tra lo", None)], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r for r in langid.predictions(docs.where("doc_id >= 200"), model).collect()}
    assert np.mean([got[i]["lang_pred"] == l for i, _, l in rows if i >= 200]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predictions(more, model).collect()}
    assert odd == {1000: "und", 1001: "und", 1002: "und", 1003: "aa"}
    assert 0 < (model.weights == 0).mean() < 1


def test_learner_equals_a_plain_one():
    """Follow-the-regularised-leader a coordinate at a time, and the temperature from a scan of its own."""
    rng = np.random.default_rng(4)
    x, y = (rng.random((40, 7)) < 0.4) * rng.random((40, 7)), rng.integers(0, 3, 40)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.05
    z, n = [[0.0] * 3 for _ in range(7)], [[0.0] * 3 for _ in range(7)]
    weight = lambda i, c: 0.0 if abs(z[i][c]) <= l1 else -(z[i][c] - np.sign(z[i][c]) * l1) / ((beta + n[i][c] ** 0.5) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for s in order.permutation(40):
            on = [i for i in range(7) if x[s, i]]
            w = {(i, c): weight(i, c) for i in on for c in range(3)}
            score = [sum(x[s, i] * w[i, c] for i in on) for c in range(3)]
            total = sum(np.exp(v) for v in score)
            for i in on:
                for c in range(3):
                    g = x[s, i] * (np.exp(score[c]) / total - (c == y[s]))
                    z[i][c] += g - ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / alpha * w[i, c]
                    n[i][c] += g * g
    want = np.array([[weight(i, c) for c in range(3)] for i in range(7)])
    got = langid.follow_leader(x, y, 3)
    assert np.allclose(got, want)
    loss = lambda t: -np.mean([np.log(np.exp((x[s] @ want)[y[s]] / t) / np.exp(x[s] @ want / t).sum()) for s in range(40)])
    best = langid.calibrate(x @ want, y)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.exp(np.linspace(np.log(0.05), np.log(20), 121)))


def test_predictions_are_the_formula_and_copies_do_not_train(spark):
    rows = [(0, "tra lo mi", "aa")] * 500 + [(i, f"tra lo mi sen {i}", "aa") for i in range(1, 30)] + [(i, f"kvo zum ich {i}", "bb") for i in range(30, 60)] + [(60, "rare", "cc"), (61, None, "aa"), (62, "x", None)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, lang string, score long, lang_pred string")
    model = langid.train(docs, 20)
    assert model.languages == ["aa", "bb", "cc"] and langid.train(docs, 20, 2).languages == ["aa", "bb"]
    got = langid.predictions(docs, model).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got[:3] + got[-5:]:
        text = texts[r["doc_id"]]
        if text is None:
            assert (r["lang_pred"], r["score"]) == ("und", 1.0)
            continue
        n = langid.counts(text)
        x = np.log(1 + n) * model.idf
        p = np.append(x / np.linalg.norm(x), 1.0) @ model.weights / model.temperature
        p = np.exp(p) / np.exp(p).sum()
        assert r["lang_pred"] == model.languages[int(p.argmax())] and r["score"] == pytest.approx(p.max(), rel=1e-5)


def test_language_identification_without_labels(spark):
    docs = cases.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predictions(docs, langid.train(docs)).collect()} == {"und"}
    assert langid.predictions(cases.empty(spark), langid.train(cases.empty(spark))).count() == 0


def test_preferences(spark):
    turns = [(1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, True, 1, "assistant", "yes"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "no"), (1, False, 2, "user", None),
             (2, True, 0, "user", "x"), (2, False, 0, "user", "x"), (2, False, 1, "assistant", "more"), (3, True, 0, "assistant", ""), (4, True, 0, "user", "s"), (4, False, 0, "user", "s")]
    table = spark.createDataFrame([(*t, "e", 1) for t in turns], "pair_id long, chosen boolean, turn long, role string, text string, side string, cut int")
    got = {r["pair_id"]: r for r in preferences.preference_pairs(table).collect()}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["n_prompt_turns"] == 1 and one["complete"]
    assert one["chosen"] == "<|assistant|>\nyes<|end|>\n" and one["rejected"] == "<|assistant|>\nno<|end|>\n<|user|>\n<|end|>\n"
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["yes<|end|>\n"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_mask"]] == ["no<|end|>\n"]
    assert (got[2]["chosen"], got[2]["rejected"]) == ("", "<|assistant|>\nmore<|end|>\n")
    assert not got[3]["complete"] and got[3]["prompt"] == "" and got[3]["chosen"] == "<|assistant|>\n<|end|>\n"
    assert got[4]["chosen"] == got[4]["rejected"] == "" and got[4]["n_prompt_turns"] == 1
    odd = [(5, True, 0, "user", "q"), (5, False, 0, "user", "q"), (5, True, None, "assistant", "end"), (6, True, None, "user", "a"), (6, False, None, "user", "a"), (None, True, 0, "user", "lost")]
    got = {r["pair_id"]: r for r in preferences.preference_pairs(spark.createDataFrame(odd, "pair_id long, chosen boolean, turn int, role string, text string")).collect()}
    assert got.keys() == {5, 6} and got[5]["prompt"] == "<|user|>\nq<|end|>\n" and got[5]["chosen"] == "<|assistant|>\nend<|end|>\n" and got[5]["rejected"] == ""
    assert got[6]["prompt"] == "<|user|>\na<|end|>\n" and got[6]["chosen"] == ""
    assert preferences.preference_pairs(table.limit(0)).count() == 0
