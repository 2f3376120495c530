"""Rows with every awkward case, and brute-force versions of the operators."""

import base64
import hashlib
import re
import zlib

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rid long, part int, bucket int, size long, items string, words int"
_LINE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of lime"


def texts() -> list[str | None]:
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    long = " ".join(word() for _ in range(9000))
    base = " ".join(word() for _ in range(300))
    edited = base.split()
    edited[100] = "edit"
    out = [None, "", " \t\n", "a", "Grüße aus Köln, où l’été naît", _LINE, _LINE, _LINE + "!", base, " ".join(edited), base, long, long + " tail", "x" * 5000, "12345 67890 !!", "日本語 テスト 🙂"]
    out += [f"{word()} {word()} {_LINE} {word()} {word()}" for _ in range(12)]
    return out


def documents(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or ""), 1, 2, 3, 4, 5, "x", 6) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def repeated(spark):
    """Documents of which some rows come twice, with a null id."""
    docs = documents(spark)
    return docs.unionByName(docs.where("doc_id in (5, 8)")).unionByName(spark.createDataFrame([(None, _LINE, None, None, None, 1, 2, 3, 4, 5, "x", 6)], SCHEMA))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def simhash(text: str | None, width: int = 3) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n: int, linked) -> list[int]:
    """Smallest index of each component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(n)]


def substrings(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    first: dict[bytes, int] = {}
    raw = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in raw:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, list[str]]]:
    window: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for p in range(len(w) - k + 1) if k else ():
            window.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in window}:
            for p in range(len(w) - k + 1):
                if got := window.get(tuple(w[p : p + k])):
                    found |= got
                    hit |= set(range(p, p + k))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def sha1_32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
