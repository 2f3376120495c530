"""Token ids of whole texts with a public tokenizer, fast on long tables.

The tokenizer splits a text at white space before it applies merges, so a text's ids are the ids of its white-space
chunks in a row. Each Python worker keeps the ids of the chunks and of their parts it has met (in two generations of a
bounded size) and gives only new ones to the tokenizers library. Arrow tells the chunks of some texts apart, so Python
sees each different one once a group of texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from pointloom.llm.common import CACHES, flat, pieces

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEPT = 400_000  # entries of each of two generations of the cache
GROUP = 4 << 20  # bytes of text whose chunks are looked up together
#: The split pattern that the vocabulary file itself states.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_made: dict[tuple[str, int], WordIds] = {}


class WordIds:
    """Ids of texts as unsigned 32-bit numbers."""

    def __init__(self, path: str, kept: int | None = None):
        from tokenizers import Tokenizer

        self.kept = kept or KEPT
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}  # chunks as they stand, and their parts in normal form
        self.old: dict[bytes, bytes] = {}

    def _ask(self, parts: list[bytes]) -> None:
        """Gives new parts to the library, many in one text; every part ends with its only word-end token."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(parts).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids] if not len(ids) or ids.max() < len(self.last) else np.zeros(len(ids), bool)) + 1
        if len(ends) == len(parts):
            raw, ends = ids.tobytes(), (ends * 4).tolist()
            self.known.update(zip(parts, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        else:
            for part, found in zip(parts, self.library.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False), strict=True):
                self.known[part] = np.array(found.ids, "<u4").tobytes()

    def _learn(self, chunks: list[bytes]) -> None:
        """Adds the ids of new chunks; what was met before the last change of generation is taken over."""
        old, known, split, new = self.old, self.known, [], []
        for chunk in chunks:
            if (ids := old.get(chunk)) is not None:
                known[chunk] = ids
            elif chunk.isalpha() and chunk.islower():  # small ASCII letters alone are a part
                new.append(chunk)
            else:
                split.append((chunk, [p.encode() for p in PATTERN.findall(chunk.decode().lower() if chunk.isascii() else self.library.normalizer.normalize_str(chunk.decode("utf-8", "replace")))]))
        for part in {p for _, parts in split for p in parts}.difference(known, new):
            if (ids := old.get(part)) is not None:
                known[part] = ids
            else:
                new.append(part)
        for lo in range(0, len(new), 1000):
            self._ask(new[lo : lo + 1000])
        for chunk, parts in split:
            known[chunk] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of different chunks."""
        out = []
        for lo in range(0, len(chunks), self.kept // 4):
            part = chunks[lo : lo + self.kept // 4]
            if len(self.known) > self.kept:
                self.old, self.known = self.known, {}
            found = list(map(self.known.get, part))
            if None in found:
                at = [i for i, ids in enumerate(found) if ids is None]
                missing = [part[i] for i in at]
                self._learn(missing)
                for i, chunk in zip(at, missing, strict=True):
                    found[i] = self.known[chunk]
            out += found
        return out

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as little-endian bytes."""
        return next(self.each(pa.array([text], pa.large_binary()))).tobytes()

    def each(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text of a string column, null as empty.

        Chunks of about GROUP bytes of texts are told apart at once, so each different one is looked up once.
        """
        data, offsets = flat(column)
        texts = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        for lo, hi in pieces(offsets, GROUP):
            lists = pc.ascii_split_whitespace(texts.slice(lo, hi - lo))
            words = lists.flatten().dictionary_encode()
            ids = self._ids(words.dictionary.cast(pa.large_binary()).to_pylist())
            every, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            code = words.indices.to_numpy()
            many, first = size[code], (np.cumsum(size) - size)[code]
            ends = np.concatenate([[0], np.cumsum(many)])
            found = every[np.repeat(first - ends[:-1], many) + np.arange(ends[-1])]
            cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield found[a:b]


def word_ids(path: str, kept: int | None = None) -> WordIds:
    """One per worker process, file and size of cache, until the worker goes on to another operator."""
    CACHES["tokens"] = _made.clear
    key = path, kept or KEPT
    if key not in _made:
        _made[key] = WordIds(path, kept)
    return _made[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
