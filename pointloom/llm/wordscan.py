"""Words of many texts at once: positions, hashes and runs, by array operations over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from pointloom.llm.common import mix

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}
_SALT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            each = np.full(size, base, np.uint64)
            each[0] = 1
            _powers[name] = np.multiply.accumulate(each)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which any stretch's hash follows; one entry more than bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SALT[data] * powers(len(data))[0], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches start..end; equal contents have equal hashes wherever they lie."""
    down = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters (after lower-casing), digits and all bytes of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its document, and the first word of each document (one entry more than documents)."""
    low = LOWER[data]
    inside = WORD[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    return stretch_hash(prefix_hash(low), start, end), np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` hashes in a row, across documents too; fewer entries by width - 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(_BASE) + hashes[i : i + n]
    return mix(out)


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` values, the position of its smallest; the leftmost of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = values[:n].copy(), np.arange(n)
    for i in range(1, width):
        less = values[i : i + n] < best
        best[less] = values[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    return at
