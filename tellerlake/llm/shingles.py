"""Word shingles and circulant MinHash signatures of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)
_P1, _P2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hash per distinct word, remembered while one batch is worked on."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case, as UTF-8."""
    # bytes.lower and bytes.split touch ASCII only, which is what the pattern means
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _C2
    return x ^ (x >> np.uint64(27))


def shingle_set(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a whole text.

    Fewer words than ``size``: the whole sequence counts as one shingle. No word: empty.
    """
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in found], np.uint64)
    n = min(size, len(h))
    total = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        total = _mix64(total * _C1) + h[k: len(h) - n + 1 + k]
    # a short sequence must not equal the beginning of a longer shingle
    return np.unique(_mix64(total * _C1 + np.uint64(n)))


def set_key(hashes: np.ndarray) -> bytes:
    """128-bit name of a shingle set; equal sets have equal names."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def signature(hashes: np.ndarray, length: int, step: int = 1024) -> np.ndarray:
    """Circulant MinHash: two permutations of a universe of 2^32 make all coordinates.

    The first permutation scatters the set; the second is used ``length`` times, each
    time shifted circularly by one more place, and the least value it gives to the
    set is the coordinate. Both are bijective integer mixers. Work arrays stay at
    ``length * step`` numbers whatever the text's length.
    """
    x = hashes.astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= _M1
    x ^= x >> np.uint32(15)
    x *= _M2
    x ^= x >> np.uint32(16)
    shifts = np.arange(length, dtype=np.uint32)[:, None]
    best = np.full(length, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), step):
        y = x[None, at: at + step] + shifts
        y ^= y >> np.uint32(16)
        y *= _P1
        y ^= y >> np.uint32(13)
        y *= _P2
        y ^= y >> np.uint32(16)
        np.minimum(best, y.min(axis=1), out=best)
    return best


def band_keys(sign: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit key per band of equally many signature coordinates."""
    rows = sign.reshape(bands, -1).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for k in range(rows.shape[1]):
        key = _mix64(key * _C1 + rows[:, k])
    return _mix64(key * _C1).astype(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
