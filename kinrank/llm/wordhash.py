"""Word and shingle hashes of whole texts inside a task (numpy, xxhash)."""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


class _Words(dict):
    """word -> 64-bit hash; remembers up to ``limit`` words of the task."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


class WordHasher:
    """Hashes of the words of a text, A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` act on ASCII letters and on
    ``\\x20 \\x09-\\x0D`` only, which is the word rule of the operators.
    """

    def __init__(self, limit: int = 100_000):
        self._known = _Words(limit)

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self._known.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, in order (empty if too short)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, np.uint64(n), np.uint64)
    for i in range(n):
        total = total * np.uint64(0x100000001B3) + mix(hashes[i:i + count] + np.uint64((i + 1) * _STEP & _MASK))
    return mix(total)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct ``n``-word shingles, sorted; a shorter text is one
    shingle of all its words; no words, no shingles."""
    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes, min(n, len(hashes))))
