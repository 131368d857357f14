"""Word shingles as 64-bit hashes, and MinHash signatures of them (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
#: Words whose hashes a task remembers.
KEPT_WORDS = 1 << 18
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Hash of each word (bytes), computed when first met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (in UTF-8 these bytes stand for nothing else)."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``SIZE``-word shingles; fewer words are one shingle, none give none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, SIZE)
    x = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        x = x * _P + h[k:n - width + 1 + k]
    x ^= x >> np.uint64(32)
    x *= _Q
    x ^= x >> np.uint64(32)
    return np.unique(x)


def hash_family(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2**64 - 1, count, np.uint64))


def minhash(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Signature: for every hash function the upper 32 bits of the least value."""
    a, b = family
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 13):
        part = shingles[at:at + (1 << 13)]
        for k in range(0, len(a), 32):
            values = np.multiply.outer(a[k:k + 32], part)
            values += b[k:k + 32, None]
            np.minimum(least[k:k + 32], values.min(axis=1), out=least[k:k + 32])
    return (least >> np.uint64(32)).astype(np.uint32)
