"""Words and their hashes, for use inside Spark tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_CACHE_WORDS = 400_000

U64 = np.uint64
_MIX = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z in lower case; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), U64, len(tokens))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs that depends on their order."""
    x = (a * _MIX[0]) ^ ((b << U64(31)) | (b >> U64(33)))
    x = x * _MIX[1]
    return x ^ (x >> U64(29))


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of n words. A shorter text has one run, all its words; an empty text none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    last = len(hashes) - n + 1
    run = hashes[:last].copy()
    for i in range(1, n):
        run = mix(run, hashes[i : i + last])
    return np.unique(run)
