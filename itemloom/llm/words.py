"""Words and hashes of texts inside Arrow workers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a worker keeps before it starts afresh.
CACHE_WORDS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, which are separated by the six ASCII white-space characters, as bytes.split does."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, one for each start; none when there are fewer words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _ODD + h[i : len(h) - n + 1 + i]
    return mix(out)
