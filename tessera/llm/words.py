"""Words and their hashes inside Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a worker remembers the hash of; the memory is emptied when full.
REMEMBER = 300_000


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so every bit of the result depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
