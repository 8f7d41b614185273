"""An n-gram trie of order 2 in Elias-Fano levels.

Level 1 holds the words (as rising numbers, one Elias-Fano sequence), the
quantised probability of each and the quantised weight with which it backs
off as a context.  A monotone pointer sequence gives each context its range
of level 2, which holds the words that follow it: their numbers rise inside a
range, and with the context's number times the number of words added the
whole level is one rising sequence again.  A query searches the successor of
its word inside its context's range.

All arrays are views into one buffer, which may be a mapped file; nothing is
unpacked on opening.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

MAGIC = b"EFT2"
#: Codes of one unit of log10: a probability p is round(-log10(p) * STEP).
STEP = 2048
ABSENT = 0xFFFF
_BLOCK = 512
_ONE = np.uint64(1)


def code(p: np.ndarray) -> np.ndarray:
    """Quantised probabilities, 16 bits."""
    return np.minimum(np.rint(-np.log10(p) * STEP), ABSENT - 1).astype(np.uint16)


def value(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (codes.astype(np.float64) / -STEP)


class EliasFano:
    """A sequence of unsigned integers that never falls.

    The low bits of every value lie packed side by side; the high parts are
    gaps in unary, one set bit for a value, with a count of set bits before
    every 512.
    """

    def __init__(self, data, at: int = 0):
        self.n, self.low_bits, upper = struct.unpack_from("<QQQ", data, at)
        at += 24

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out
        self.low = take("<u8", -(-self.n * self.low_bits // 64) + 1)
        self.upper = take("<u8", upper)
        self.ones = take("<u8", -(-upper // (_BLOCK // 64)) + 1)
        self.end = at

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = min(63, max(0, (top // n).bit_length() - 1)) if n else 0
        values = values.astype(np.uint64)
        low = np.zeros(-(-n * low_bits // 64) + 1, "<u8")
        view, step = low.view(np.uint8), 1 << 16
        for lo in range(0, n if low_bits else 0, step):
            part = values[lo:lo + step, None] >> np.arange(low_bits, dtype=np.uint64) & _ONE
            bits = np.packbits(part.astype(np.uint8).ravel(), bitorder="little")
            view[lo * low_bits // 8:lo * low_bits // 8 + len(bits)] = bits
        high = (values >> np.uint64(low_bits)).astype(np.int64) if n else np.empty(0, np.int64)
        size = n + (int(high[-1]) if n else 0) + 1
        words = -(-size // 64)
        bits = np.zeros(words * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        upper = np.packbits(bits, bitorder="little").view("<u8")
        per = np.zeros(-(-words // (_BLOCK // 64)) * (_BLOCK // 64), np.int64)
        per[:words] = np.bitwise_count(upper)
        ones = np.concatenate(([0], np.cumsum(per.reshape(-1, _BLOCK // 64).sum(axis=1)))).astype("<u8")
        return struct.pack("<QQQ", n, low_bits, words) + low.tobytes() + upper.tobytes() + ones.tobytes()

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) set or unset bit."""
        before = self.ones.astype(np.int64)
        if not one:
            before = np.arange(len(before), dtype=np.int64) * _BLOCK - before
        block = np.searchsorted(before, k, side="right") - 1
        k = k - before[block]
        word, open_ = block * (_BLOCK // 64), np.ones(len(k), bool)
        for _ in range(_BLOCK // 64 - 1):
            here = self.upper[np.minimum(word, len(self.upper) - 1)]
            held = np.bitwise_count(here if one else ~here).astype(np.int64)
            open_ &= k >= held
            if not open_.any():
                break
            k = np.where(open_, k - held, k)
            word = word + open_
        bits = self.upper[word]
        bits = bits if one else ~bits
        at = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            held = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            up = k >= held
            k = np.where(up, k - held, k)
            bits = np.where(up, bits >> np.uint64(width), bits)
            at = at + up * width
        return at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        out = self.low[word] >> off
        spill = off > 0
        out[spill] |= self.low[word[spill] + 1] << (np.uint64(64) - off[spill])
        return out & np.uint64((1 << self.low_bits) - 1)

    def get(self, i) -> np.ndarray:
        """Values at places."""
        i = np.asarray(i, np.int64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._low(i)

    def _reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first values that are not below ``x``, and the ends
        of the runs of values that share the high part of ``x``: the gaps
        tell the run, halving it the place."""
        last = self.upper.size * 64 - self.n  # unset bits, padding included
        high = x >> np.uint64(self.low_bits)
        lo, end = np.full(len(x), self.n, np.int64), np.full(len(x), self.n, np.int64)
        near = high < np.uint64(last)
        h = high[near].astype(np.int64)
        end[near] = np.minimum(self._select(h, False) - h, self.n)
        start = np.zeros(len(h), np.int64)
        later = h > 0
        start[later] = self._select(h[later] - 1, False) - h[later] + 1
        lo[near] = start
        hi = end.copy()
        low = x & np.uint64((1 << self.low_bits) - 1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            below = self._low(mid) < low[todo]
            lo[todo[below]] = mid[below] + 1
            hi[todo[~below]] = mid[~below]
            todo = todo[lo[todo] < hi[todo]]
        return lo, end

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Places of the first values that are not below ``x``."""
        x = np.asarray(x, np.uint64)
        return self._reach(x)[0] if self.n else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of values (all different), -1 where there is none."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        if self.n:
            at, end = self._reach(x)
            near = np.flatnonzero(at < end)  # the same high part
            hit = near[self._low(at[near]) == (x[near] & np.uint64((1 << self.low_bits) - 1))]
            out[hit] = at[hit]
        return out


def encode_trie(words: np.ndarray, p1: np.ndarray, backoff: np.ndarray, keys: np.ndarray, p2: np.ndarray,
                unknown: int) -> bytes:
    """``words``: sorted numbers; ``p1``, ``backoff``: their codes (``p1`` may
    be ABSENT for a context that is no word); ``keys``: sorted context number
    * number of words + word number; ``p2``: their codes."""
    n = len(words)
    starts = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) * np.uint64(max(n, 1)))
    parts = [EliasFano.encode(words), EliasFano.encode(starts.astype(np.uint64)), EliasFano.encode(keys),
             p1.astype("<u2").tobytes(), backoff.astype("<u2").tobytes(), p2.astype("<u2").tobytes()]
    return MAGIC + struct.pack("<QQHxx", n, len(keys), unknown) + b"".join(parts)


class NgramTrie:
    """A trie in a buffer of :func:`encode_trie`'s bytes."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not an n-gram trie")
        self.n, pairs, self.unknown = struct.unpack_from("<QQH", data, 4)
        self.words = EliasFano(data, 24)
        self.starts = EliasFano(data, self.words.end)
        self.successors = EliasFano(data, self.starts.end)
        at = self.successors.end
        self.p1 = np.frombuffer(data, "<u2", self.n, at)
        self.backoff = np.frombuffer(data, "<u2", self.n, at + 2 * self.n)
        self.p2 = np.frombuffer(data, "<u2", pairs, at + 4 * self.n)

    @classmethod
    def open(cls, path: str) -> "NgramTrie":
        """Maps a file; pages are read when a query touches them."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def places(self, words: np.ndarray) -> np.ndarray:
        """Places of words in level 1, -1 for those that it does not have."""
        return self.words.find(words)

    def follows(self, context: int) -> np.ndarray:
        """Places of the words that follow the context at a place."""
        lo, hi = self.starts.get(np.array([context, context + 1])).astype(np.int64)
        return (self.successors.get(np.arange(lo, hi)) - np.uint64(context * self.n)).astype(np.int64)

    def codes(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the probabilities of words after contexts (places or
        -1): the pair's own where the word is among the context's
        successors, else the context's weight times the word's."""
        known = word >= 0
        out = np.full(len(word), self.unknown, np.int64)
        out[known] = self.p1[word[known]]
        at = np.flatnonzero(context >= 0)
        out[at] += self.backoff[context[at]]
        at = np.flatnonzero((context >= 0) & known)
        place = self.successors.find(context[at].astype(np.uint64) * np.uint64(max(self.n, 1)) + word[at].astype(np.uint64))
        hit = place >= 0
        out[at[hit]] = self.p2[place[hit]]
        return out
