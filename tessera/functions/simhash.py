"""64-bit SimHash fingerprints and the Hamming-distance helpers around them.

Fingerprint rule (the public behaviour of the common ``simhash`` package with
its default settings):

* lower-case the text and keep only letters and digits,
* features are the 4-character shingles (the whole string when shorter,
  a single empty feature for an empty string), each occurrence weight 1,
* every feature is hashed with MD5; its last 8 bytes, read big-endian, give
  64 bits,
* bit ``j`` of the fingerprint is set iff more than half of the feature
  occurrences have bit ``j`` set.

A batch of texts is hashed as one numpy array inside an Arrow-batched
``pandas_udf``: it is a narrow, partition-local step (no shuffle), so it
scales with the number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHINGLE = 4
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")


def clean_query(col: Column) -> Column:
    """Remove underscores (the test-query normaliser)."""
    return F.regexp_replace(col, "_", "")


def has_chinese(col: Column) -> Column:
    """True when the text holds any CJK unified ideograph.  Word segmentation
    of such text does not change the fingerprint (separators are dropped
    before shingling), so no segmenter is needed."""
    return col.rlike("[\\u4e00-\\u9fff]")


def _hash_bits(grams: list[str]) -> np.ndarray:
    """The 64 bits (highest first) of each feature's hash."""
    digest = b"".join(hashlib.md5(g.encode("utf-8")).digest()[8:] for g in grams)
    return np.unpackbits(np.frombuffer(digest, dtype=np.uint8).reshape(len(grams), 8), axis=1)


# Distinct shingles whose bits a worker remembers (a language has few
# four-character shingles, so most repeat from batch to batch).
_REMEMBER = 1_000_000
_U48, _U32, _U16 = np.uint64(48), np.uint64(32), np.uint64(16)


class _ShingleBits:
    """Hash bits of packed shingles: sorted keys and their rows."""

    def __init__(self):
        self.keys, self.bits = np.empty(0, np.uint64), np.empty((0, 8), np.uint8)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Bits (n x 64) of sorted distinct keys; new ones are hashed once."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        new = keys[self.keys[at] != keys] if len(self.keys) else keys
        if len(new):
            grams = [chr(k >> 48) + chr((k >> 32) & 0xFFFF) + chr((k >> 16) & 0xFFFF) + chr(k & 0xFFFF)
                     for k in new.tolist()]
            bits = np.packbits(_hash_bits(grams), axis=1)
            if len(self.keys) + len(new) > _REMEMBER:
                self.__init__()
                return self.of(keys) if len(new) < len(keys) else np.unpackbits(bits, axis=1)
            order = np.argsort(np.concatenate([self.keys, new]), kind="stable")
            self.keys = np.concatenate([self.keys, new])[order]
            self.bits = np.concatenate([self.bits, bits])[order]
            at = np.searchsorted(self.keys, keys)
        return np.unpackbits(self.bits[at], axis=1)


def _signed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel()


def fingerprints(texts: list[str], memory: _ShingleBits | None = None, at_once: int = 1 << 18) -> np.ndarray:
    """Signed 64-bit SimHash of cleaned texts (lower case, letters and digits
    only).  The code points of a whole batch make one array of packed
    shingles; each distinct one is hashed once, and a document's votes are
    one segment sum.  ``at_once`` shingles bound the memory."""
    memory = memory or _ShingleBits()
    out = np.zeros(len(texts), np.int64)
    points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    short = [k for k, p in enumerate(points) if len(p) < SHINGLE or p.max() >= 65536]
    for k in short:  # one shingle, or characters beyond 16 bits
        n = max(len(texts[k]) - SHINGLE + 1, 1)
        bits = _hash_bits([texts[k][i:i + SHINGLE] for i in range(n)])
        out[k] = _signed((bits.sum(axis=0, dtype=np.int64) * 2 > n)[None, :])[0]
    part, size = [], 0
    for k in [k for k in range(len(texts)) if k not in set(short)] + [None]:
        if k is not None:
            part.append(k)
            size += len(points[k]) - SHINGLE + 1
        if part and (k is None or size >= at_once):
            counts = np.array([len(points[j]) - SHINGLE + 1 for j in part])
            keys = np.concatenate([(c[:-3] << _U48) | (c[1:-2] << _U32) | (c[2:-1] << _U16) | c[3:]
                                   for c in (points[j].astype(np.uint64) for j in part)])
            distinct, at = np.unique(keys, return_inverse=True)
            bits = memory.of(distinct)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            votes = np.zeros((len(part), 64), np.int64)
            for j, (lo, n) in enumerate(zip(starts, counts)):
                for x in range(lo, lo + n, at_once):  # a long text in pieces
                    votes[j] += bits[at[x:min(x + at_once, lo + n)]].sum(axis=0, dtype=np.int64)
            out[part] = _signed(votes * 2 > counts[:, None])
            part, size = [], 0
    return out


def fingerprint_text(text: str | None) -> int | None:
    """Signed 64-bit SimHash of one raw text."""
    return None if text is None else int(fingerprints([_NOT_WORD.sub("", text.lower())])[0])


@F.pandas_udf(T.LongType())
def _simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    memory = _ShingleBits()
    for texts in batches:
        known = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype="Int64")
        out[known] = fingerprints([_NOT_WORD.sub("", t.lower()) for t in texts[known]], memory)
        yield out


def simhash64(text: Column) -> Column:
    """Column function: text -> signed 64-bit SimHash."""
    return _simhash(text)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def block_bounds(n_blocks: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of ``n_blocks`` contiguous bit blocks covering ``bits``.
    Widths differ by at most one; the wider blocks come last."""
    base, extra = divmod(bits, n_blocks)
    out, shift = [], 0
    for i in range(n_blocks):
        width = base + (1 if i >= n_blocks - extra else 0)
        out.append((shift, width))
        shift += width
    return out


def _block(fp: Column, shift: int, width: int) -> Column:
    mask = (1 << width) - 1 if width < 64 else -1
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(mask))


def block_keys(fp: Column, k: int = 2, n_blocks: int | None = None) -> Column:
    """Array of equi-join keys such that two fingerprints within ``k`` bits
    share at least one key (pigeonhole over ``n_blocks`` blocks: they agree
    on at least ``n_blocks - k`` blocks, and every such block combination is
    a key).  Each key is ``struct(combo, key)`` where ``key`` packs the kept
    blocks into one long.  With ``n_blocks = k + 1`` this is the classic
    one-block index; more blocks give longer keys and far fewer false
    candidates on very large inputs."""
    n_blocks = n_blocks or k + 4
    bounds = block_bounds(n_blocks)
    keep = n_blocks - k
    keys = []
    for combo_id, combo in enumerate(combinations(range(n_blocks), keep)):
        packed, offset = F.lit(0).cast("long"), 0
        for b in combo:
            shift, width = bounds[b]
            packed = packed.bitwiseOR(F.shiftleft(_block(fp, shift, width), offset))
            offset += width
        keys.append(F.struct(F.lit(combo_id).alias("combo"), packed.alias("key")))
    return F.array(*keys)


def first_shared_combo(a: Column, b: Column, k: int = 2, n_blocks: int | None = None) -> Column:
    """Index of the first block combination on which ``a`` and ``b`` agree.
    Used to keep each candidate pair once (from its first shared key)
    without a distinct/shuffle."""
    n_blocks = n_blocks or k + 4
    bounds = block_bounds(n_blocks)
    agree = [(_block(a, s, w) == _block(b, s, w)) for s, w in bounds]
    expr = F.lit(None).cast("int")
    combos = list(combinations(range(n_blocks), n_blocks - k))
    for combo_id in reversed(range(len(combos))):
        cond = F.lit(True)
        for blk in combos[combo_id]:
            cond = cond & agree[blk]
        expr = F.when(cond, F.lit(combo_id)).otherwise(expr)
    return expr
