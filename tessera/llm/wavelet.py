"""Token ids as wavelet matrices, one compressed file per shard.

A wavelet matrix stores a sequence of ids as one bit plane for each bit of
the largest id, highest first; each plane is followed by a stable partition
of the sequence by that bit.  With a running count of ones for every 512
bits, access, counting and finding the k-th occurrence of an id take one step
per plane and never unpack the shard.

Shard layout (little endian): magic ``WMX1``; tokens u64; documents u32;
planes u8; three zero bytes; document ids i64; tokens per document u32;
zeros per plane u64; then for each plane the counts of ones before every 512
bits (u32) and the bits (u64 words).
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import stage_path

from .common import stage
from .prefix import prefix_sum

MAGIC = b"WMX1"
SHARD_TOKENS = 1 << 20
#: Bytes of texts that are encoded at a time.
SLICE_BYTES = 6 << 20
_BLOCK = 512
#: Places that decoding moves at a time.
_STEP = 1 << 15


class WaveletMatrix:
    """A shard opened from its bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.n, docs, self.planes = struct.unpack_from("<QIB", data, 4)
        at = 20

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out
        self.doc_ids = take("<i8", docs)
        self.lengths = take("<u4", docs)
        self.zeros = take("<u8", self.planes).astype(np.int64)
        blocks, words = -(-self.n // _BLOCK) + 1, -(-self.n // 64)
        self.ones, self.bits = [], []
        for _ in range(self.planes):
            self.ones.append(take("<u4", blocks))
            self.bits.append(take("<u8", words))

    def _rank1(self, plane: int, pos: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        words = self.bits[plane]
        block = pos // _BLOCK
        out = self.ones[plane][block].astype(np.int64)
        word, last = block * (_BLOCK // 64), pos // 64
        for k in range(_BLOCK // 64):
            whole = word + k < last
            if not whole.any():
                break
            out[whole] += np.bitwise_count(words[(word + k)[whole]])
        rest = (pos % 64).astype(np.uint64)
        cut = rest > 0
        low = (np.uint64(1) << rest[cut]) - np.uint64(1)
        out[cut] += np.bitwise_count(words[last[cut]] & low)
        return out

    def _bit(self, plane: int, pos: np.ndarray) -> np.ndarray:
        return (self.bits[plane][pos // 64] >> (pos % 64).astype(np.uint64) & np.uint64(1)).astype(bool)

    def access(self, pos) -> np.ndarray:
        """Ids at the positions."""
        pos = np.atleast_1d(np.asarray(pos, dtype=np.int64))
        out = np.zeros(len(pos), np.int64)
        for p in range(self.planes):
            one = self._bit(p, pos)
            ones = self._rank1(p, pos)
            out = out << 1 | one
            pos = np.where(one, self.zeros[p] + ones, pos - ones)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        ends = np.array([lo, hi], dtype=np.int64)
        if token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            ones = self._rank1(p, ends)
            ends = self.zeros[p] + ones if token >> (self.planes - 1 - p) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` occurs at positions lo to hi-1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, plane: int, one: bool, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) one or zero of a plane, by halving."""
        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (lo + 1 < hi).any():
            mid = (lo + hi) // 2
            before = self._rank1(plane, mid)
            before = before if one else mid - before
            down = before > k
            hi, lo = np.where(down, mid, hi), np.where(down, lo, mid)
        return lo

    def find(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Positions of occurrences ``first`` to ``last``-1 (default: all)."""
        start, end = self._range(token, 0, self.n)
        pos = np.arange(start, end, dtype=np.int64)[first:last]
        for p in range(self.planes - 1, -1, -1):
            one = bool(token >> (self.planes - 1 - p) & 1)
            pos = self._select(p, one, pos - self.zeros[p] if one else pos)
        return pos

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane up, a
        cache's worth of places at a time."""
        out = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            one = np.unpackbits(self.bits[p].view(np.uint8), bitorder="little", count=self.n).view(bool)
            a, b = 0, int(self.zeros[p])
            out[b:] |= out.dtype.type(1 << (self.planes - 1 - p))
            up = np.empty_like(out)
            for lo in range(0, self.n, _STEP):
                here, to = one[lo:lo + _STEP], up[lo:lo + _STEP]
                ones, zeros = np.flatnonzero(here), np.flatnonzero(~here)
                to[ones], to[zeros] = out[b:b + len(ones)], out[a:a + len(zeros)]
                a, b = a + len(zeros), b + len(ones)
            out = up
        return out


def encode_shard(doc_ids, lengths, ids: np.ndarray) -> bytes:
    """The bytes of a shard holding ``ids`` (all documents one after another)."""
    n = len(ids)
    planes = max(1, int(ids.max()).bit_length()) if n else 1
    seq = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, body = [], []
    for p in range(planes):
        one = (seq & seq.dtype.type(1 << (planes - 1 - p))) != 0
        words = np.zeros(-(-n // 64), "<u8")
        words.view(np.uint8)[:-(-n // 8)] = np.packbits(one, bitorder="little")
        counts = np.zeros(-(-n // _BLOCK) + 1, "<u4")
        per = np.bitwise_count(words)
        per = np.append(per, np.zeros(-len(per) % (_BLOCK // 64), per.dtype)).reshape(-1, _BLOCK // 64)
        counts[1:] = np.cumsum(per.sum(axis=1, dtype=np.int64))[:len(counts) - 1]
        body += [counts.tobytes(), words.tobytes()]
        zeros.append(n - int(np.count_nonzero(one)))
        if p + 1 < planes:
            seq = np.concatenate([seq.compress(~one), seq.compress(one)])
    return MAGIC + struct.pack("<QIB3x", n, len(doc_ids), planes) + np.asarray(doc_ids, "<i8").tobytes() \
        + np.asarray(lengths, "<u4").tobytes() + np.array(zeros, "<u8").tobytes() + b"".join(body)


def _worker_cache() -> dict:
    """Lives as long as the Python worker, over tasks."""
    return sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker")).__dict__


#: Byte-level alphabet for the letters of the short way below: their UTF-8
#: bytes as the vocabulary spells them (bytes from 0xA1 on stand for
#: themselves, 0x80-0xA0 for U+0122-U+0142, 0xAD for U+0143).
_SPELT = {c: "".join(chr(b if b > 0xA0 and b != 0xAD else 0x143 if b == 0xAD else 0x122 + b - 0x80)
                     for b in chr(c).encode()) for c in range(0xC0, 0x100)}
_LATIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")


def _lowered(texts: pa.StringArray) -> pa.StringArray:
    """Lower case, the same as the tokenizer's, of texts within Latin-1 that
    hold no ``<|``; others as they are."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    special = pc.match_substring(texts, "<|")
    beyond = np.flatnonzero(data >= 0xC4)  # first bytes of code points from U+0100 on
    if not len(beyond) and not pc.any(special).as_py():
        return pc.utf8_lower(texts)
    whole = special.to_numpy(zero_copy_only=False).copy()
    whole[np.searchsorted(offsets - offsets[0], beyond, side="right") - 1] = True
    return pc.if_else(pa.array(whole), texts, pc.utf8_lower(texts))


class PieceEncoder:
    """Ids (u32, little endian, as bytes) of texts by a tokenizer file.

    The tokenizer drops white space and never merges across it, so texts are
    cut at U+0020 and U+000A, a whole batch at once, and each different piece of
    a batch is looked up or encoded once; the ids of short pieces are
    remembered while there is room.  ``latin`` is set for lower-casing byte-level vocabularies that
    split letters from punctuation: then a word of Latin-1 letters goes
    straight to the library's merge model, a third of the work; anything else
    takes the library's whole way.  Special tokens are recognised by their
    ``<|``.
    """

    REMEMBER = 800_000
    LONGEST = 64
    MARKS = ".,;:!?%$&*#@^~|+=-_/\\\"()[]{}<>"

    def __init__(self, vocabulary: str, latin: bool = True):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model, self.latin = self.tokenizer.model, latin
        self.known: dict[bytes, bytes] = {}

    def _whole(self, piece: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids
        return array("I", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        word = piece.rstrip(self.MARKS) if self.latin else ""
        if not _LATIN.fullmatch(word):
            return self._whole(piece)
        if len(word) == len(piece):
            return self._word(word)
        # marks are apart from the letters before them, which are often known
        return self._part(word, self._word) + self._part(piece[len(word):], self._whole)

    def _part(self, part: str, encode) -> bytes:
        key = part.encode()
        ids = self.known.get(key)
        if ids is None:
            ids = encode(part)
            if len(self.known) < self.REMEMBER and len(key) <= self.LONGEST:
                self.known[key] = ids
        return ids

    def _word(self, letters: str) -> bytes:
        spelt = letters.lower()
        if not spelt.isascii():
            spelt = spelt.translate(_SPELT)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def batch(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), one after another, and how many
        each has."""
        pieces = pc.split_pattern(pc.replace_substring(_lowered(texts) if self.latin else texts, "\n", " "), " ")
        cuts = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        places = np.frombuffer(coded.dictionary.buffers()[1], np.int32, len(coded.dictionary) + 1).tolist()
        spelt = (coded.dictionary.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        different = [spelt[a:b] for a, b in zip(places, places[1:])]
        known = self.known
        found = list(map(known.get, different))
        if None in found:
            # words come back by the Zipf law: what is met first is what pays
            # to remember, later newcomers mostly stay alone
            room = self.REMEMBER - len(known)
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = ids = self._piece(different[k].decode())
                    if room > 0 and len(different[k]) <= self.LONGEST:
                        known[different[k]] = ids
                        room -= 1
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        pool, starts = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes, dtype=np.int64) - sizes
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        kind = np.int32 if max(ends[-1], len(pool)) < 1 << 31 else np.int64
        at = np.repeat((starts[which] - ends[:-1]).astype(kind), n) + np.arange(ends[-1], dtype=kind)
        return pool[at], np.diff(ends[cuts - cuts[0]])


_SHARD = "part int, seq int, n_tokens long, shard binary"


def _shards(vocabulary: str, end_id: int, shard_tokens: int):
    def run(batches):
        cache = _worker_cache()
        encode = cache.get(vocabulary)
        if encode is None:
            encode = cache[vocabulary] = PieceEncoder(vocabulary)
        part, seq = None, 0
        ids, lengths, tokens, held = [], [], [], 0

        def flush():
            nonlocal seq, ids, lengths, tokens, held
            blob = encode_shard(ids, lengths, np.concatenate(tokens))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()),
                 pa.array([blob], pa.binary())], names=["part", "seq", "n_tokens", "shard"])
            seq += 1
            ids, lengths, tokens, held = [], [], [], 0
            return out

        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            size = np.cumsum(pc.binary_length(texts).to_numpy())
            lo = 0
            while lo < len(texts):  # some megabytes of whole texts at a time
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
                flat, n = encode.batch(texts.slice(lo, hi - lo))
                flat = np.insert(flat, np.cumsum(n), end_id)
                ends = np.cumsum(n + 1)
                for p, i, a, b in zip(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].to_pylist(),
                                      (ends - n - 1).tolist(), ends.tolist()):
                    if p != part:
                        if ids:
                            yield flush()
                        part, seq = p, 0
                    ids.append(NO_ID if i is None else i)
                    lengths.append(b - a)
                    tokens.append(flat[a:b])
                    held += b - a
                    if held >= shard_tokens:
                        yield flush()
                lo = hi
        if ids:
            yield flush()
    return run


#: Stands for a null id in a shard.
NO_ID = -(1 << 63)


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2,
                 shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs`` in ascending order of their ids as shards of up to
    about ``shard_tokens`` ids, cut between documents and between ranges of
    ids, one file each, under ``path``; (part, seq) orders the shards.

    Null and empty texts hold the end id alone; null ids come first; repeated
    rows are written as often as they occur, next to each other; an empty
    table writes no shard.  A document longer than ``shard_tokens`` makes one
    shard of its own size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # ranges of ids from the id column alone, so the texts are read once
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)))
    bounds = F.array(*[F.lit(int(e)).cast("long") for e in edges])
    part = F.size(F.filter(bounds, lambda e: e <= F.col("doc_id"))) if edges else F.lit(0)
    (rows.select(F.when(F.col("doc_id").isNull(), -1).otherwise(part).alias("part"), "doc_id", "text")
     .repartition("part").sortWithinPartitions("part", "doc_id", F.xxhash64("text"))
     .mapInArrow(_shards(vocabulary, end_id, shard_tokens), _SHARD)
     .write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path))


def _documents(of_ids, kind):
    """Rows (part, seq, doc_id, local, n_tokens, value) of all documents of
    shards; ``of_ids`` makes the value from a document's ids (u32)."""
    names = ["part", "seq", "doc_id", "local", "n_tokens", "value"]

    def run(batches):
        for batch in batches:
            for part, seq, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                m = WaveletMatrix(shard.as_py())
                ids = memoryview(m.decode().astype("<u4")).cast("B")
                n = m.lengths.astype(np.int64)
                ends = np.cumsum(n)
                for lo in range(0, len(n), 512):
                    size = n[lo:lo + 512]
                    begin = ends[lo:lo + 512] - size
                    value = [of_ids(ids[4 * a:4 * (a + k)]) for a, k in zip(begin.tolist(), size.tolist())]
                    doc = m.doc_ids[lo:lo + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n[lo:lo + 512]), part, np.int32)),
                         pa.array(np.full(len(n[lo:lo + 512]), seq, np.int32)),
                         pa.array(doc, mask=doc == NO_ID), pa.array(begin), pa.array(size), pa.array(value, kind)],
                        names=names)
    return run


def _with_starts(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all shards before a row's one, and of the
    documents before it in the shard.  Totals, not shards, are moved."""
    totals = stage(shards.select("part", "seq", "n_tokens").withColumn("all", F.lit(0)), "shards")
    starts = prefix_sum(totals, ["all"], ["part"], ["seq"], ["seq"], "n_tokens", "upto").select(
        "part", "seq", (F.col("upto") - F.col("n_tokens")).alias("shard_start"))
    return rows.join(starts, ["part", "seq"]).withColumn("start", F.col("shard_start") + F.col("local"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (u32 little endian) from the shards
    under ``path``; ``start`` counts the ids of all documents before."""
    shards = spark.read.schema(_SHARD).parquet(path)
    rows = shards.select("part", "seq", "shard").mapInArrow(
        _documents(bytes, pa.binary()), "part int, seq int, doc_id long, local long, n_tokens long, value binary")
    return _with_starts(rows, shards).select("doc_id", "start", "n_tokens", F.col("value").alias("ids"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_documents`, with ``ids_crc32`` in place of the ids."""
    shards = spark.read.schema(_SHARD).parquet(path)
    rows = shards.select("part", "seq", "shard").mapInArrow(
        _documents(zlib.crc32, pa.int64()), "part int, seq int, doc_id long, local long, n_tokens long, value long")
    return _with_starts(rows, shards).select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``doc_id, place``: every occurrence of an id, by select on the bit
    planes; the shards are not decoded."""
    def run(batches):
        for batch in batches:
            for shard in batch.column(0):
                m = WaveletMatrix(shard.as_py())
                pos = m.find(token)
                ends = np.cumsum(m.lengths, dtype=np.int64)
                doc = np.searchsorted(ends, pos, side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if i == NO_ID else int(i) for i in m.doc_ids[doc]], pa.int64()),
                     pa.array(pos - (ends[doc] - m.lengths[doc]))], names=["doc_id", "place"])
    return spark.read.schema(_SHARD).parquet(path).select("shard").mapInArrow(run, "doc_id long, place long")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``part, seq, n``: how often an id occurs in each shard, by rank."""
    def run(batches):
        for batch in batches:
            n = [WaveletMatrix(s.as_py()).count(token) for s in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())],
                                             names=["part", "seq", "n"])
    return spark.read.schema(_SHARD).parquet(path).select("part", "seq", "shard") \
        .mapInArrow(run, "part int, seq int, n long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, **kw) -> DataFrame:
    """Writes ``docs`` as shards in the shared folder and reads the
    checksums back from the files."""
    spark = docs.sparkSession
    path = stage_path(spark, "llm-wavelet")
    write_shards(docs, path, vocabulary, end_id, **kw)
    return read_checksums(spark, path)
