"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words.

A worker hashes the windows of a chunk of documents (some million words) in
one rolling pass and keeps each distinct hash of the chunk once, with the
place of its first window.  Sorted by hash, cut into buckets of the hash
range and packed as byte planes, that is what gets shuffled: a window that
occurs in a third of all documents costs one entry a chunk.  The task that
holds a bucket sees every chunk's entries of its hashes, so it knows which
windows occur again elsewhere, and answers each chunk with their places.
Places of a chunk are merged into maximal intervals per document, which are
then taken out of the texts.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .words import WordHashes, mix64

WIDTH = 35
CHUNK_WORDS = 1 << 20
#: Odd, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_ENTRIES, _DOCS, _LOCAL, _FOUND = 0, 1, 2, 3
_MESSAGE = "bucket int, chunk long, kind int, payload binary"
_SPANS = "doc_id long, text_hash long, spans binary"


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` word hashes.  Prefix sums of
    ``w[j] * B^-j`` give any run's sum by one difference; a factor ``B^i``
    makes it independent of the place.  All modulo 2^64."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    inverse = np.full(len(words), pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    upto = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * np.cumprod(inverse), out=upto[1:])
    power = np.full(n, _BASE, dtype=np.uint64)
    power[0] = 1
    return mix64((upto[width:] - upto[:n]) * np.cumprod(power))


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Byte planes of unsigned integers, only as many as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return width, np.ascontiguousarray(raw.T).tobytes()


def _unplanes(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return raw.view("<u8").reshape(-1), at + n * width


def _pack(single: np.ndarray, places: np.ndarray, multi: np.ndarray) -> bytes:
    """Sorted hashes met once in the chunk with their places, and sorted
    hashes met several times, whose places the chunk answers itself."""
    parts = [_planes(np.diff(single, prepend=np.uint64(0))), _planes(places),
             _planes(np.diff(multi, prepend=np.uint64(0)))]
    return struct.pack("<IIBBB", len(single), len(multi), *(w for w, _ in parts)) \
        + b"".join(p for _, p in parts)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, a, b, c = struct.unpack_from("<IIBBB", data)
    single, at = _unplanes(data, 11, n, a)
    places, at = _unplanes(data, at, n, b)
    multi, _ = _unplanes(data, at, m, c)
    return np.cumsum(single, dtype=np.uint64), places, np.cumsum(multi, dtype=np.uint64)


def _messages(width: int, bits: int, chunk_words: int):
    def chunk_messages(chunk, ids, hashes, words):
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.concatenate(words) if words else np.empty(0, np.uint64)
        ends = np.cumsum(lengths)
        starts = np.ones(len(flat), bool)  # where a window fits into its document
        for k in np.flatnonzero(lengths):
            starts[max(ends[k] - width + 1, ends[k] - lengths[k]):ends[k]] = False
        h = window_hashes(flat, width)
        at = np.flatnonzero(starts[:len(h)])
        h = h[at]
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        again = np.append(~first[1:], False) if len(h) else first
        alone = first & ~again
        yield -1, chunk, _DOCS, struct.pack("<I", len(ids)) + lengths.astype("<i8").tobytes() \
            + np.array(ids, dtype="<i8").tobytes() + np.array(hashes, dtype="<i8").tobytes()
        local = np.sort(at[~alone])
        if len(local):
            yield -1, chunk, _LOCAL, local.astype("<u4").tobytes()
        single, places, multi = h[alone], at[alone].astype(np.uint64), h[first & again]
        cuts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        cut_s = np.concatenate(([0], np.searchsorted(single, cuts), [len(single)]))
        cut_m = np.concatenate(([0], np.searchsorted(multi, cuts), [len(multi)]))
        for b in range(1 << bits):
            if cut_s[b + 1] > cut_s[b] or cut_m[b + 1] > cut_m[b]:
                s = slice(cut_s[b], cut_s[b + 1])
                yield b, chunk, _ENTRIES, _pack(single[s], places[s], multi[cut_m[b]:cut_m[b + 1]])

    def run(batches):
        from pyspark import TaskContext
        remembered, part, n_chunks = WordHashes(), TaskContext.get().partitionId(), 0
        ids, hashes, words, held = [], [], [], 0

        def flush():
            nonlocal n_chunks, ids, hashes, words, held
            rows = list(chunk_messages((part << 32) + n_chunks, ids, hashes, words))
            n_chunks += 1
            ids, hashes, words, held = [], [], [], 0
            return _batch(rows, _MESSAGE_SCHEMA)

        for batch in batches:
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = (text.as_py() or b"").split()
                if len(own) >= width:
                    ids.append(i)
                    hashes.append(h)
                    words.append(remembered.of(own))
                    held += len(own)
                    if held >= chunk_words:
                        yield flush()
        if ids:
            yield flush()
    return run


_MESSAGE_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()),
                             ("kind", pa.int32()), ("payload", pa.binary())])
_SPANS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("spans", pa.binary())])


def _batch(rows, schema):
    cols = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _runs(batches, key):
    """(key, rows) of neighbouring rows with one key."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != last:
                yield last, rows
                rows = []
            last = row[key]
            rows.append(row)
    if rows:
        yield last, rows


def _answer(batches):
    """Per bucket: which entries' hashes are held by more than one chunk, or
    several times by one."""
    for bucket, rows in _runs(batches, "bucket"):
        if bucket < 0:
            yield _batch([(r["bucket"], r["chunk"], r["kind"], r["payload"]) for r in rows], _MESSAGE_SCHEMA)
            continue
        hashes, places, owner = [], [], []
        for k, r in enumerate(rows):
            single, at, multi = _unpack(r["payload"])
            hashes += [single, multi]
            places += [at.astype(np.uint32), np.zeros(len(multi), np.uint32)]
            owner += [np.full(len(single), k, np.int32), np.full(len(multi), -1, np.int32)]
        h, at, own = np.concatenate(hashes), np.concatenate(places), np.concatenate(owner)
        order = np.argsort(h)
        h, at, own = h[order], at[order], own[order]
        same = h[1:] == h[:-1]
        found = (np.append(same, False) | np.append(False, same)) & (own >= 0)
        at, own = at[found], own[found]
        order = np.argsort(own, kind="stable")
        at, own = at[order], own[order]
        cut = np.searchsorted(own, np.arange(len(rows) + 1))
        out = [(bucket, r["chunk"], _FOUND, at[cut[k]:cut[k + 1]].astype("<u4").tobytes())
               for k, r in enumerate(rows) if cut[k + 1] > cut[k]]
        if out:
            yield _batch(out, _MESSAGE_SCHEMA)


def intervals(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals [from, to) covered by windows at sorted ``starts``."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > width)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + width], 1)


def _merge(width: int):
    def run(batches):
        for _, rows in _runs(batches, "chunk"):
            docs = next(r["payload"] for r in rows if r["kind"] == _DOCS)
            places = [np.frombuffer(r["payload"], "<u4") for r in rows if r["kind"] != _DOCS]
            if not places:
                continue
            at = np.sort(np.concatenate(places)).astype(np.int64)
            n = struct.unpack_from("<I", docs)[0]
            lengths, ids, hashes = (np.frombuffer(docs, "<i8", n, 4 + 8 * n * k) for k in range(3))
            ends = np.cumsum(lengths)
            cut = np.searchsorted(at, np.append(0, ends))
            out = [(int(ids[k]), int(hashes[k]),
                    intervals(at[cut[k]:cut[k + 1]] - (ends[k] - lengths[k]), width).astype("<i8").tobytes())
                   for k in range(n) if cut[k + 1] > cut[k]]
            yield _batch(out, _SPANS_SCHEMA)
    return run


def _buckets(docs: DataFrame) -> int:
    """Bits of the bucket number: a layout choice, from the plan's size
    estimate, that keeps a bucket's entries in a task's memory."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(16, max(8, (size // (1 << 20)).bit_length()))


def repeated_spans(docs: DataFrame, width: int = WIDTH, chunk_words: int = CHUNK_WORDS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, spans`` of every document with a window that
    starts anywhere else too; ``spans`` are int64 pairs [from, to) of word
    numbers.  Documents shorter than ``width`` words have none."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),
                        F.xxhash64(F.col(id_col), F.col(text_col)).alias("text_hash"),
                        F.col(text_col).cast("binary").alias("text"))
    sent = keyed.mapInArrow(_messages(width, _buckets(docs), chunk_words), _MESSAGE)
    # a chunk's own notes travel with it; entries meet in their bucket
    met = (sent.withColumn("to", F.when(F.col("bucket") < 0, F.col("chunk")).otherwise(F.col("bucket")))
           .repartition("to").sortWithinPartitions("bucket", "to")
           .select("bucket", "chunk", "kind", "payload").mapInArrow(_answer, _MESSAGE))
    back = met.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merge(width), _SPANS)
    return back.dropDuplicates(["doc_id", "text_hash"])


def _remove(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("n_removed", pa.int64()), ("kept_text", pa.string())])
    for batch in batches:
        out = []
        for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = (text.as_py() or b"").split()
            n = len(words)
            for a, b in reversed(np.frombuffer(spans or b"", "<i8").reshape(-1, 2)):
                del words[a:b]
            out.append((i, n, n - len(words), b" ".join(words)))
        yield _batch(out, schema)


#: Spans up to this many bytes are broadcast to the texts; beyond it both
#: sides are shuffled on the document's key.
BROADCAST_BYTES = 32 << 20


def remove_repeats(docs: DataFrame, width: int = WIDTH, chunk_words: int = CHUNK_WORDS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text``.

    A word goes when a window of ``width`` words covers it whose sequence
    also starts anywhere else, in the same document or another; windows are
    judged on the input.  Kept words are joined by one space.

    * Null and empty texts, and texts of fewer than ``width`` words, lose
      nothing; a text that is one repeated passage keeps the empty text.
    * Repeated rows repeat each other's windows, so all of them lose every
      window; a null id stays null.
    * An empty table gives an empty result; other columns are ignored.
    """
    spans = stage(repeated_spans(docs, width, chunk_words, id_col, text_col), "spans")
    total = spans.agg(F.sum(F.length("spans") + 64)).first()[0] or 0
    if total <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"),
                        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),
                        F.xxhash64(F.col(id_col), F.col(text_col)).alias("text_hash"))
    return (keyed.join(spans, ["doc_id", "text_hash"], "left").select("id", "text", "spans")
            .mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string"))
