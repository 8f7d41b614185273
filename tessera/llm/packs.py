"""Packed arrays as payloads of rows, for stages that move many small
integers: byte planes, so that zeros and repeats of the high bytes vanish,
under zstd."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integer arrays as bytes."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        head.append(struct.pack("<BQ", a.itemsize, len(a)))
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.compress(b"".join(head + body), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    """What :func:`pack` was given."""
    raw = zstandard.decompress(data)
    at, out = 1, []
    sizes = [struct.unpack_from("<BQ", raw, 1 + 9 * k) for k in range(raw[0])]
    at += 9 * len(sizes)
    for width, n in sizes:
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1))
        at += n * width
    return out


def gaps(ascending: np.ndarray) -> np.ndarray:
    """Differences of neighbours; ``np.cumsum`` undoes it."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def runs(batches, key: str):
    """(key, rows) of neighbouring rows with one key."""
    last, rows = None, []
    for b in batches:
        names = b.schema.names
        for k in range(b.num_rows):
            row = {n: b.column(i)[k].as_py() for i, n in enumerate(names)}
            if rows and row[key] != last:
                yield last, rows
                rows = []
            last = row[key]
            rows.append(row)
    if rows:
        yield last, rows


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and, for every position, the number of its one."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(first) - 1
    return ordered[first], number
