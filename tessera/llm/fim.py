"""Fill-in-the-middle: a document is cut twice between units and its parts
are put in another order behind marks.

A unit is a word with the white space before it (or the white space that
ends a text).  The cuts are ranks of units, the parts are slices of code
points; an indexable skip list over the units leads from one to the other.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def unit_widths(text: str) -> np.ndarray:
    """Code points of every unit of a text."""
    ends = np.fromiter((m.end() for m in _WORD.finditer(text)), np.int64)
    if len(text) > (ends[-1] if len(ends) else 0):
        ends = np.append(ends, len(text))
    return np.diff(ends, prepend=0)


class SkipList:
    """Indexable skip list over a text's units.

    Node i stands for the boundary before unit i; every node is in the lowest
    lane, a quarter of a lane's nodes in the lane above.  A link carries the
    units and the code points that it passes, so going down from the highest
    lane and adding up widths reaches the boundary at any rank of units in a
    logarithmic number of steps, and tells its place in code points.
    """

    _heights = np.empty(0, np.int8)

    def __init__(self, widths: np.ndarray):
        n = len(widths)
        self.n = n
        places = np.concatenate(([0], np.cumsum(widths)))
        height = self._towers(n)
        node = np.arange(n + 1)
        self.lanes, level = [], 0
        below = None
        while True:
            self.lanes.append((np.diff(node), np.diff(places[node]), below))
            level += 1
            up = np.concatenate(([0], 1 + np.flatnonzero(height[node[1:] - 1] >= level)))
            if len(up) == 1:
                break
            below, node = up, node[up]

    @classmethod
    def _towers(cls, n: int) -> np.ndarray:
        """Lanes above the lowest that nodes 1 to n reach: a fixed hash of
        the node's number, so the same text always makes the same list."""
        if n > len(cls._heights):
            x = np.arange(1, max(n, 1024) * 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            lowest = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
            cls._heights = (lowest // 2).astype(np.int8)
        return cls._heights[:n]

    def place(self, rank: int) -> int:
        """Code points before the unit of this rank (0 to n)."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        at = units = points = 0
        for unit_width, point_width, below in reversed(self.lanes):
            while at < len(unit_width) and units + unit_width[at] <= rank:
                units += int(unit_width[at])
                points += int(point_width[at])
                at += 1
            if below is not None:
                at = int(below[at])
        return points


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 of a document; a null id counts as no digits."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    return struct.unpack(">4I", hashlib.sha256(text.encode()).digest()[:16])


def arrange(text: str, doc_id, seed: int = 42, rate: int = 50, spm: int = 80):
    """``n, form, prefix_chars, middle_chars, output`` of one document."""
    widths = unit_widths(text)
    n = len(widths)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    units = SkipList(widths)
    a, b = sorted((units.place(h1 % (n + 1)), units.place(h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                     ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
#: Characters of texts in one Arrow batch on the way out.
BATCH_CHARS = 4 << 20


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars,
    output``.  ``rate`` percent of the documents are rearranged, ``spm``
    percent of those with the suffix first; both, and the two cuts, follow
    from a hash of ``seed`` and the id, so every run gives the same rows.

    * A null or empty text is plain with an empty output and ``n`` 0; a text
      that holds a mark is plain, so :func:`restored` is always exact.
    * Equal cuts make an empty middle; a text of white space alone is one
      unit.  Nothing is cut inside a unit or a code point, however long.
    * Repeated rows and ids are each rearranged, the same way for the same
      id; a null id draws as an id without digits and stays null.
    * An empty table gives an empty result; other columns are ignored.

    No shuffle; a task holds one batch of texts and one text's skip list.
    """
    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append((doc_id, *arrange(text.as_py() or "", doc_id, seed, rate, spm)))
                held += len(rows[-1][-1])
                if held >= BATCH_CHARS:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.  No mark begins with the end of
    another, so the first occurrence of each is the mark that was put there."""
    def parts(marks):
        rest, found = output.substr(F.lit(len(marks[0]) + 1), F.length(output)), []
        for mark in marks[1:]:
            found.append(F.substring_index(rest, mark, 1))
            rest = rest.substr(F.length(found[-1]) + len(mark) + 1, F.length(output))
        return *found, rest
    prefix, suffix, middle = parts((PREFIX, SUFFIX, MIDDLE))
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts((SUFFIX, PREFIX, MIDDLE))
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
