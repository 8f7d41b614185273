import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from shared import docs, duck  # noqa: F401

from tessera.llm import fim
from tessera.llm.registry import OP13_SQL, op13_digests

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 500, 40_000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 30, n)
    units, ends = fim.SkipList(widths), np.concatenate(([0], np.cumsum(widths)))
    ranks = range(n + 1) if n <= 500 else [0, 1, n // 3, n - 1, n]
    assert [units.place(r) for r in ranks] == ends[list(ranks)].tolist()
    for bad in (-1, n + 1):
        with pytest.raises(IndexError):
            units.place(bad)
    if n == 40_000:
        steps = [len(lane[0]) for lane in units.lanes]
        assert len(steps) >= 6 and all(b < 0.4 * a for a, b in zip(steps, steps[1:]) if a > 200)


def test_units_are_those_of_the_pattern():
    for text in ("", " ", "a", " a", "a ", "\ta \n b\r\n", "é ü\x1c😀  x\x00y ", "a\xa0b c "):
        assert fim.unit_widths(text).tolist() == [len(u) for u in UNIT.findall(text)]


TEXTS = ["", None, " ", "\n\t ", "one", "one two three", " lead and trail ", "é😀 ñandú  x", "a <P> b", "x<S>", "<M>",
         "ends with <", "ends with <S", "<P", "S> P> M>", "w " * 50_000, "<" * 9, "a\x00b c"]


def brute(doc_id, text):
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(u), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_brute_force(docs, spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 6)] + [(None, "no id here"), (7, "same id"), (7, "same id"), (-5, "neg a b")]
    out = fim.fill_in_middle(docs(rows).repartition(3))
    got = [tuple(r) for r in out.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(got, key=key) == sorted((brute(*r) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    back = out.withColumn("text", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back) == \
        sorted((i is None, i or 0, t or "") for i, t in rows)
    assert fim.fill_in_middle(docs([])).collect() == []


def test_rates(docs, spark):
    rows = docs([(k, "a b c d") for k in range(2000)])
    forms = {r.form: r["count"] for r in fim.fill_in_middle(rows, rate=90, spm=30).groupBy("form").count().collect()}
    assert 100 < forms["plain"] < 300 and 420 < forms["spm"] < 660
    assert {r.form for r in fim.fill_in_middle(rows, rate=0).collect()} == {"plain"}


def test_sql_twin(docs, duck):
    rows = [(k, t) for k, t in enumerate(t for t in TEXTS * 4 if t is None or "\x00" not in t)]
    df = docs(rows)
    out = op13_digests(df)
    cols, want = duck(OP13_SQL, documents=df)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in out.collect()))) == sorted(map(str, want))
