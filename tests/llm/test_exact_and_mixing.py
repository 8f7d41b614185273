import numpy as np
import pytest
from brute import sha, words
from pyspark.sql import functions as F
from shared import docs, duck  # noqa: F401

from tessera.llm import exact_dedup, mixing, packing
from tessera.llm.registry import OP8_SQL, OP10_SQL

ROWS = [(5, "a  b"), (3, "a b"), (3, "a b"), (None, "a\tb"), (7, None), (6, ""), (9, " a b"), (None, "alone"),
        (11, "x" * 50_000), (12, "a b c"), (13, "A b")]


def test_exact_dedup_groups(docs):
    got = exact_dedup.exact_dedup(docs(ROWS)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    ab = by[sha("a b")]
    assert len(ab) == 4 and all(r.keep_id == 3 and r.group_size == 4 for r in ab)
    assert sum(r.kept for r in ab) == 1 and [r.doc_id for r in ab if r.kept] == [3]
    assert {r.keep_id for r in by[sha("")]} == {6}
    lone = by[sha("alone")][0]
    assert lone.kept and lone.keep_id is None and lone.group_size == 1
    assert len(by[sha(" a b")]) == 1


@pytest.mark.parametrize("support", [0.9, 0.2, 0.001])
def test_exact_dedup_same_for_any_support(docs, duck, support):
    rows = [(i, f"text {i % 7 if i % 3 else 0}") for i in range(200)]
    df = docs(rows)
    cols, want = duck(OP10_SQL, documents=df.select("doc_id", "text"))
    got = exact_dedup.exact_dedup(df, support=support).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_keep_first_keeps_columns_and_one_row(docs):
    df = docs(ROWS)
    got = exact_dedup.keep_first(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(map(str, [3, 6, 9, None, 11, 12, 13]))


def test_exact_dedup_runs_no_python(docs, capsys):
    exact_dedup.exact_dedup(docs(ROWS)).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "Arrow"))


def test_empty_tables(docs):
    none = docs([])
    assert exact_dedup.exact_dedup(none).collect() == []
    assert exact_dedup.keep_first(none).collect() == []
    assert mixing.systematic_mix(none).collect() == []
    assert mixing.mixed_documents(none).collect() == []
    assert packing.pack(none).collect() == []


def _sources():
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for source, n in (("b", 400), ("a", 60), ("c", 5), (None, 120), ("Z", 30), ("é", 80)):
        for _ in range(n):
            rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))), source))
            i += 1
    return rows


def test_mixing_matches_sql_and_targets(docs, duck):
    df = docs(_sources())
    got = mixing.systematic_mix(df).collect()
    cols, want = duck(OP8_SQL, documents=df.select("doc_id", "text", "source"))
    want = {r[cols.index("doc_id")]: dict(zip(cols, r)) for r in want}
    taken = {}
    for r in got:
        w = want[r.doc_id]
        assert (r["size"], r.source_size, r.copies, r.taken) == (w["size"], w["source_size"], w["copies"], w["taken"])
        assert r.target == pytest.approx(w["target"])
        assert 0 <= r.copies <= 3
        t = taken.setdefault(r.source, [0, r.target, r.source_size])
        t[0] += r.taken
    total = sum(t[2] for t in taken.values())
    assert sum(t[1] for t in taken.values()) == pytest.approx(total)
    for words_taken, target, size in taken.values():
        assert target <= 3 * size + 1e-9
        assert abs(words_taken - target) <= 62


def test_mixing_reruns_agree_and_emits_copies(docs):
    df = docs(_sources())
    a, b = (sorted(map(str, mixing.systematic_mix(df.repartition(k)).collect())) for k in (2, 7))
    assert a == b
    mix = {r.doc_id: r.copies for r in mixing.systematic_mix(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in mix.items() if c}


def test_mixing_edge_rows(docs):
    got = mixing.systematic_mix(docs([(None, None, None), (1, "", "a"), (2, "x y", "a"), (2, "x y", "a")])).collect()
    assert len(got) == 4
    assert sum(r.taken for r in got if r.source == "a") in (2, 4, 6)
    assert all(r.taken == 0 for r in got if r["size"] == 0)


def test_mixed_documents_tells_null_ids_from_null_sources(docs):
    """Same words under id null, source "1" and under id 1, source null."""
    df = docs([(None, "x y", "1"), (1, "x y", None), (2, "z", "1"), (3, "x y z", None)])
    mix = {(r.doc_id, r.source): r.copies for r in mixing.systematic_mix(df).collect() if r.copies}
    out = mixing.mixed_documents(df).groupBy("doc_id", "source").count().collect()
    assert {(r.doc_id, r.source): r["count"] for r in out} == mix and len(mix) >= 3


def _best_padding(lengths, k):
    """Least padded size with k buckets, by trying all boundaries."""
    from itertools import combinations
    pads = sorted(set(lengths))
    return min(sum(min(p for p in (*c, pads[-1]) if p >= n) for n in lengths)
               for c in combinations(pads[:-1], min(k, len(pads)) - 1))


@pytest.mark.parametrize("seed", range(4))
def test_optimal_bounds(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 14, 40).tolist()
    pads, counts = zip(*sorted((n, lengths.count(n)) for n in set(lengths)))
    bounds = packing.optimal_bounds(list(pads), list(counts), 3)
    assert len(bounds) == 3 and bounds[-1] == max(lengths)
    assert sum(min(b for b in bounds if b >= n) for n in lengths) == _best_padding(lengths, 3)


def test_rungs_hold_and_stay_few(spark):
    df = spark.range(0, 300_000, 7).select(F.col("id").alias("n"), packing.rung(F.col("id")).alias("r"))
    assert df.filter("r < n or (n > 1 and r > n * 1.02)").count() == 0
    assert df.select("r").distinct().count() < 1024 + 128 * 9


def test_packing(docs):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(n))) for i, n in enumerate(rng.geometric(0.02, 600))]
    rows += [(None, None), (7000, ""), (7001, " ".join(["w"] * 3000)), (0, rows[0][1])]
    got = packing.pack(docs(rows), budget=512, n_buckets=4).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.padded_len
        batches.setdefault((r.bucket, r.batch_in_bucket), []).append(r)
    pads = {r.bucket: r.padded_len for r in got}
    full = {b: max(k for c, k in batches if c == b) for b in pads}
    for (bucket, k), members in batches.items():
        per = max(1, 512 // pads[bucket])
        assert sorted(m.slot for m in members) == list(range(len(members)))
        assert len(members) == per or (k == full[bucket] and len(members) < per)
    lengths = [len(words(t)) for _, t in rows]
    pad_one = max(lengths) * len(lengths)
    assert sum(r.padded_len for r in got) < pad_one / 4
