import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from shared import docs  # noqa: F401

from tessera.llm import scoring, trie
from tessera.llm.registry import op12_lm_scoring


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 1 << 63), (5, 3), (700, 700), (3000, 10 ** 6), (2000, 1 << 64)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, max(top, 1), n, np.uint64))
    ef = trie.EliasFano(trie.EliasFano.encode(x))
    assert ef.get(np.arange(n)).tolist() == x.tolist()
    ask = np.unique(np.concatenate((x[:300], x[:300] + np.uint64(1), rng.integers(0, 1 << 64, 50, np.uint64),
                                    np.array([0, 1, (1 << 64) - 1], np.uint64))))
    assert ef.successor(ask).tolist() == np.searchsorted(x, ask).tolist()
    apart = np.unique(x)
    ef = trie.EliasFano(trie.EliasFano.encode(apart))
    want = {int(v): k for k, v in enumerate(apart)}
    assert ef.find(ask).tolist() == [want.get(int(a), -1) for a in ask]


def test_hot_high_parts():
    """Many values share one high part, others are far off."""
    x = np.concatenate((np.arange(5000), [1 << 50, (1 << 50) + 1])).astype(np.uint64)
    ef = trie.EliasFano(trie.EliasFano.encode(x))
    ask = np.array([0, 4999, 5000, 1 << 49, 1 << 50, (1 << 50) + 2], np.uint64)
    assert ef.successor(ask).tolist() == np.searchsorted(x, ask).tolist()


def test_trie_from_a_mapped_file(tmp_path):
    rng = np.random.default_rng(0)
    words = np.unique(rng.integers(0, 1 << 63, 500, np.uint64))
    n = len(words)
    keys = np.unique(rng.integers(0, n * n, 3000)).astype(np.uint64)
    p1, backoff, p2 = (rng.integers(0, 60_000, k).astype(np.uint16) for k in (n, n, len(keys)))
    path = tmp_path / "trie"
    path.write_bytes(trie.encode_trie(words, p1, backoff, keys, p2, 777))
    t = trie.NgramTrie.open(str(path))
    assert t.places(words).tolist() == list(range(n)) and t.places(words + np.uint64(1)).max() <= n
    held = {(int(k) // n, int(k) % n): int(c) for k, c in zip(keys, p2)}
    a, b = rng.integers(-1, n, 4000), rng.integers(-1, n, 4000)
    a[:len(keys)], b[:len(keys)] = (keys // np.uint64(n))[:4000], (keys % np.uint64(n))[:4000]
    want = [held.get((v, w), (int(p1[w]) if w >= 0 else 777) + (int(backoff[v]) if v >= 0 else 0))
            for v, w in zip(a.tolist(), b.tolist())]
    assert t.codes(a, b).tolist() == want
    for v in (0, 1, n - 1):
        assert t.follows(v).tolist() == sorted(w for c, w in held if c == v)


def brute(rows, strength=200.0):
    """The model of the docstring with plain dictionaries; its codes."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    learn = [t for t, h in zip(tokens, held) if not h]
    c1 = collections.Counter(w for t in learn for w in t)
    c2 = collections.Counter(p for t in learn for p in zip([None, *t], t))
    n, v = sum(c1.values()), len(c1)
    one = lambda p: int(trie.code(np.array([p]))[0])
    val = lambda c: float(trie.value(np.array([c]))[0])

    def pair(a, b):
        context = len(learn) if a is None else c1[a]
        back, p1 = one(strength / (context + strength)), one((c1[b] + 1) / (n + v + 1))
        if c2[a, b]:
            return one(min(1.0, c2[a, b] * val(back) / strength + val(back) * val(p1)))
        return p1 + (back if context else 0)
    return [(i, h, len(t), sum(c1[w] > 0 for w in t), n, sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t),
             -sum(pair(a, b) for a, b in zip([None, *t], t)) / trie.STEP)
            for (i, _), h, t in zip(rows, held, tokens)]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-9) and abs(g[6] - w[6]) <= 2 * g[2] / trie.STEP * 0.01 + 1e-9, (g, w)


def texts(n):
    rng = np.random.default_rng(5)
    return [(k, " ".join(f"W{x}" if x % 3 else f"w{x}é" for x in rng.zipf(1.4, rng.integers(0, 60)) % 400)) for k in range(n)]


@pytest.mark.parametrize("chunk,shard", [(50, 40), (500, 100_000), (10 ** 6, 300)])
def test_against_brute_force(docs, monkeypatch, chunk, shard):
    """Many chunks and shards, hot contexts dealt over the shards."""
    monkeypatch.setattr(scoring, "SHARD_TOKENS", shard)
    monkeypatch.setattr(scoring, "BUCKET_TOKENS", 700)
    rows = texts(250) + [(None, "no id"), (3, "same id"), (3, "same id"), (900, None), (901, ""), (902, " \t\n"),
                         (903, "the " * 3000), (904, "unheard-of \x1c words"), (905, "Ünheard \x00")]
    same(scoring.held_out_scores(docs(rows).repartition(3), chunk_tokens=chunk).collect(), brute(rows))


def test_edges(docs, spark):
    assert scoring.held_out_scores(docs([])).collect() == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    out = scoring.held_out_scores(docs([(i, "a b") for i in held])).collect()
    assert {tuple(r)[1:] for r in out} == {(True, 3, 0, 0, 0.0, 0.0)}


def test_tries_are_a_model(docs, spark):
    """Every successor range is a distribution with what backs off."""
    rows = texts(200)
    _, blobs = scoring.score_documents(docs(rows), F.lit(True))
    t = trie.NgramTrie(blobs.first().blob)
    known = trie.value(t.p1)[t.p1 != trie.ABSENT]
    assert known.sum() + trie.value(np.array([t.unknown]))[0] == pytest.approx(1, abs=0.01)
    for context in range(0, t.n, 20):
        words = np.flatnonzero(t.p1 != trie.ABSENT)
        p = trie.value(t.codes(np.full(len(words) + 1, context), np.append(words, -1)))
        assert p.sum() == pytest.approx(1, abs=0.01)


def test_held_out_text_is_likelier_than_by_words_alone(spark):
    out = op12_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").agg(
        F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert out.score > out.base
