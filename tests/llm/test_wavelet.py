import zlib

import numpy as np
import public_tokenizers
import pytest
from shared import docs  # noqa: F401
from tokenizers import Tokenizer

from tessera.llm import wavelet
from tessera.session import stage_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (64, 3), (511, 9), (512, 49408), (513, 2), (5000, 1 << 20)])
def test_shard_round_trip(n, top):
    rng = np.random.default_rng(n)
    x = rng.integers(0, top, n).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.encode_shard([7, 9], [n // 2, n - n // 2], x))
    assert m.decode().tolist() == x.tolist()
    assert m.doc_ids.tolist() == [7, 9] and m.lengths.tolist() == [n // 2, n - n // 2]
    if n:
        at = rng.integers(0, n, 50)
        assert m.access(at).tolist() == x[at].tolist()
    for token in {*x[:5].tolist(), 0, top, top + 5}:
        where = np.flatnonzero(x == token)
        assert m.find(token).tolist() == where.tolist()
        assert m.find(token, 1, 3).tolist() == where[1:3].tolist()
        assert m.count(token) == len(where)
        assert m.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()


TEXTS = ["", " ", "a  b", "x<|endoftext|>y <|startoftext|> z", "É́ ΑΣ Σ", " a\tb\nc\x1cd", "don't  we'll",
         "é ́x", "ÀÖßØÿ÷× Ÿ ǅ İ I.", "a.b c,, d!? ..", "x" * 3000, "naïve,café; ÑANDÚ!", "12 345,6", "­ ï"]


def test_pieces_equal_the_whole_tokenizer():
    encode, whole = wavelet.PieceEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    letters = [chr(c) + d for c in range(0x21, 0x180) for d in ("", "a", "é", ".")]
    for _ in range(2):  # the second time from memory
        for t in TEXTS + letters:
            assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_round_trip_query(docs, spark):
    whole = Tokenizer.from_file(VOCABULARY)
    rows = [(10 * k, t) for k, t in enumerate(reversed(TEXTS))] + [(5, None), (None, "no id"), (77, "long " * 20_000)]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for shard_tokens in (100, 1 << 20):
        got = wavelet.round_trip(docs(rows).repartition(3), VOCABULARY, shard_tokens=shard_tokens).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    again = wavelet.round_trip(docs([(1, "a b"), (1, "a b"), (0, "c")]), VOCABULARY).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in again) == [(0, 2), (1, 3), (1, 3)]
    assert wavelet.round_trip(docs([]), VOCABULARY).collect() == []


def test_lookup_in_files(docs, spark):
    path = stage_path(spark, "test-wavelet")
    rows = [(i, "red green " * (i % 4) + "blue") for i in range(50)]
    wavelet.write_shards(docs(rows), path, VOCABULARY, shard_tokens=40)
    red = Tokenizer.from_file(VOCABULARY).encode("red", add_special_tokens=False).ids[0]
    found = wavelet.find_token(spark, path, red).collect()
    assert sorted(map(tuple, found)) == sorted((i, 2 * k) for i, _ in rows for k in range(i % 4))
    counts = wavelet.count_token(spark, path, red).collect()
    assert len(counts) > 2 and sum(r.n for r in counts) == len(found)
    whole = wavelet.read_documents(spark, path).collect()
    assert {r.doc_id: len(r.ids) // 4 for r in whole} == {i: 2 * (i % 4) + 2 for i, _ in rows}
