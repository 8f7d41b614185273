"""Edge rows from the fixture notes: empty/short texts, missing titles,
duplicate passages, queries without qrels, absent domains, zero reference
loss."""
import pytest
from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.operators import dedup, dro, mining, mixing


def test_short_and_underscore_texts(spark):
    train = spark.createDataFrame([(1, ""), (2, "a"), (3, "abc"), (4, "我爱北京")], "id long, query string")
    test = spark.createDataFrame([(10, "___"), (11, "abc"), (12, "我 爱 北京")], "tid long, query string")
    m = {(r.id, r.tid) for r in dedup.contamination_matches(train, test, ["id"], ["tid"]).collect()}
    # the underscore-only test query is skipped; short texts hash as one shingle
    assert (3, 11) in m and (4, 12) in m and all(t != 10 for _, t in m)


def test_duplicate_passage_under_two_ids_first_wins(spark):
    psg = "array<struct<_id:string,title:string,text:string>>"
    g = spark.createDataFrame(
        [(0, [("d1", None, "same")], [("d2", "", "other")]), (1, [("d9", None, "same")], [])],
        f"row_idx long, positive_passages {psg}, negative_passages {psg}")
    corp = {r.text: (r.corpus_idx, r._id) for r in C.corpus_from_groups(g).collect()}
    assert corp == {"same": (0, "d1"), "other": (1, "d2")}
    q = sorted((r.row_idx, r.corpus_idx) for r in C.qrels_from_groups(g, C.corpus_from_groups(g)).collect())
    assert q == [(0, 0), (1, 0)]


def test_query_without_positives_keeps_empty_arrays(spark):
    queries = spark.createDataFrame([("q1", "hello"), ("q2", "orphan")], "_id string, text string")
    corpus = spark.createDataFrame([("p1", "T", "passage")], "_id string, title string, text string")
    pos = spark.createDataFrame([("q1", "p1", 0)], "query_id string, docid string, pos int")
    neg = spark.createDataFrame([], "query_id string, docid string, pos int")
    got = {r.query_id: r for r in mining.assemble_groups(queries, pos, neg, corpus).collect()}
    assert [p.docid for p in got["q1"].positive_passages] == ["p1"]
    assert got["q2"].positive_passages == [] and got["q2"].negative_passages == []


def test_absent_domain_and_zero_reference_loss(spark):
    rows = spark.createDataFrame(
        [("r", 1, 0, "a", 1.0, 0.0), ("r", 1, 0, "a", 3.0, 2.0), ("r", 2, 0, "b", 2.0, 1.0)],
        "run_id string, step long, micro long, domain string, loss double, ref_loss double")
    p = {(r.step, r.loss): r.proxy for r in dro.proxy_loss(rows, True, True).collect()}
    # step 1: ref normalised by the batch L1 norm (2): 0 -> below 1e-4 -> divide by 1
    assert p[(1, 1.0)] == pytest.approx(1.0) and p[(1, 3.0)] == pytest.approx(1.0)
    g = {(r.step, r.domain): r.grad for r in
         dro.group_gradient(dro.proxy_loss(rows), ["a", "b", "c"], 2).collect()}
    assert g[(1, "b")] == 0.0 and g[(1, "c")] == 0.0 and g[(1, "a")] == pytest.approx(1.0)


def test_negative_sampling_counts(spark):
    run = spark.createDataFrame([(1, d, d, 0) for d in range(1, 8)] + [(2, 9, 3, 1)],
                                "query_id long, doc_id long, rank int, rel int")
    got = mining.sample_hard_negatives(run, (2, 100), 3, 1).groupBy("query_id").count().collect()
    # query 1: ranks 3..7 are candidates -> 3 sampled; query 2: its only row is a positive
    assert {r.query_id: r["count"] for r in got} == {1: 3}


def test_mixing_weights_zero_missing_negative(spark):
    rows = spark.createDataFrame([(d, i) for d in "abc" for i in range(4)], "domain string, id long")
    got = mixing.interleave(rows, {"a": 0.0, "b": 9.0, "c": 1.0}, 1, "all_exhausted").collect()
    assert {r.domain for r in got} == {"b", "c"}
    assert {r.id for r in got if r.domain == "c"} == {0, 1, 2, 3}
    for bad in ({"a": 1.0, "b": 1.0}, {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}, {"a": 0.0, "b": 0.0, "c": 0.0},
                {"a": -1.0, "b": 1.0, "c": 1.0}):
        with pytest.raises(ValueError):
            mixing.interleave(rows, bad, 1)


def test_mixing_without_shuffle_keeps_id_order(spark):
    rows = spark.createDataFrame([(d, i) for d in "ab" for i in (7, 3, 9, 1)], "domain string, id long")
    got = mixing.interleave(rows, None, 1, shuffle=False).orderBy("slot").collect()
    assert [(r.domain, r.id) for r in got] == [("a", 1), ("b", 1), ("a", 3), ("b", 3), ("a", 7), ("b", 7), ("a", 9)]


def test_simhash_batch_equals_plain_votes(spark):
    import hashlib

    import numpy as np

    from tessera.functions import simhash as S

    def plain(s):
        grams = [s[i:i + 4] for i in range(max(len(s) - 3, 1))]
        votes = [0] * 64
        for g in grams:
            h = int.from_bytes(hashlib.md5(g.encode()).digest()[8:], "big")
            for j in range(64):
                votes[j] += h >> j & 1
        u = sum(1 << j for j in range(64) if votes[j] * 2 > len(grams))
        return u - (1 << 64) if u >> 63 else u
    texts = ["", "a", "abcd", "abcde" * 50, "éüñ" * 30, "\U0001F600x" * 9, "z" * 5000, "我爱北京天安门"]
    assert S.fingerprints(texts).tolist() == S.fingerprints(texts, at_once=64).tolist() == [plain(t) for t in texts]
    memory = S._ShingleBits()
    assert S.fingerprints(texts, memory).tolist() == S.fingerprints(texts, memory).tolist()
    assert (np.diff(memory.keys.astype(object)) > 0).all()


def test_join_small_measures_bytes_too(spark):
    from tessera.session import fits_broadcast, join_small
    rows = [(i, "x" * 100, [1.0] * 50, [["a"], None], {"k": "v"}, (1, "y")) for i in range(100)]
    small = spark.createDataFrame(rows, "k long, t string, a array<double>, n array<array<string>>, m map<string,string>, "
                                        "s struct<x:int,y:string>")
    assert fits_broadcast(small) and not fits_broadcast(small, max_rows=99) and not fits_broadcast(small, max_bytes=50_000)
    assert fits_broadcast(small, max_bytes=100_000)
    big = spark.range(200).withColumnRenamed("id", "k")
    for bound in (1, 1 << 20):
        out = join_small(big, small, "k", max_bytes=bound)
        assert out.count() == 100
        # the planner's own choice for such a small table may be a broadcast too; the hint is what is measured
        assert ("ResolvedHint" in out._jdf.queryExecution().analyzed().toString()) == (bound > 1)


def test_entry_survives_a_package_that_is_missing(monkeypatch):
    import importlib

    import __spark_entry__ as entry
    real = importlib.import_module

    def without(name, *a):
        if name == "tessera.llm.registry":
            raise ModuleNotFoundError("No module named 'public_tokenizers'", name="public_tokenizers")
        return real(name, *a)
    monkeypatch.setattr(entry.importlib, "import_module", without)
    with pytest.warns(UserWarning, match="public_tokenizers"):
        assert "near_dup_docs" in entry.queries()
