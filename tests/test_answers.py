"""Answers in passages by the token automaton against plain containment."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import answers
from tessera.operators.answers import contained_answers


def _tables(spark, passages, answers):
    return (spark.createDataFrame(passages, "doc_id long, text string, item_id long"),
            spark.createDataFrame(answers, "item_id long, text string, doc_id long"))


def _pairs(df):
    return sorted((r.doc_id, r.item_id) for r in df.collect() if not r.all_passages)


@pytest.mark.parametrize("bound", [1 << 21, 40])
def test_against_plain_containment(spark, bound):
    """Overlapping answers, answers inside answers, and one or many shards."""
    rng = np.random.default_rng(0)
    words = lambda n: [f"w{x}" for x in rng.zipf(1.5, n) % 12]
    passages = [(i, words(rng.integers(0, 60))) for i in range(150)]
    answers = [(i, words(rng.integers(1, 5))) for i in range(80)]
    p, a = _tables(spark, [(i, " ".join(w).upper(), 0) for i, w in passages], [(i, " ".join(w), 0) for i, w in answers])
    want = [(i, j) for i, x in passages for j, y in answers if any(x[k:k + len(y)] == y for k in range(len(x)))]
    assert len(want) > 500
    assert _pairs(contained_answers(p, a, automaton_bytes=bound)) == sorted(want)


def test_tokens_not_letters_are_matched(spark):
    p, a = _tables(spark, [(1, "the cathedral's cat", 0), (2, "Cat.", 0), (3, "", 0), (4, None, 0), (5, "café été", 0)],
                   [(1, "cat", 0), (2, "the", 0), (3, "cat.", 0), (4, "CAFÉ", 0), (5, "cathedral ' s", 0)])
    assert _pairs(contained_answers(p, a)) == [(1, 1), (1, 2), (1, 5), (2, 1), (2, 3), (5, 4)]


def test_repeats_empty_answers_and_empty_tables(spark):
    p, a = _tables(spark, [(1, "a b a b", 0), (1, "a b", 0), (None, "b", 0)], [(7, "a b", 0), (8, "A  B", 0), (9, " ", 0), (10, None, 0)])
    got = [tuple(r) for r in contained_answers(p, a).collect()]
    assert sorted(got, key=str) == sorted([(1, 7, False), (1, 8, False)] * 2 + [(None, 9, True)], key=str)
    assert _pairs(contained_answers(p.limit(0), a)) == []
    assert contained_answers(p, a.limit(0)).collect() == []


def test_no_gram_rows_in_the_plan(spark):
    p, a = _tables(spark, [(1, "a b c", 0)], [(1, "b c", 0)])
    plan = contained_answers(p, a)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1


def test_first_passages_by_hash_without_ranking_all_pairs(spark, monkeypatch):
    import hashlib
    sizes, write = {}, answers.cut_lineage
    monkeypatch.setattr(answers, "cut_lineage", lambda df, name: sizes.setdefault(name, write(df, name)))
    b = spark.createDataFrame([(i,) for i in range(5)], "query_id long")
    d = spark.range(4000).withColumnRenamed("id", "doc_id")
    order = F.md5(F.concat(F.col("query_id").cast("string"), F.lit("|"), F.col("doc_id").cast("string")).cast("binary"))
    got = {(r.query_id, r["rank"]): r.doc_id for r in answers.seeded_run(b, d, order, 20).collect()}
    for q in range(5):
        want = sorted(range(4000), key=lambda x: hashlib.md5(f"{q}|{x}".encode()).hexdigest())[:20]
        assert [got[q, i] for i in range(1, 21)] == want
    assert len(got) == 100 and sizes["low_pairs"].count() < 1000
    # hashes that are not spread: the bound is raised, the rows stay right
    sizes.clear()
    late = F.concat(F.lit("7"), order)
    assert {(r.query_id, r["rank"]): r.doc_id for r in answers.seeded_run(b, d, late, 20).collect()} == got
    sizes.clear()
    few = answers.seeded_run(b, d.limit(7), order, 20)
    assert few.count() == 35
