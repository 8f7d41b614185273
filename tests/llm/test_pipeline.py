"""The corpus pipeline, stage by stage, against brute force on each stage's
own input."""
from collections import Counter

import pytest
from brute import RUNS, near_components, words
from shared import docs  # noqa: F401

import __spark_entry__
import corpus_pipeline
from tessera.llm import mixing
from tessera.llm.common import read_table, stage

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = read_table(spark, SF, "documents")
    out = [docs]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def _key(r):
    return tuple(r)


def test_stages_are_as_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_all_but_the_last_return_documents(steps):
    for df in steps[1:]:
        assert df.columns == steps[0].columns and dict(df.dtypes) == dict(steps[0].dtypes)


def test_toxic_documents_go(spark, steps):
    before = {r.doc_id for r in steps[0].collect()}
    after = {r.doc_id for r in steps[1].collect()}
    toxic = {r.doc_id for r in read_table(spark, SF, "labels").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in read_table(spark, SF, "labels").filter("toxic = 0").collect()}
    assert len(toxic - after) > 0.8 * len(toxic)
    assert len(clean & after) > 0.99 * len(clean & before)


def test_one_of_equal_texts_stays(steps):
    first = {}
    for r in steps[1].collect():
        text = RUNS.sub(" ", r.text or "")
        if text not in first or r.doc_id < first[text].doc_id:
            first[text] = r
    assert sorted(map(_key, steps[2].collect())) == sorted(map(_key, first.values()))


def test_one_of_each_near_group_stays(steps):
    rows = {r.doc_id: r for r in steps[2].collect()}
    comps, _ = near_components({i: r.text for i, r in rows.items()})
    assert sorted(map(_key, steps[3].collect())) == sorted(_key(rows[i]) for i in set(comps.values()))


def test_mix_takes_the_copies(steps):
    copies = {r.doc_id: r.copies for r in mixing.systematic_mix(steps[3]).collect()}
    got = Counter(r.doc_id for r in steps[4].collect())
    assert got == Counter({i: c for i, c in copies.items() if c})
    texts = {r.doc_id: r.text for r in steps[3].collect()}
    assert all(texts[r.doc_id] == r.text for r in steps[4].collect())


def test_all_documents_are_packed(spark, steps):
    packed = corpus_pipeline.pack_documents(spark, steps[4], SF).collect()
    assert Counter(r.doc_id for r in packed) == Counter(r.doc_id for r in steps[4].collect())
    sizes = {r.doc_id: len(words(r.text)) for r in steps[4].collect()}
    assert all(r.n_tokens == sizes[r.doc_id] <= r.padded_len for r in packed)
    seats = Counter((r.bucket, r.batch_in_bucket, r.slot) for r in packed)
    assert max(seats.values()) == 1


def test_run_equals_its_stages(spark, steps):
    whole = corpus_pipeline.run(spark, SF)
    last = corpus_pipeline.pack_documents(spark, steps[4], SF)
    assert whole.columns == last.columns
    assert Counter((r.doc_id, r.n_tokens, r.padded_len) for r in whole.collect()) == \
        Counter((r.doc_id, r.n_tokens, r.padded_len) for r in last.collect())


def test_stages_take_odd_rows(spark, docs):
    odd = docs([(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x " * 20_000, "a"), (3, "scum", None), (3, "scum", None)])
    df = odd
    for _, step in corpus_pipeline.STAGES[:-1]:
        df = stage(step(spark, df, SF), "test-odd")
        assert df.columns == odd.columns
    corpus_pipeline.pack_documents(spark, df, SF).collect()
    empty = docs([])
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SF).collect() == []
