import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import workflows
from tessera.plans import reweighting

from conftest import SF001

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def _tmp():
    return tempfile.mkdtemp(prefix="tessera-wf-", dir="/tmp")


def _make_encoder():
    import zlib

    def enc(texts):  # nested: shipped to workers by value
        out = np.zeros((len(texts), 32))
        for i, t in enumerate(texts):
            for j in range(max(len(t) - 2, 1)):
                out[i, zlib.crc32(t[j:j + 3].encode()) % 32] += 1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return enc


def test_mine_from_pairs(spark):
    d = _tmp()
    conv = spark.read.parquet(f"{SF001}/conversations.parquet").orderBy("conv_id", "turn").collect()
    lines = []
    for a, b in zip(conv, conv[1:]):
        if a.conv_id == b.conv_id and a.role == "user" and b.role == "assistant":
            lines.append(json.dumps([a.text, b.text]))
    p = os.path.join(d, "pairs.jsonl")
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    out = workflows.mine_from_pairs(spark, p, _make_encoder(), 32, os.path.join(d, "out"), depth=(0, 20),
                                    topk=20, n_sample=4).collect()
    assert len(out) == len(lines)
    for g in out:
        pos = {x.text for x in g.positive_passages}
        assert len(pos) == 1 and len(g.negative_passages) <= 4
        assert not pos & {x.text for x in g.negative_passages}
    assert spark.read.json(os.path.join(d, "out")).count() == len(lines)


def test_decontaminate_files(spark):
    d = _tmp()
    os.makedirs(os.path.join(d, "test"))
    with open(os.path.join(d, "test", "beir.jsonl"), "w") as f:
        f.write(json.dumps({"query_id": "t1", "query": "What is the capital_of France?"}) + "\n")
    train = os.path.join(d, "train.jsonl")
    rows = [{"query_id": "a", "query": "what is the capital of france"},
            {"query_id": "b", "query": "completely different question here", "extra": 1}]
    with open(train, "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    n_clean, n_rep = workflows.decontaminate_files(spark, [train], os.path.join(d, "test"),
                                                   os.path.join(d, "clean"), os.path.join(d, "rep"))
    assert (n_clean, n_rep) == (1, 1)
    kept = [r.value for r in spark.read.text(os.path.join(d, "clean")).collect()]
    assert kept == [json.dumps(rows[1])]
    rep = spark.read.json(os.path.join(d, "rep")).collect()[0]
    assert rep.query_id == "a" and rep.test_dups[0].filename == "beir.jsonl"


def test_group_dro_weights(spark):
    rows = reweighting.loss_rows(spark, SF001)
    cfg = os.path.join(_tmp(), "cfg.json")
    doms = reweighting.domains_of(spark, SF001)
    sizes = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    with open(cfg, "w") as f:
        json.dump({"domain_ids": {x: i for i, x in enumerate(doms)},
                   "domain_weights": {x: 1.0 for x in doms}, "size": sizes,
                   "epoch": {x: 1.0 for x in doms}}, f)
    out = workflows.group_dro_weights(rows, cfg, percents=(40,))
    tabs = {(r.run_id, r.table): json.loads(r.json) for r in out.collect()}
    assert {t for _, t in tabs} == {"curr", "mean", "ema", "top40"}
    for (run, t), doc in tabs.items():
        assert abs(sum(doc["domain_weights"].values()) - 1) < 1e-9
        if t == "top40":
            assert len(doc["domain_ids"]) == 2


def _letters():
    """A tiny encoder: letter counts (a closure travels to the workers)."""
    def encode(texts):
        import numpy as np
        return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype=float)
    return encode


def test_mine_from_qrels(spark):
    from tessera import workflows as W
    q = spark.createDataFrame([("q1", "aaaa"), ("q2", "bbbb"), ("q3", "unjudged")], "_id string, text string")
    c = spark.createDataFrame([(f"d{i}", "", "a" * (i + 1) + "b" * (9 - i)) for i in range(9)],
                              "_id string, title string, text string")
    qrels = spark.createDataFrame([("q1", "d8", 1), ("q1", "d8", 1), ("q2", "d0", 2), ("q2", "gone", 1), ("q2", "d1", 0)],
                                  "query_id string, doc_id string, score int")
    groups, missing = W.mine_from_qrels(spark, q, c, qrels, _letters(), 26, depth=(0, 4), topk=4, n_sample=2)
    got = {r.query_id: r for r in groups.collect()}
    assert set(got) == {"q1", "q2"}
    assert [p.docid for p in got["q1"].positive_passages] == ["d8"]
    assert len(got["q1"].negative_passages) == 2 and "d8" not in [p.docid for p in got["q1"].negative_passages]
    assert [tuple(r) for r in missing.collect()] == [("q2", "gone")]
    with pytest.raises(KeyError):
        W.mine_from_qrels(spark, q.where("_id <> 'q2'"), c, qrels, _letters(), 26)
    with pytest.raises(ValueError):
        W.mine_from_qrels(spark, q, c, qrels, _letters(), 26, depth=(50, 60))


def test_evaluate_answers_resumes(spark):
    from tessera import workflows as W
    store = os.path.join(tempfile.mkdtemp(prefix="tessera-wf-"), "scores")
    c = spark.createDataFrame([("1", "", "zebra aaa"), ("2", "", "bbb Caf\u00e9 bar"), ("3", "", "ccc")],
                              "_id string, title string, text string")
    rows = [("en", "1", "aaa", ["Zebra"]), ("en", "2", "bbb", ["nowhere"]), ("fr", "1", "bbb", ["x", "cafe\u0301"])]
    schema = "lang string, query_id string, text string, answers array<string>"
    q = spark.createDataFrame(rows, schema)
    count = _letters()
    got = {r.lang: (r.accuracy_at_1, r.accuracy_at_3)
           for r in W.evaluate_answers(spark, q, c, count, 26, store, ks=(1, 3)).collect()}
    assert got == {"en": (0.5, 0.5), "fr": (1.0, 1.0)}
    changed = spark.createDataFrame([("en", "1", "aaa", ["none"]), ("de", "1", "ccc", ["ccc"])], schema)
    got = {r.lang: r.accuracy_at_1 for r in W.evaluate_answers(spark, changed, c, count, 26, store, ks=(1, 3)).collect()}
    assert got == {"en": 0.5, "fr": 1.0, "de": 1.0}
    got = {r.lang: r.accuracy_at_1
           for r in W.evaluate_answers(spark, changed, c, count, 26, store, ks=(1, 3), overwrite=True).collect()}
    assert got == {"en": 0.0, "fr": 1.0, "de": 1.0}


def test_hydrate_id_only_groups(spark):
    from tessera.operators import mining
    q = spark.createDataFrame([("1", "Q"), ("2", "R")], "_id string, text string")
    c = spark.createDataFrame([("7", "T", "x"), ("8", None, "y")], "_id string, title string, text string")
    g = spark.createDataFrame([("1", ["8", "7"], ["9", "7"])], "query_id string, positive_ids array<string>, negative_ids array<string>")
    r = mining.hydrate_groups(g, q, c).collect()
    assert len(r) == 1 and r[0]["query"] == "Q"
    assert [tuple(p) for p in r[0].positive_passages] == [("8", "", "y"), ("7", "T", "x")]
    assert [p.docid for p in r[0].negative_passages] == ["7"]


def test_in_batch_loss_across_devices(spark):
    from tessera.functions import vectors as V
    from tessera.operators import losses as L
    q = spark.createDataFrame([(0, 5, 1, [1.0, 0.0], False), (1, 5, 2, [0.0, 1.0], False)],
                              "batch_id long, step long, group_id long, q_vec array<double>, hn_only boolean")
    p = spark.createDataFrame([(0, 5, 1, 0, [1.0, 0.0]), (1, 5, 2, 0, [0.0, 1.0])],
                              "batch_id long, step long, group_id long, pos int, p_vec array<double>")
    own = {r.group_id: r.loss for r in L.in_batch_loss(q, p, 1.0, V.dot).collect()}
    wide = {r.group_id: r.loss for r in L.in_batch_loss(q, p, 1.0, V.dot, across="step").collect()}
    import math
    assert own == {1: 0.0, 2: 0.0}
    assert wide == pytest.approx({1: math.log(1 + math.exp(-1)), 2: math.log(1 + math.exp(-1))})
