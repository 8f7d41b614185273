import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import encode
from tessera.plans import library
from tessera.sources import readers


def test_pooling_strategies(spark):
    rows = [(1, 0, [1.0, 0.0], 1, 1), (1, 1, [3.0, 2.0], 1, 1), (1, 2, [9.0, 9.0], 0, 1),
            (1, 0, [0.0, 0.0], 1, 0), (1, 1, [1.0, 2.0], 1, 0), (1, 2, [5.0, 5.0], 0, 0),
            (1, 0, [2.0, 2.0], 1, 2), (1, 1, [2.0, 4.0], 1, 2), (1, 2, [0.0, 0.0], 0, 2)]
    t = spark.createDataFrame(rows, "doc_id long, pos int, vec array<double>, mask int, layer int")
    last = t.where("layer = 1")
    assert encode.pool(last, "mean").first().embedding == [2.0, 1.0]
    assert encode.pool(last, "cls").first().embedding == [1.0, 0.0]
    assert encode.pool(last, "lasttoken").first().embedding == [3.0, 2.0]
    assert encode.pool(last, "lasttoken", left_padded=True).first().embedding == [9.0, 9.0]
    afl = encode.pool(t, "avg_first_last", layer="layer").first().embedding
    assert afl == pytest.approx([(0.5 + 2.0) / 2, (1.0 + 1.0) / 2])
    with pytest.raises(ValueError):
        encode.pool(t, "max")


def test_project_and_encoders(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "_id long, embedding array<double>")
    w = np.array([[1.0, 0.0, 2.0], [0.0, 1.0, 1.0]])
    assert encode.project(df, w, np.array([0.5, 0, 0])).first().embedding == [1.5, 2.0, 4.0]
    docs = spark.createDataFrame([(1, "abc abc"), (2, "")], "_id long, text string")
    e = {r._id: r.embedding for r in encode.hashed_shingle_encoder(docs, dim=16).collect()}
    assert abs(np.linalg.norm(e[1]) - 1) < 1e-6 and len(e[2]) == 16
    got = encode.encode(docs, lambda ts: np.array([[len(t), 1.0] for t in ts]), 2, prompt="q: ")
    assert {r._id: list(r.embedding) for r in got.collect()} == {1: [10.0, 1.0], 2: [3.0, 1.0]}


def test_eval_prompts_and_split(spark):
    df = spark.createDataFrame([("Retrieval", "MSMARCO", ["dev", "test"]), ("STS", "X", ["train"])],
                               "tt string, name string, splits array<string>")
    q, c = TX.eval_prompts(F.col("tt"), F.lit("Find it"), "e5")
    qb, cb = TX.eval_prompts(F.col("tt"), F.lit(None), "bge")
    r = df.select(q.alias("q"), c.alias("c"), qb.alias("qb"), cb.alias("cb"),
                  TX.eval_split(F.col("name"), F.col("splits")).alias("s")).collect()
    assert r[0].q == "Instruct: Find it\nQuery: " and r[0].c == "" and r[1].c == r[1].q
    assert r[0].qb == TX.BGE_QUERY_PROMPT and r[1].qb == "" and r[1].cb == ""
    assert r[0].s == ["dev"] and r[1].s == ["train"]


def test_union_helpers(spark):
    a = spark.createDataFrame([("x",)], "query string")
    b = spark.createDataFrame([("y", 1)], "query string, extra int")
    u = readers.union_test_sets(a, b).orderBy("idx").collect()
    assert [(r.query, r.extra, r.idx) for r in u] == [("x", None, 0), ("y", 1, 1)]
    with pytest.raises(TypeError):
        readers.align_union([a, spark.createDataFrame([(1,)], "query int")])
    m = spark.createDataFrame([("q", ""), ("q2", "because")], "question string, exp string")
    assert [len(r.positive_passages) for r in readers.medmcqa_groups(m).collect()] == [1]
    hits, rej = readers.lookup_ids(spark.createDataFrame([("1",), ("9",)], "_id string"),
                                   spark.createDataFrame([("1", "t")], "_id string, text string"))
    assert hits.count() == 1 and [r._id for r in rej.collect()] == ["9"]


def test_eval_instruction_lookup(spark):
    from tessera.functions import eval_instructions as EI
    tasks = spark.createDataFrame([("STS", "STSB"), ("Retrieval", "trec-covid"), ("Retrieval", "nfcorpus"),
                                   ("Retrieval", "CQADupstackGaming"), ("PairClassification", "Cmnli")],
                                  "task_type string, task_name string")
    got = {r.task_name: r.instruction for r in EI.with_eval_instruction(tasks, spark).collect()}
    assert got["STSB"] == EI.TYPE_INSTRUCTIONS["STS"]
    assert got["trec-covid"] == EI.RETRIEVAL["TRECCOVID"] and got["nfcorpus"] == EI.RETRIEVAL["NFCorpus"]
    assert got["CQADupstackGaming"] == EI.CQADUPSTACK_INSTRUCTION and got["Cmnli"] == EI.RERANKING["Cmnli"]
    bad = spark.createDataFrame([("Retrieval", "Nope")], "task_type string, task_name string")
    with pytest.raises(Exception):
        EI.with_eval_instruction(bad, spark).collect()


def test_stage_tables_are_shared_folder_parquet_and_removable(spark):
    import os
    from tessera.session import cut_lineage, drop_stage_tables, ensure_checkpoint_dir
    t = cut_lineage(spark.range(5), "probe")
    path = t.inputFiles()[0]
    assert ensure_checkpoint_dir(spark).rstrip("/").split(":")[-1] in path and t.count() == 5
    assert drop_stage_tables(spark) >= 1
    assert not os.path.exists(path.replace("file:", ""))


def test_encoded_texts_are_placed_without_a_single_task(spark, monkeypatch):
    def alone(self, n):
        raise AssertionError(f"all rows in {n} tasks")
    monkeypatch.setattr(type(spark.range(0)), "coalesce", alone)
    sf = "/root/testdata/sf0.001"
    got = {r._id: r.place for r in library.encoded_texts(spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = sorted((-len(r.text), str(r.item_id)) for r in texts)
    assert got == {i: k for k, (_, i) in enumerate(want)}


def test_normalised_texts_are_strings_a_few_at_a_time(monkeypatch):
    import unicodedata

    import pyarrow as pa
    from tessera.functions import qa
    texts = ["caf\u00e9 " * 50, None, "plain", "", "e\u0301", "\uac00" * 100] * 40
    held, real = [], unicodedata.normalize
    monkeypatch.setattr(qa, "TEXT_BYTES", 2000)
    monkeypatch.setattr(qa, "pa", type("P", (), {
        "array": staticmethod(lambda x, t: held.append(sum(len(v or "") for v in x)) or pa.array(x, t)),
        "concat_arrays": staticmethod(pa.concat_arrays)}))
    for form in ("NFD", "NFC"):
        want = [t if t is None else real(form, t) for t in texts]
        assert qa.normalized(pa.array(texts), form).to_pylist() == want
        assert qa.normalized(pa.array(texts, pa.large_string()).slice(3, 50), form).to_pylist() == want[3:53]
    assert max(held) < 2500
    assert qa.normalized(pa.array([], pa.string()), "NFD").to_pylist() == []
