"""The neighbour graph and the stored index against exact search."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, graph, index, search
from tessera.plans.registry import all_queries
from tessera.session import stage_path

from conftest import SF01


@pytest.fixture(scope="module")
def emb(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    return (e.where(F.col("vec_id") % 5 == 0).select(F.col("vec_id").alias("query_id"), "embedding"),
            e.select(F.col("vec_id").alias("doc_id"), "embedding"))


def _clustered(spark, n=6000, dim=24, seed=0):
    """Far apart groups of unequal size and length, and copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (40, dim))[rng.zipf(1.4, n) % 40] * rng.uniform(0.5, 3, (n, 1)) + rng.normal(0, 0.3, (n, dim))
    x[:n // 3] = x[0]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))],
                                 "doc_id long, embedding array<float>")


def test_graph_recall_in_one_and_in_many_shards(spark):
    docs = _clustered(spark)
    asked = docs.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")
    exact = search.knn(asked, docs, 10)
    for rows in (20_000, 700):
        built = graph.build_graph(docs, shard_rows=rows)
        assert built.changed[-1] < built.changed[0] / 4  # rounds settle
        sizes = [r["count"] for r in built.nodes.groupBy("shard").count().collect()]
        assert max(sizes) < 2 * rows and sum(sizes) == 4001
        assert built.nodes.agg(F.max(F.size("nbrs"))).first()[0] <= graph.DEGREE
        assert ann.recall_at_k(graph.graph_search(asked, built, 10), exact) >= 0.9


def test_query_recall(spark, emb):
    run = all_queries()["knn_graph"].build(spark, SF01)
    exact = search.knn(emb[0].where(F.col("query_id") % 50 == 0), emb[1], 10)
    assert ann.recall_at_k(run, exact) >= 0.9


def test_every_node_can_be_reached(spark, emb):
    built = graph.build_graph(emb[1], degree=2, rounds=1, shard_rows=150)
    for kw in ({}, {"query_bytes": 4096}):
        got = graph.graph_search(emb[0], built, 7, ef=1 << 20, **kw).collect()
        want = search.knn(emb[0], emb[1], 7).collect()
        key = lambda r: (r.query_id, r.rank, r.doc_id)
        assert sorted(map(key, got)) == sorted(map(key, want))
    few = graph.graph_search(emb[0], built, 7, probes=1)
    assert 0 < few.count() <= 7 * emb[0].count()


def test_a_round_shuffles_each_node_once(spark, monkeypatch):
    plans, write = [], graph.cut_lineage

    def noted(df, name):
        if name == "graph_edges":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)
    monkeypatch.setattr(graph, "cut_lineage", noted)
    built = graph.build_graph(_clustered(spark, 900), rounds=3)
    assert len(plans) == len(built.changed) > 1
    assert all(p.count("RepartitionByExpression") == 1 and "Join" not in p and "Generate" not in p for p in plans)
    for r in built.nodes.collect():
        assert r.id not in r.nbrs and len(set(r.nbrs)) == len(r.nbrs) == graph.DEGREE


def test_walks_that_drop_no_node_open_whole_fronts(monkeypatch):
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((3000, 8)), rng.standard_normal((5, 8))
    near = np.full((3000, 3), -1, np.int64)
    near[:2900, 0], near[1:2900, 1] = np.roll(np.arange(2900), 1), np.arange(2899)  # a ring; the rest hangs loose
    near[::7, 2] = rng.integers(0, 2900, len(near[::7]))
    opened = []
    partition = np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda *a, **kw: opened.append(1) or partition(*a, **kw))
    score, place = graph.walk(q, x, near, 1 << 30)
    assert len(opened) < 100  # not four nodes at a time
    entries = {int(v) for v in np.linspace(0, 2999, graph.ENTRIES)}
    assert set(place[0].tolist()) == set(range(2900)) | entries
    assert np.allclose(score, np.take_along_axis(q @ x.T, place, axis=1))


def test_adjacency_is_bounded_and_connected():
    rng = np.random.default_rng(1)
    ids = np.arange(0, 900, 3)
    nbrs = [rng.choice(ids, 5, replace=False).tolist() if i % 7 else None for i in range(300)]
    nbrs[5] = [0, 3, 6]
    for k in range(10, 300):
        nbrs[k] = [*(nbrs[k] or [])[:4], 0]  # all name the first node
    near = graph._adjacency(ids, nbrs, 5)
    assert near.shape[1] <= 2 * 5 + 2
    assert all({(i - 1) % 300, (i + 1) % 300} <= set(near[i].tolist()) for i in range(300))


def test_graph_edges(spark):
    schema = "doc_id long, embedding array<double>"
    none = spark.createDataFrame([], schema)
    ask = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert graph.graph_search(ask, graph.build_graph(none), 3).collect() == []
    docs = spark.createDataFrame([(4, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 2.0]), (8, None)], schema)
    built = graph.build_graph(docs)
    got = graph.graph_search(ask, built, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(2, 1.0), (3, 1.0)]  # copies by their ids
    assert graph.graph_search(ask.limit(0), built, 2).collect() == []


@pytest.mark.parametrize("form", ["flat", "fp16", "sq8", "pq"])
def test_stored_index_equals_search_in_memory(spark, emb, form):
    q, d = emb
    books = ann.pq_books(ann.fit_sample(d), 16, 6) if form == "pq" else None
    path = stage_path(spark, "test-index")
    index.write_index(d, path, form, n_lists=12, books=books)
    read = index.read_index(spark, path)
    want = {"flat": lambda: search.knn(q, d, 5), "fp16": lambda: ann.fp16_search(q, d, 5), "sq8": lambda: ann.sq8_search(q, d, 5),
            "pq": lambda: ann.pq_search(q, d, 5, books=books)}[form]()
    key = lambda r: (r.query_id, r.rank, round(r.score, 9))
    assert sorted(map(key, index.index_search(q, read, 5, n_probe=12).collect())) == sorted(map(key, want.collect()))


def test_rotated_codes_from_disk(spark, emb):
    q, d = emb
    path = stage_path(spark, "test-index")
    index.write_index(d, path, "opq", n_lists=4, n_sub=16, n_bits=6)
    run = index.index_search(q, index.read_index(spark, path), 10, n_probe=4, refine=100, corpus=d)
    assert ann.recall_at_k(run, search.knn(q, d, 10)) >= 0.9


def test_a_probe_opens_its_lists_only(spark, emb):
    q, d = emb
    path = stage_path(spark, "test-index")
    index.write_index(d, path, n_lists=12)
    read = index.read_index(spark, path)
    one = index.index_search(q.where("query_id = 0"), read, 5, n_probe=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    probes = [r.key for r in index.probed(q.where("query_id = 0"), read, 2).collect()]
    assert len(probes) == 2
    files = read.codes.where(F.col("list").isin(probes)).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("list=")[1].split("/")[0] for r in files} == set(map(str, probes))


def test_index_of_nothing_and_unknown_codes(spark, emb):
    path = stage_path(spark, "test-index")
    index.write_index(emb[1].limit(0), path)
    assert index.index_search(emb[0], index.read_index(spark, path), 3).collect() == []
    with pytest.raises(ValueError):
        index.write_index(emb[1], path, "zip")
