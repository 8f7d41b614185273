import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, search

from conftest import SF001


def _emb(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    return (e.select(F.col("vec_id").alias("query_id"), "embedding"),
            e.select(F.col("vec_id").alias("doc_id"), "embedding"))


def _brute(spark, k, ignore=False):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").toPandas()
    m = np.vstack(e.embedding.map(np.asarray)).astype(np.float64)
    ids = e.vec_id.to_numpy()
    s = m @ m.T
    out = {}
    for i, q in enumerate(ids):
        cand = [(-s[i, j], ids[j]) for j in range(len(ids)) if not (ignore and ids[j] == q)]
        out[q] = [d for _, d in sorted(cand)[:k]]
    return out


def _as_lists(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    return got


def test_knn_broadcast_and_blocked_paths_equal_brute_force(spark):
    q, c = _emb(spark)
    want = _brute(spark, 5, ignore=True)
    assert _as_lists(search.knn(q, c, 5, ignore_identical=True)) == want
    # force the blocked (cogroup) path with a tiny broadcast budget
    assert _as_lists(search.knn(q, c, 5, ignore_identical=True, broadcast_bytes=1024)) == want


def test_knn_corpus_smaller_than_k_is_not_padded(spark):
    q, c = _emb(spark)
    small = c.limit(3)
    res = search.knn(q.limit(2), small, 10).collect()
    assert len(res) == 6 and all(r.doc_id != -1 for r in res)


def test_zero_vector_cosine_is_finite(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "doc_id long, embedding array<double>")
    res = search.knn(q, c, 2, "cos_sim").collect()
    assert all(r.score == 0.0 for r in res) and [r.doc_id for r in res] == [7, 8]


def test_tied_scores_break_by_doc_id(spark):
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(i, [1.0]) for i in (9, 3, 5, 4)], "doc_id long, embedding array<double>")
    assert [r.doc_id for r in search.knn(q, c, 3).orderBy("rank").collect()] == [3, 4, 5]


def test_unknown_score_function(spark):
    q, c = _emb(spark)
    with pytest.raises(ValueError):
        search.knn(q, c, 3, "l2")


def test_approximate_search_recall(spark):
    """At the defaults the queries use, on the larger table."""
    from conftest import SF01
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    c = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    exact = search.knn(q, c, 10).cache()
    refine = {"refine": 160}
    runs = {"lsh": ann.lsh_search(q, c, 10), "ivf": ann.ivf_search(q, c, 10), "fp16": ann.fp16_search(q, c, 10),
            "sq8": ann.sq8_search(q, c, 10), "pca": ann.pca_search(q, c, 10, 32, **refine),
            "pq": ann.pq_search(q, c, 10, n_sub=16, **refine), "opq": ann.opq_search(q, c, 10, n_sub=16, **refine)}
    recall = {name: ann.recall_at_k(run, exact) for name, run in runs.items()}
    assert min(recall.values()) >= 0.9, recall


def test_codes_are_small_and_fits_are_bounded(spark):
    q, c = _emb(spark)
    bits = search.binary_codes(c).first()
    assert len(bits["payload"]) == 8
    sample = ann.fit_sample(c, 50)
    assert sample.shape == (50, 64) and (sample == ann.fit_sample(c.repartition(3), 50)).all()
    books = ann.pq_books(sample, 8, 3)
    assert all(b.shape == (8, 8) for b in books)
    coder = ann.ProductCodes("<f8", books)
    x = sample[:7]
    table, codes = coder.queries([r.tobytes() for r in x]), coder.encode(sample)
    assert np.allclose(coder.score(table, codes), x @ coder.decode(codes).T)


def test_rotations_keep_products(spark):
    x = np.random.default_rng(0).normal(size=(40, 16))
    for out in (16, 24):
        turn, _ = ann.learned_rotation(x, 4, 2, out, rounds=2)
        assert np.allclose((x @ turn) @ (x @ turn).T, x @ x.T)


def test_pca_is_centred_and_scaled(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * [5, 2, 1, 0.1] + [10, 0, -3, 1]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    mean, matrix = ann.pca_transform(c, 3, eigen_power=-0.5)
    y = (x - mean) @ matrix
    assert np.allclose(mean, x.mean(0)) and np.allclose(y.var(0, ddof=1), 1)
    mean, matrix = ann.pca_transform(c, 4, rotate=True)
    assert np.allclose(((x - mean) @ matrix) @ ((x - mean) @ matrix).T, (x - mean) @ (x - mean).T)


def test_binary_search_equals_brute_force(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").limit(120).toPandas()
    x = np.vstack(e.embedding.map(np.asarray)).astype(float)
    sign = np.where(x > 0, 1.0, -1.0)
    q, c = _emb(spark)
    q, c = q.where(F.col("query_id").isin(e.vec_id.tolist()[:20])), c.where(F.col("doc_id").isin(e.vec_id.tolist()))
    ids = e.vec_id.to_numpy()
    for broadcast_bytes in (1 << 20, 512):
        got = _as_lists(search.binary_search(q, c, 5, binary_k=30, broadcast_bytes=broadcast_bytes))
        for i, qid in enumerate(ids[:20]):
            ham = (sign != sign[i]).sum(1)
            near = sorted(range(len(ids)), key=lambda j: (ham[j], ids[j]))[:30]
            assert got[qid] == [ids[j] for j in sorted(near, key=lambda j: (-(x[i] @ sign[j]), ids[j]))[:5]]


def test_rules_by_group_and_null_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, None, 7)], "query_id long, embedding array<double>, g int")
    c = spark.createDataFrame([(1, [1.0, 0.0], 7), (3, [0.5, 0.0], 7), (4, [0.9, 0.0], 8), (5, None, 7)],
                              "doc_id long, embedding array<double>, g int")
    for broadcast_bytes in (1 << 20, 1):
        kw = {"ignore_identical": True, "group": "g", "broadcast_bytes": broadcast_bytes}
        assert _as_lists(search.knn(q, c, 5, rule="same", **kw)) == {1: [3]}
        assert _as_lists(search.knn(q, c, 5, rule="other", **kw)) == {1: [4]}
    assert search.score_rule("x", "cos_sim", "Classification") == "dot"
    assert search.score_rule("x", "cos_sim", "Retrieval") == "cos_sim"


def test_packed_codes_unpack_to_signs(spark):
    from tessera.functions import vectors as V
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    r = e.select(V.unpack_signs(V.binarize(F.col("embedding")), 64).alias("a"),
                 V.signs(F.col("embedding")).alias("b"),
                 F.size(V.binarize(F.col("embedding"))).alias("w")).collect()
    assert all(x.a == x.b and x.w == 1 for x in r)


def test_hot_cells_split_without_changing_results(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").withColumn("cell", F.col("label") % 3)
    q = search.pack(e, "vec_id", "embedding").join(e.select(F.col("vec_id").alias("id"), "cell"), "id")
    one, many = ({(r.query_id, r.doc_id, r.rank): r.score
                  for r in search.cell_topk(q, q, ["cell"], 5, search.Dot("<f4", "<f4"), n).collect()}
                 for n in (100_000, 40))
    # same neighbours and ranks; scores equal up to the order of summation
    assert one.keys() == many.keys() and len(one) == 500 * 5
    assert all(abs(one[x] - many[x]) < 1e-12 for x in one)


def test_fixed_codes_score_and_rank_every_pair(spark):
    from tessera.plans.registry import all_queries
    run = all_queries()["knn_pq_fixed"].build(spark, SF001).collect()
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    n, asked = e.count(), e.where("vec_id % 50 = 0").count()
    assert len({(r.query_id, r.doc_id) for r in run}) == len(run) == n * asked
    assert {r["rank"] for r in run} == set(range(1, n + 1))


def test_all_scores_of_broadcast_and_of_sliced_documents(spark):
    q, c = (search.pack(df, i, "embedding") for df, i in zip(_emb(spark), ("query_id", "doc_id")))
    key = lambda r: (r.query_id, r["rank"], r.doc_id, round(r.score, 9))
    want = sorted(map(key, search.top_k(q, c, 10_000, search.Dot("<f4", "<f4")).collect()))
    for size in (search.BROADCAST_QUERY_BYTES, 20_000):
        assert sorted(map(key, search.all_scores(q, c, search.Dot("<f4", "<f4"), size).collect())) == want
    assert search.all_scores(q, c.limit(0), search.Dot()).collect() == []


def test_blocks_of_queries_pass_each_slice_of_one_corpus(spark):
    """The documents that are shuffled do not grow with the blocks."""
    q, c = _emb(spark)
    packed = search.pack(q, "query_id", "embedding"), search.pack(c, "doc_id", "embedding")
    for slice_bytes in (search.SLICE_BYTES, 9_000):
        found = search._blocked(*packed, 60, 5, search.Dot("<f4", "<f4"), True, None, True, slice_bytes)
        counts = found.where("query_id IS NULL").agg(F.sum("second"), F.sum("score")).first()
        assert tuple(counts) == (60 * c.count(), q.count() * c.count())
        got = search._best(found.where("query_id IS NOT NULL"), 5)
        assert _as_lists(got) == _brute(spark, 5, ignore=True)
    plan = search.knn(q, c, 5, broadcast_bytes=1024)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # the queries', none of the documents


def test_codebooks_are_fitted_by_tasks_as_by_one(spark, monkeypatch):
    import os
    x = np.random.default_rng(5).standard_normal((500, 12))
    want = [ann.kmeans(part, 8, 42 + m) for m, part in enumerate(np.split(x, 3, axis=1))]
    for a, b in zip(ann.pq_books(x, 3, 3), want, strict=True):
        assert np.array_equal(a, b)
    monkeypatch.setattr(ann, "kmeans", lambda x, k, seed: np.full((1, x.shape[1]), float(os.getpid())))
    assert all((b != os.getpid()).all() for b in ann.pq_books(x, 3, 3))  # the driver fits none


@pytest.mark.parametrize("held", [1, search.PAIRS_HELD])
def test_all_scores_come_by_runs_of_ranks_in_few_bytes(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(search, "PAIRS_HELD", held)
    x = np.random.default_rng(5).integers(-3, 4, size=(5003, 6)).astype(float)  # many ties, sums without rounding
    n, asked = len(x), 96
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(asked)], "query_id long, embedding array<double>") \
        .coalesce(1).repartition(spark.sparkContext.defaultParallelism)
    found = search.all_scores(search.pack(q, "query_id", "embedding"), search.pack(d, "doc_id", "embedding"), search.Dot())
    found.write.parquet(str(tmp_path / "all"))
    got = spark.read.parquet(str(tmp_path / "all")).toPandas().sort_values(["query_id", "rank"])
    s = x[:asked] @ x.T
    best = np.argsort(-s, axis=1, kind="stable")
    assert len(got) == asked * n
    assert (got["query_id"].to_numpy() == np.repeat(np.arange(asked), n)).all()
    assert (got["rank"].to_numpy() == np.tile(np.arange(1, n + 1), asked)).all()
    assert (got["doc_id"].to_numpy() == best.ravel()).all()
    assert (got["score"].to_numpy() == np.take_along_axis(s, best, axis=1).ravel()).all()
    if held > 1:
        files = [pq.ParquetFile(f).metadata for f in (tmp_path / "all").glob("*.parquet")]
        chunks = [m.row_group(g).column(3) for m in files for g in range(m.num_row_groups)]
        assert {c.path_in_schema for c in chunks} == {"rank"}
        assert sum(c.total_compressed_size for c in chunks) < asked * n  # 4 bytes a row, query by query
