"""Vector search, rank metrics and hard-negative mining over the driver's
``embeddings`` table: all vectors are corpus passages, those whose id is
divisible by 50 are the queries; two vectors are relevant to each other when their ``label`` is equal (the
query itself excluded).  Relevance is decided by joining labels, never by
materialising all same-label pairs."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import ann, mining, search
from ..session import join_small, stage_path, table
from .registry import register

EVERY = 50
KS = [1, 3, 5, 10]
K_RUN = 10


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _queries(spark, sf_dir):
    return _emb(spark, sf_dir).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _corpus(spark, sf_dir):
    return _emb(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding")


def _out(run):
    return run.select("query_id", "doc_id", F.round("score", 6).alias("score"),
                      F.col("rank").cast("long").alias("rank"))


_DOT = "list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[])"
_NORM = "greatest(sqrt(list_inner_product({v}.embedding::DOUBLE[], {v}.embedding::DOUBLE[])), 1e-12)"
_COS = f"{_DOT} / ({_NORM.format(v='q')} * {_NORM.format(v='d')})"


def _run_sql(score: str, k: int, where: str = "q.vec_id <> d.vec_id") -> str:
    return f"""
  SELECT query_id, doc_id, score, rank FROM (
    SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {score} AS score,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, d.vec_id) AS rank
    FROM embeddings q JOIN embeddings d ON {where} WHERE q.vec_id % {EVERY} = 0) WHERE rank <= {k}"""


@register("knn_flat_ip", ops=("V1", "J8", "W1", "T3", "F16"), oracle=f"""
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({_run_sql(_DOT, K_RUN)})
""")
def knn_flat_ip(spark, sf_dir):
    return _out(search.knn(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, "dot",
                           ignore_identical=True))


@register("knn_cosine", ops=("V1", "F17", "F18", "F19"), oracle=f"""
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({_run_sql(_COS, K_RUN, 'true')})
""")
def knn_cosine(spark, sf_dir):
    return _out(search.knn(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, "cos_sim"))


@register("knn_blocked", ops=("V1", "T2"), oracle=f"""
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({_run_sql(_DOT, K_RUN)})
""")
def knn_blocked(spark, sf_dir):
    """The plan for queries beyond the broadcast bound, by a bound of 1 KB."""
    return _out(search.knn(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, "dot",
                           ignore_identical=True, broadcast_bytes=1 << 10))


@register("knn_bounded", ops=("V1", "J8", "W1"), oracle=f"""
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({_run_sql(_DOT, K_RUN)})
""")
def knn_bounded(spark, sf_dir):
    return _out(ann.bounded_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, ignore_identical=True))


@register("knn_observed", ops=("A20", "V1", "K6"), oracle="""
SELECT count(*) FILTER (vec_id % 50 = 0)::BIGINT AS queries, count(embedding)::BIGINT AS documents,
       (count(*) FILTER (vec_id % 50 = 0) * count(embedding))::BIGINT AS products FROM embeddings
""")
def knn_observed(spark, sf_dir):
    """What a search over all vectors did, observed in the run itself."""
    seen = Observation("knn")
    run = search.knn(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, observation=seen)
    run.write.mode("overwrite").parquet(stage_path(spark, "knn_observed"))
    return spark.createDataFrame([tuple(int(seen.get[c]) for c in ("queries", "documents", "products"))],
                                 "queries long, documents long, products long")


_HAM = ("list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: "
        "CASE WHEN (q.embedding[i] > 0) <> (d.embedding[i] > 0) THEN 1 ELSE 0 END))")
_SIGNDOT = ("list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: "
            "q.embedding[i]::DOUBLE * CASE WHEN d.embedding[i] > 0 THEN 1.0 ELSE -1.0 END))")
BINARY_K = 50


@register("knn_binary_hamming", ops=("V2",), oracle=f"""
SELECT query_id, doc_id, score, rank FROM (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, -{_HAM}::DOUBLE AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {_HAM}, d.vec_id) AS rank
  FROM embeddings q JOIN embeddings d ON true WHERE q.vec_id % {EVERY} = 0) WHERE rank <= {K_RUN}
""")
def knn_binary_hamming(spark, sf_dir):
    return _out(search.binary_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN,
                                     rerank=False))


@register("knn_binary_rerank", ops=("V2",), oracle=f"""
WITH ham AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {_SIGNDOT} AS sd,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {_HAM}, d.vec_id) AS hrank
  FROM embeddings q JOIN embeddings d ON true WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, doc_id, round(sd, 6) AS score, rank FROM (
  SELECT query_id, doc_id, sd,
         row_number() OVER (PARTITION BY query_id ORDER BY sd DESC, doc_id) AS rank
  FROM ham WHERE hrank <= {BINARY_K}) WHERE rank <= {K_RUN}
""")
def knn_binary_rerank(spark, sf_dir):
    return _out(search.binary_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN,
                                     binary_k=BINARY_K, rerank=True))


@register("mips_augment", ops=("F24", "A19"), oracle="""
WITH n AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS sq,
                  len(embedding) AS dim FROM embeddings)
SELECT vec_id, dim + 1 AS dim, round(sqrt(greatest((SELECT max(sq) FROM n) - sq, 0.0)), 6) AS extra
FROM n
""")
def mips_augment(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    # the global max is a scalar subquery (one partial + final aggregate)
    mx = emb.agg(F.max(V.sq_norm(F.col("embedding")))).scalar()
    aug = emb.select("vec_id", V.mips_augment_doc(F.col("embedding"), mx).alias("v"))
    return aug.select("vec_id", F.size("v").cast("long").alias("dim"),
                      F.round(F.element_at("v", -1), 6).alias("extra"))


def _judged_run(spark, sf_dir, k):
    run = search.knn(_queries(spark, sf_dir), _corpus(spark, sf_dir), k, "dot",
                     ignore_identical=True)
    lab = _emb(spark, sf_dir).select("vec_id", "label")
    return (run.join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")),
                     "query_id")
            .join(lab.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl")), "doc_id")
            .withColumn("rel", (F.col("ql") == F.col("dl")).cast("int")))


def _label_base(spark, sf_dir, ks):
    lab = _emb(spark, sf_dir).select("vec_id", "label")
    sizes = lab.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_rel"))
    base = lab.where(F.col("vec_id") % EVERY == 0).join(sizes, "label") \
        .select(F.col("vec_id").alias("query_id"), "n_rel").where(F.col("n_rel") > 0)
    for k in ks:
        base = M.ideal_dcg_binary(base, k)
    return base


_JUDGED_SQL = f"""
WITH run AS ({_run_sql(_DOT, K_RUN)}),
lab AS (SELECT vec_id, label FROM embeddings),
j AS (SELECT run.*, CASE WHEN lq.label = ld.label THEN 1 ELSE 0 END AS rel
      FROM run JOIN lab lq ON lq.vec_id = run.query_id JOIN lab ld ON ld.vec_id = run.doc_id),
jh AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits_so_far FROM j),
base AS (SELECT l.vec_id AS query_id, s.n - 1 AS n_rel
         FROM lab l JOIN (SELECT label, count(*) AS n FROM lab GROUP BY label) s USING (label)
         WHERE s.n > 1 AND l.vec_id % {EVERY} = 0),
ks AS (SELECT unnest([{', '.join(map(str, KS))}]) AS k),
pq AS (
  SELECT b.query_id, ks.k, b.n_rel,
    coalesce(sum(CASE WHEN jh.rank <= ks.k THEN (pow(2.0, jh.rel) - 1) / log2(jh.rank + 1) END), 0) AS dcg,
    (SELECT sum(1.0 / log2(i + 1)) FROM range(1, least(ks.k, b.n_rel) + 1) t(i)) AS idcg,
    coalesce(sum(CASE WHEN jh.rank <= ks.k AND jh.rel > 0 THEN jh.hits_so_far / jh.rank END), 0) AS ap,
    coalesce(sum(CASE WHEN jh.rank <= ks.k THEN jh.rel END), 0) AS hits,
    coalesce(max(CASE WHEN jh.rank <= ks.k AND jh.rel > 0 THEN 1.0 / jh.rank END), 0) AS rr
  FROM base b CROSS JOIN ks LEFT JOIN jh ON jh.query_id = b.query_id
  GROUP BY b.query_id, ks.k, b.n_rel)
"""


@register("rank_metrics", ops=("A12", "A13", "A14", "A18"),
          oracle=_JUDGED_SQL + """
SELECT metric, k, round(value, 6) AS value FROM (
  SELECT 'ndcg' AS metric, k, avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END) AS value FROM pq GROUP BY k
  UNION ALL SELECT 'map', k, avg(ap / n_rel) FROM pq GROUP BY k
  UNION ALL SELECT 'recall', k, avg(hits / n_rel) FROM pq GROUP BY k
  UNION ALL SELECT 'precision', k, avg(hits / k) FROM pq GROUP BY k
  UNION ALL SELECT 'mrr', k, avg(rr) FROM pq GROUP BY k
  UNION ALL SELECT 'accuracy', k, avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) FROM pq GROUP BY k)
""")
def rank_metrics(spark, sf_dir):
    return M.evaluate(_judged_run(spark, sf_dir, K_RUN), _label_base(spark, sf_dir, KS), KS)


@register("ndcg_at_k", ops=("A13",), oracle=_JUDGED_SQL + """
SELECT query_id, k, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM pq
""")
def ndcg_at_k(spark, sf_dir):
    pq = M.per_query(_judged_run(spark, sf_dir, K_RUN), _label_base(spark, sf_dir, KS), KS)
    pairs = ", ".join(f"{k}, ndcg_{k}" for k in KS)
    return pq.selectExpr("query_id", f"stack({len(KS)}, {pairs}) AS (k, ndcg)").select(
        "query_id", "k", F.round("ndcg", 6).alias("ndcg"))


@register("rank_metrics_qrels", ops=("A13", "A18", "J12"), oracle=f"""
WITH run AS ({_run_sql(_DOT, K_RUN)}),
qrels AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, 1 + d.vec_id % 2 AS rel
          FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id
          WHERE q.vec_id % {EVERY} = 0),
j AS (SELECT run.query_id, run.rank, coalesce(qrels.rel, 0) AS rel FROM run LEFT JOIN qrels USING (query_id, doc_id)),
h AS (SELECT *, sum((rel > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM j),
i AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM qrels),
ideal AS (SELECT query_id, sum(CASE WHEN r <= {K_RUN} THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS idcg,
                 count(*) AS n_rel FROM i GROUP BY query_id)
SELECT ideal.query_id, round(coalesce(sum((pow(2.0, h.rel) - 1) / log2(h.rank + 1)), 0) / max(idcg), 6) AS ndcg,
       round(coalesce(sum(CASE WHEN h.rel > 0 THEN h.hits / h.rank END), 0) / max(n_rel), 6) AS map,
       round(coalesce(sum((h.rel > 0)::INT), 0) / max(n_rel), 6) AS recall
FROM ideal LEFT JOIN h USING (query_id) GROUP BY ideal.query_id
""")
def rank_metrics_qrels(spark, sf_dir):
    """Graded qrels from a table, joined with the run (missing = 0)."""
    run = search.knn(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, "dot", ignore_identical=True)
    lab = _emb(spark, sf_dir).select("vec_id", "label")
    q = lab.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "label")
    d = lab.select(F.col("vec_id").alias("doc_id"), "label")
    qrels = join_small(d, q, "label").where("query_id <> doc_id").select(
        "query_id", "doc_id", (F.col("doc_id") % 2 + 1).alias("rel"))
    pq = M.per_query(M.judge(run, qrels), M.query_base_from_qrels(qrels, [K_RUN]), [K_RUN])
    return pq.select("query_id", *[F.round(f"{m}_{K_RUN}", 6).alias(m) for m in ("ndcg", "map", "recall")])


MINE_TOPK, MINE_DEPTH, MINE_N, MINE_SEED = 100, (2, 100), 16, 42


@register("mine_hard_negatives", ops=("P1", "W2", "J5", "M1", "V1"), oracle=f"""
WITH run AS ({_run_sql(_DOT, MINE_TOPK)}),
lab AS (SELECT vec_id, label FROM embeddings),
c AS (SELECT run.query_id, run.doc_id, run.rank FROM run
      JOIN lab lq ON lq.vec_id = run.query_id JOIN lab ld ON ld.vec_id = run.doc_id
      WHERE lq.label <> ld.label AND run.rank > {MINE_DEPTH[0]} AND run.rank <= {MINE_DEPTH[1]}
        AND run.doc_id <> -1)
SELECT query_id, doc_id, rank, sample_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY md5(concat('{MINE_SEED}', '|', query_id::VARCHAR, '|', doc_id::VARCHAR)), doc_id) AS sample_rank
  FROM c) WHERE sample_rank <= {MINE_N}
""")
def mine_hard_negatives(spark, sf_dir):
    judged = _judged_run(spark, sf_dir, MINE_TOPK)
    return mining.sample_hard_negatives(judged, MINE_DEPTH, MINE_N, MINE_SEED).select(
        "query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
        F.col("sample_rank").cast("long").alias("sample_rank"))
