"""Contrastive losses over groups built from the ``embeddings`` table: each
query (ids divisible by 50) has its best same-label vector of the whole table
as the positive and the three best other-label vectors as hard negatives;
only a query whose label no other vector has, or that has fewer than three
vectors of other labels, forms no group.  Batches are eight queries;
queries whose label is a multiple of 3 are
treated as hard-negative-only tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import losses as L
from ..operators import metrics as M
from ..operators import search
from ..session import cut_lineage, table
from .registry import register
from .retrieval import _DOT, EVERY

N_NEG = 3
BATCH = 8
T_HN = 0.02
T_IB = 0.05


def loss_groups(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    q = emb.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label")
    d = emb.select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    pos = search.knn(q, d, 1, "dot", ignore_identical=True, group="label", rule="same") \
        .select("query_id", "doc_id", "score", F.lit(0).alias("pos"))
    neg = search.knn(q, d, N_NEG, "dot", ignore_identical=True, group="label", rule="other") \
        .select("query_id", "doc_id", "score", F.col("rank").alias("pos"))
    rows = pos.unionByName(neg)
    whole = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")) \
        .where((F.col("n") == N_NEG + 1) & (F.col("first") == 0)).select("query_id")
    return cut_lineage(rows.join(whole, "query_id").select(
        F.col("query_id").alias("group_id"),
        F.floor(F.col("query_id") / (EVERY * BATCH)).cast("long").alias("batch_id"),
        "pos", "doc_id", "score"), "loss_groups")


_GROUPS_SQL = f"""
pr0 AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {_DOT} AS score, q.label = d.label AS rel
        FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0),
p AS (SELECT query_id, doc_id, score, 0 AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM pr0 WHERE rel)
      WHERE r = 1),
n AS (SELECT query_id, doc_id, score, pos FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos
        FROM pr0 WHERE NOT rel) WHERE pos <= {N_NEG}),
ok AS (SELECT query_id FROM n GROUP BY query_id HAVING count(*) = {N_NEG}
       INTERSECT SELECT query_id FROM p),
grp AS (SELECT query_id AS group_id, query_id // {EVERY * BATCH} AS batch_id, pos, doc_id, score
        FROM (SELECT * FROM p UNION ALL SELECT * FROM n) WHERE query_id IN (SELECT query_id FROM ok))"""


@register("loss_hn_only", ops=("L1",), oracle=f"""
WITH {_GROUPS_SQL},
lg AS (SELECT group_id, score / {T_HN} AS x, pos FROM grp),
mx AS (SELECT group_id, max(x) AS m FROM lg GROUP BY group_id)
SELECT group_id, round(max(m) + ln(sum(exp(x - m))) - max(CASE WHEN pos = 0 THEN x END), 6) AS loss
FROM lg JOIN mx USING (group_id) GROUP BY group_id
""")
def loss_hn_only(spark, sf_dir):
    out = L.hn_only_loss(loss_groups(spark, sf_dir), T_HN)
    return out.select("group_id", F.round("loss", 6).alias("loss"))


@register("loss_in_batch", ops=("L2", "J10", "F15"), oracle=f"""
WITH {_GROUPS_SQL},
q AS (SELECT DISTINCT g.group_id, g.batch_id, e.embedding AS qv, e.label % 3 = 0 AS hn_only
      FROM grp g JOIN embeddings e ON e.vec_id = g.group_id),
ps AS (SELECT g.batch_id, g.group_id AS p_group, g.pos, e.embedding AS pv
       FROM grp g JOIN embeddings e ON e.vec_id = g.doc_id),
pr AS (SELECT q.batch_id, q.group_id, ps.p_group, ps.pos,
              list_inner_product(q.qv::DOUBLE[], ps.pv::DOUBLE[]) / {T_IB} AS x
       FROM q JOIN ps ON ps.batch_id = q.batch_id
       WHERE NOT q.hn_only OR ps.p_group = q.group_id),
mx AS (SELECT batch_id, group_id, max(x) AS m FROM pr GROUP BY ALL)
SELECT batch_id, group_id,
       round(max(m) + ln(sum(exp(x - m))) - max(CASE WHEN p_group = group_id AND pos = 0 THEN x END), 6) AS loss
FROM pr JOIN mx USING (batch_id, group_id) GROUP BY batch_id, group_id
""")
def loss_in_batch(spark, sf_dir):
    g = loss_groups(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings")
    q = (g.select("group_id", "batch_id").distinct()
         .join(emb.select(F.col("vec_id").alias("group_id"), F.col("embedding").alias("q_vec"),
                          (F.col("label") % 3 == 0).alias("hn_only")), "group_id"))
    p = g.join(emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("p_vec")),
               "doc_id").select("batch_id", "group_id", "pos", "p_vec")
    out = L.in_batch_loss_blocks(q, p, T_IB)
    return out.select("batch_id", "group_id", F.round("loss", 6).alias("loss"))


@register("loss_kl", ops=("L3",), oracle=f"""
WITH {_GROUPS_SQL},
r AS (SELECT group_id, score / {T_IB} AS s, -pos::DOUBLE AS t FROM grp),
m AS (SELECT group_id, max(s) AS ms, max(t) AS mt FROM r GROUP BY group_id),
z AS (SELECT r.group_id, r.s - m.ms AS sl, r.t - m.mt AS tl FROM r JOIN m USING (group_id)),
nz AS (SELECT group_id, ln(sum(exp(sl))) AS zs, ln(sum(exp(tl))) AS zt FROM z GROUP BY group_id)
SELECT group_id, round(sum(exp(tl - zt) * ((tl - zt) - (sl - zs))), 6) AS kl
FROM z JOIN nz USING (group_id) GROUP BY group_id
""")
def loss_kl(spark, sf_dir):
    g = loss_groups(spark, sf_dir).withColumn("teacher", -F.col("pos").cast("double"))
    return L.kl_loss(g, T_IB).select("group_id", F.round("kl", 6).alias("kl"))


GROUP_KS = ("dcg@2", "ndcg@3", "mrr@2", "ctr@2", "recall@2", "ndcg")


@register("group_metrics", ops=("A13", "A14", "A15", "A16", "A17"), oracle=f"""
WITH {_GROUPS_SQL},
r AS (SELECT group_id, pos, CASE WHEN pos = 0 THEN 1 ELSE 0 END AS y,
             row_number() OVER (PARTITION BY group_id ORDER BY score DESC, pos DESC) AS i,
             row_number() OVER (PARTITION BY group_id ORDER BY score, pos) - 1 AS j FROM grp),
v AS (
  SELECT group_id, 'dcg@2' AS metric, sum(CASE WHEN i <= 2 THEN y / log2(i + 1) ELSE 0 END) AS value FROM r GROUP BY 1
  UNION ALL SELECT group_id, 'ndcg@3', sum(CASE WHEN i <= 3 THEN y / log2(i + 1) ELSE 0 END) FROM r GROUP BY 1
  UNION ALL SELECT group_id, 'ndcg', sum(CASE WHEN i <= 5 THEN y / log2(i + 1) ELSE 0 END) FROM r GROUP BY 1
  UNION ALL SELECT group_id, 'mrr@2', max(CASE WHEN i <= 2 THEN y / i ELSE 0 END) FROM r GROUP BY 1
  UNION ALL SELECT group_id, 'ctr@2', sum(CASE WHEN i <= 2 THEN y ELSE 0 END) / 2.0 FROM r GROUP BY 1
  UNION ALL SELECT group_id, 'recall@2', max(CASE WHEN i <= 2 THEN y ELSE 0 END)::DOUBLE FROM r GROUP BY 1
  UNION ALL SELECT group_id, 'mrr@2 compat',
    coalesce(sum(CASE WHEN j % 2 = 0 THEN y / (j // 2 + 1) END) / nullif(sum(CASE WHEN j % 2 = 0 THEN y END), 0), 0)
    FROM r GROUP BY 1
  UNION ALL SELECT group_id, 'recall@2 compat', max(CASE WHEN j = 0 AND pos < 2 THEN 1 ELSE 0 END)::DOUBLE
    FROM r GROUP BY 1)
SELECT group_id, metric, round(value, 6) AS value FROM v
""")
def group_metrics(spark, sf_dir):
    rows = loss_groups(spark, sf_dir).withColumn("label", (F.col("pos") == 0).cast("int"))
    found = [M.group_metric(rows, name).withColumn("metric", F.lit(name)) for name in GROUP_KS]
    found += [M.group_metric(rows, name, compat=True).withColumn("metric", F.lit(f"{name} compat"))
              for name in ("mrr@2", "recall@2")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("group_id", "metric", F.round("value", 6).alias("value"))
