"""Compressed and approximate search over ``embeddings`` (all vectors are
corpus, ids divisible by 50 the queries).  The quantisers have exact SQL
twins; the fitted indexes run here at their defaults, which tests hold to a
recall of 0.9, and once more at settings where the answer is exact: all
components, all lists, no hash bits, a rotation alone, a fixed codebook."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import ann, graph, index, search
from ..session import stage_path
from .registry import register
from .retrieval import _DOT, EVERY, K_RUN, _corpus, _out, _queries, _run_sql

_EXACT_SQL = f"""
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({_run_sql(_DOT, K_RUN, 'true')})
"""

_SQ8_SQL = f"""
WITH dims AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
r AS (SELECT i, min(x) AS mn, max(x) - min(x) AS df FROM dims GROUP BY i),
cells AS (SELECT e.vec_id, d.i, d.x FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i,
                                                 unnest(embedding)::DOUBLE AS x FROM embeddings) d
          JOIN embeddings e USING (vec_id)),
dec AS (SELECT c.vec_id, c.i,
               r.mn + (CASE WHEN r.df > 0 THEN floor(255 * least(1.0, greatest(0.0, (c.x - r.mn) / r.df))) ELSE 0 END + 0.5)
                      / 255.0 * r.df AS y
        FROM cells c JOIN r USING (i)),
qd AS (SELECT vec_id AS query_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS q FROM embeddings
       WHERE vec_id % {EVERY} = 0),
s AS (SELECT qd.query_id, dec.vec_id AS doc_id, sum(qd.q * dec.y) AS score
      FROM qd JOIN dec USING (i) GROUP BY qd.query_id, dec.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= {K_RUN}
"""


@register("knn_sq8", ops=("V3",), oracle=_SQ8_SQL)
def knn_sq8(spark, sf_dir):
    return _out(ann.sq8_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN))


# half precision: 11 significant bits, rounded half to even (subnormal below 2^-14)
_HALF = ("list_transform(d.embedding, lambda x: CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE "
         "round_even(x::DOUBLE / pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10), 0) "
         "* pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10) END)")


@register("knn_fp16", ops=("V3",), oracle=f"""
WITH h AS (SELECT vec_id, {_HALF} AS embedding FROM embeddings d),
s AS (SELECT q.vec_id AS query_id, h.vec_id AS doc_id,
             list_inner_product(q.embedding::DOUBLE[], h.embedding) AS score
      FROM embeddings q JOIN h ON true WHERE q.vec_id % {EVERY} = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= {K_RUN}
""")
def knn_fp16(spark, sf_dir):
    return _out(ann.fp16_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN))


REFINE = 160


@register("knn_pca", ops=("V6",))
def knn_pca(spark, sf_dir):
    return _out(ann.pca_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, 32, refine=REFINE))


@register("knn_pca_full", ops=("V6",), oracle=f"""
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT i, avg(v) AS m FROM x GROUP BY i),
c AS (SELECT vec_id, list(v - m ORDER BY i) AS e FROM x JOIN m USING (i) GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_inner_product(q.e, d.e) AS score
      FROM c q JOIN c d ON true WHERE q.vec_id % {EVERY} = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= {K_RUN}
""")
def knn_pca_full(spark, sf_dir):
    """All components, rotated at random: the centred inner product."""
    return _out(ann.pca_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, 64, rotate=True))


@register("knn_pq", ops=("V4",))
def knn_pq(spark, sf_dir):
    return _out(ann.pq_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, n_sub=16, refine=REFINE))


FIXED_SUB, FIXED_BOOK = 8, 16


@register("knn_pq_fixed", ops=("V4",), oracle=f"""
WITH x AS (SELECT vec_id, (i - 1) // 8 AS m, list(v ORDER BY i) AS e FROM (
             SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
           GROUP BY ALL),
b AS (SELECT vec_id AS c, m, e FROM x JOIN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {FIXED_BOOK}) USING (vec_id)),
code AS (SELECT x.vec_id, x.m, arg_min(b.e, list_inner_product(b.e, b.e) / 2 - list_inner_product(x.e, b.e)) AS e
         FROM x JOIN b USING (m) GROUP BY x.vec_id, x.m),
s AS (SELECT q.vec_id AS query_id, code.vec_id AS doc_id,
             list_sum(list(list_inner_product(q.e, code.e) ORDER BY m)) AS score
      FROM x q JOIN code USING (m) WHERE q.vec_id % {EVERY} = 0 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM rk
""")
def knn_pq_fixed(spark, sf_dir):
    """Scores of every query and document from stored codes with a codebook
    given by the table (the sub-vectors of the sixteen smallest ids), all of
    them ranked.  Few centroids tie often: equal codes have equal sums, and
    the smaller id is first."""
    corpus, queries = _corpus(spark, sf_dir), _queries(spark, sf_dir)
    first = corpus.orderBy("doc_id").limit(FIXED_BOOK).select("embedding").collect()
    books = np.split(np.array([r["embedding"] for r in first], dtype=np.float64), FIXED_SUB, axis=1)
    return _out(ann.pq_search(queries, corpus, None, books=books))


@register("knn_opq", ops=("V5", "V4"))
def knn_opq(spark, sf_dir):
    return _out(ann.opq_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, n_sub=16, refine=REFINE))


@register("knn_rotated", ops=("V5",), oracle=_EXACT_SQL)
def knn_rotated(spark, sf_dir):
    """A rotation to 4 * 24 dimensions keeps every inner product."""
    turn = ann.random_rotation(64, 4 * 24)
    side = lambda df, i: search.pack(df, i, "embedding", lambda x: x @ turn)
    return _out(search.top_k(side(_queries(spark, sf_dir), "query_id"), side(_corpus(spark, sf_dir), "doc_id"),
                             K_RUN, search.Dot()))


@register("knn_ivf", ops=("V7",))
def knn_ivf(spark, sf_dir):
    return _out(ann.ivf_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN))


@register("knn_ivf_all", ops=("V7",), oracle=_EXACT_SQL)
def knn_ivf_all(spark, sf_dir):
    return _out(ann.ivf_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, n_lists=16, n_probe=16))


@register("knn_lsh", ops=("V7", "F24", "A19"))
def knn_lsh(spark, sf_dir):
    return _out(ann.lsh_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN))


@register("knn_lsh_all", ops=("V7", "F24", "A19"), oracle=_EXACT_SQL)
def knn_lsh_all(spark, sf_dir):
    """No hash bits: every document is a candidate."""
    return _out(ann.lsh_search(_queries(spark, sf_dir), _corpus(spark, sf_dir), K_RUN, n_tables=2, bits=0))


@register("knn_graph", ops=("V7", "F24"))
def knn_graph(spark, sf_dir):
    """Best-first search over a graph of neighbours."""
    return _out(graph.graph_search(_queries(spark, sf_dir), graph.build_graph(_corpus(spark, sf_dir)), K_RUN))


@register("knn_graph_all", ops=("V7", "F24"), oracle=_EXACT_SQL)
def knn_graph_all(spark, sf_dir):
    """Walks that may keep every node they meet reach all of them."""
    return _out(graph.graph_search(_queries(spark, sf_dir), graph.build_graph(_corpus(spark, sf_dir), rounds=2), K_RUN,
                                   ef=1 << 30))


def _stored(spark, sf_dir, **kw):
    path = stage_path(spark, "vector-index")
    index.write_index(_corpus(spark, sf_dir), path, **kw)
    return index.read_index(spark, path)


@register("knn_ivf_stored", ops=("V7", "V9"), oracle=_EXACT_SQL)
def knn_ivf_stored(spark, sf_dir):
    """An index written and read back, every list probed."""
    return _out(index.index_search(_queries(spark, sf_dir), _stored(spark, sf_dir, n_lists=16), K_RUN, n_probe=16))


@register("knn_sq8_stored", ops=("V3", "V7", "V9"), oracle=_SQ8_SQL)
def knn_sq8_stored(spark, sf_dir):
    """8-bit codes and their ranges from disk, every list probed."""
    return _out(index.index_search(_queries(spark, sf_dir), _stored(spark, sf_dir, form="sq8", n_lists=8), K_RUN, n_probe=8))


@register("knn_pq_stored", ops=("V4", "V7", "V9"))
def knn_pq_stored(spark, sf_dir):
    """Product codes by list, most lists probed, the best reordered."""
    return _out(index.index_search(_queries(spark, sf_dir), _stored(spark, sf_dir, form="pq", n_sub=16), K_RUN,
                                   refine=REFINE, corpus=_corpus(spark, sf_dir)))
