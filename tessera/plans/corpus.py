"""Corpus/qrels built from training pairs: ``conversations`` user turns are
queries, the assistant turn right after each is its positive passage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..session import table
from .registry import register


def pair_groups(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    q = t.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = t.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ptext"))
    return (q.join(a, ["conv_id", "turn"])
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_idx"), "query",
                    F.array(F.struct(F.lit("").alias("title"), F.col("ptext").alias("text")))
                    .alias("positive_passages")))


_PAIRS_SQL = """
pairs AS (SELECT q.conv_id * 1000 + q.turn AS row_idx, 0 AS pos, '' AS title, a.text
          FROM conversations q JOIN conversations a
            ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
          WHERE q.role = 'user'),
firsts AS (SELECT title || text AS k, min(row_idx) AS first_row FROM pairs GROUP BY 1),
corp AS (SELECT k, first_row, row_number() OVER (ORDER BY first_row) - 1 AS corpus_idx FROM firsts)"""


@register("corpus_from_pairs", ops=("A2", "F4", "F38"), oracle=f"""
WITH {_PAIRS_SQL}
SELECT corpus_idx, corpus_idx::VARCHAR AS _id, first_row, md5(k) AS content_md5 FROM corp
""")
def corpus_from_pairs(spark, sf_dir):
    c = C.corpus_from_groups(pair_groups(spark, sf_dir))
    return c.select("corpus_idx", "_id", "first_row", F.col("key").alias("content_md5"))


@register("qrels_from_pairs", ops=("A1", "J2"), oracle=f"""
WITH {_PAIRS_SQL}
SELECT p.row_idx AS query_id, c.corpus_idx FROM pairs p JOIN corp c ON c.k = p.title || p.text
""")
def qrels_from_pairs(spark, sf_dir):
    g = pair_groups(spark, sf_dir)
    c = C.corpus_from_groups(g)
    return C.qrels_from_groups(g, c).select(F.col("row_idx").alias("query_id"), "corpus_idx")


@register("pair_passages", ops=("U4",), oracle="""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
q AS (SELECT conv_id * 1000 + turn AS row_idx, conv_id, turn FROM t WHERE role = 'user'),
p AS (SELECT row_idx, 0 AS place, 'pos' AS role, t.text FROM q JOIN t USING (conv_id) WHERE t.role = 'assistant' AND t.turn = q.turn + 1),
n AS (SELECT row_idx, row_number() OVER (PARTITION BY row_idx ORDER BY t.turn, t.text) AS place, 'neg' AS role, t.text
      FROM q JOIN t USING (conv_id) WHERE t.role = 'assistant' AND t.turn > q.turn + 1 AND row_idx IN (SELECT row_idx FROM p))
SELECT row_idx, place AS pos, role, md5(text) AS text_md5 FROM p UNION ALL SELECT row_idx, place, role, md5(text) FROM n
""")
def pair_passages(spark, sf_dir):
    """Positives and negatives of every group as one corpus: the answer right
    after a user turn, and the conversation's later answers."""
    t = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("later"), F.struct(F.lit("").alias("title"), "text").alias("p"))
    g = pair_groups(spark, sf_dir).withColumn("conv_id", F.floor(F.col("row_idx") / 1000).cast("long"))
    # a conversation's turns are few; they are the negatives of its groups
    neg = g.select("row_idx", "conv_id").join(t, "conv_id").where(F.col("later") > F.col("row_idx") % 1000 + 1) \
        .groupBy("row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("later", "p"))), lambda x: x["p"]).alias("n"))
    none = F.array().cast("array<struct<title:string,text:string>>")
    groups = g.drop("conv_id").join(neg, "row_idx", "left").withColumn("negative_passages", F.coalesce("n", none)).drop("n")
    return C.passage_rows(groups).select("row_idx", "pos", "role", F.md5("text").alias("text_md5"))
