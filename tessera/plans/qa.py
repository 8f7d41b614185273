"""QA text queries: tokens and n-grams of whole texts, passage text rules,
and answer containment of ``benchmark`` items inside ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import qa
from ..functions import text as TX
from ..operators import answers
from ..session import spread, table
from .registry import register

_PAT = qa.TOKEN_PATTERN.replace("'", "''")
_WORDS = "list_transform(regexp_extract_all(@T@, '" + _PAT + "', 0), lambda x: lower(x))"


def _words(t: str) -> str:
    return _WORDS.replace("@T@", t)


@register("qa_tokens", ops=("F31", "F32"), oracle=f"""
SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, chr(1))) AS tokens_md5
FROM (SELECT doc_id, {_words('text')} AS w FROM documents)
""")
def qa_tokens(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    w = qa.words(F.col("text"))
    return d.select("doc_id", F.size(w).cast("long").alias("n_tokens"),
                    F.md5(F.array_join(w, qa.SENTINEL)).alias("tokens_md5"))


@register("ngrams", ops=("F33",), oracle=f"""
WITH w AS (SELECT item_id, {_words('text')} AS w FROM benchmark)
SELECT item_id, len(g)::BIGINT AS n_grams, md5(array_to_string(g, chr(1))) AS grams_md5 FROM (
  SELECT item_id, flatten(list_transform(range(0, len(w)), lambda s:
           list_transform(range(s, least(s + 2, len(w))), lambda e: array_to_string(w[s + 1:e + 1], ' ')))) AS g
  FROM w)
""")
def ngrams(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", qa.words(F.col("text")).alias("w"))
    g = qa.ngrams(F.col("w"), 2)
    return b.select("item_id", F.size(g).cast("long").alias("n_grams"),
                    F.md5(F.array_join(g, qa.SENTINEL)).alias("grams_md5"))


# one answer without tokens beside the benchmark's, to show its row
_ANSWERS = "(SELECT item_id, text FROM benchmark UNION ALL SELECT -1, ' ')"


@register("answer_match", ops=("F30", "F34", "J11"), oracle=f"""
WITH d AS (SELECT doc_id, chr(1) || array_to_string({_words('nfc_normalize(text)')}, chr(1)) || chr(1) AS s FROM documents),
b AS (SELECT item_id, {_words('nfc_normalize(text)')} AS w FROM {_ANSWERS})
SELECT d.doc_id, b.item_id, false AS all_passages FROM d JOIN b
  ON len(b.w) > 0 AND contains(d.s, chr(1) || array_to_string(b.w, chr(1)) || chr(1))
UNION ALL SELECT NULL, item_id, true FROM b WHERE len(w) = 0
""")
def answer_match(spark, sf_dir):
    """Equality of decomposed texts is equality of composed ones, which is
    what the SQL twin can express."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    b = b.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("item_id"), F.lit(" ").alias("text")))
    return answers.contained_answers(table(spark, sf_dir, "documents"), b)


@register("accuracy_at_k", ops=("A12", "F34", "J11"), oracle=f"""
WITH b AS (SELECT item_id AS query_id, {_words('text')} AS w FROM benchmark),
d AS (SELECT doc_id, chr(1) || array_to_string({_words('text')}, chr(1)) || chr(1) AS s FROM documents),
hit AS (SELECT b.query_id, d.doc_id, contains(d.s, chr(1) || array_to_string(b.w[1:8], chr(1)) || chr(1)) AS ok,
               row_number() OVER (PARTITION BY b.query_id
                 ORDER BY md5(concat(b.query_id::VARCHAR, '|', d.doc_id::VARCHAR)), d.doc_id) AS rank
        FROM b JOIN d ON true),
f AS (SELECT query_id, min(CASE WHEN ok THEN rank END) AS first FROM hit GROUP BY query_id)
SELECT k, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM f, (SELECT unnest([10, 100, 200, 500]) AS k) GROUP BY k
""")
def accuracy_at_k(spark, sf_dir):
    """Answer accuracy of a seeded ranking of all documents; an item's answer
    is its first eight tokens."""
    ks = [10, 100, 200, 500]
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    order = F.md5(F.concat(F.col("query_id").cast("string"), F.lit("|"), F.col("doc_id").cast("string")).cast("binary"))
    # the stated query set (benchmark items) against all documents
    run = answers.seeded_run(b, d, order, max(ks))
    w = b.select("query_id", qa.words(F.col("text")).alias("w"))
    ans = w.select("query_id", F.array_join(F.slice("w", 1, 8), " ").alias("answer"))
    acc = answers.top_k_accuracy(run, answers.answer_hits(run, d, ans), ks, b)
    pairs = ", ".join(f"{k}, accuracy_at_{k}" for k in ks)
    return acc.selectExpr(f"stack({len(ks)}, {pairs}) AS (k, accuracy)") \
        .select("k", F.round("accuracy", 6).alias("accuracy"))


@register("passage_text", ops=("F2", "F3", "F4"), oracle=r"""
SELECT doc_id,
       md5(source || ' ' || text) AS passage_md5,
       md5(regexp_replace(source || ' ' || text, '^\s+|\s+$', '', 'g')) AS trimmed_md5,
       md5(source || text) AS key_md5,
       regexp_matches(source, 'NLI|altlex|captions|duplicate|SimpleWiki|specter_train_triples|WikiAnswers') AS symmetric,
       regexp_matches(source, 'clustering|classification') AS hn_only
FROM documents
""")
def passage_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    title, text = F.col("source"), F.col("text")
    return d.select("doc_id",
                    F.md5(TX.passage_text(title, text)).alias("passage_md5"),
                    F.md5(TX.passage_text_trimmed(title, text)).alias("trimmed_md5"),
                    F.md5(TX.corpus_key(title, text)).alias("key_md5"),
                    TX.is_symmetric(title).alias("symmetric"),
                    TX.is_hn_only(title).alias("hn_only"))
