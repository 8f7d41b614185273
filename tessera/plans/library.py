"""Queries that run the remaining column functions and small operators over
the driver tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import eval_instructions as EI
from ..functions import qa, simhash
from ..functions import text as TX
from ..functions import vectors as V
from ..functions.qa import normalized
from ..functions.schedule import rename_metric_key
from ..operators import encode, losses
from ..sources import readers
from ..session import number_rows, stage_path, table
from .registry import register


@register("has_chinese", ops=("F6",), oracle=r"""
SELECT doc_id, regexp_matches(t, '[\x{4e00}-\x{9fff}]') AS chinese
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(20013) WHEN doc_id % 3 = 1 THEN text || chr(12354)
             ELSE text END AS t FROM documents)
""")
def has_chinese(spark, sf_dir):
    """An ideograph, kana or neither at the end of a text."""
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("\u4e2d")).when(F.col("doc_id") % 3 == 1, F.lit("\u3042"))
                 .otherwise(F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", simhash.has_chinese(t).alias("chinese"))


_TASKS = [("STS", "STSB"), ("Summarization", "SummEval"), ("Retrieval", "NFCorpus"), ("Retrieval", "nfcorpus"),
          ("Retrieval", "fiqa"), ("Retrieval", "CQADupstackGaming"), ("Reranking", "SciDocsRR"),
          ("PairClassification", "SciDocsRR"), ("Retrieval", "MSMARCO")]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _eval_sql() -> str:
    names = {**EI.RETRIEVAL, **{k.lower(): v for k, v in EI.RETRIEVAL.items()},
             **{a: EI.RETRIEVAL[t] for a, t in EI.RETRIEVAL_ALIASES.items()}}
    rows = []
    for tt, tn in _TASKS:
        text = EI.TYPE_INSTRUCTIONS.get(tt) or (
            EI.CQADUPSTACK_INSTRUCTION if tn.lower().startswith(EI.CQADUPSTACK_PREFIX) else
            EI.RERANKING.get(tn) if tt in ("Reranking", "PairClassification") else names.get(tn))
        rows.append(f"({_sql_text(tt)}, {_sql_text(tn)}, {_sql_text(text)})")
    return f"""
WITH dim(task_type, task_name, instruction) AS (VALUES {', '.join(rows)}),
t AS (SELECT b.item_id, dim.* FROM benchmark b JOIN
      (SELECT *, row_number() OVER (ORDER BY task_type, task_name) - 1 AS k FROM dim) dim ON b.item_id % {len(_TASKS)} = dim.k)
SELECT item_id, task_name,
       md5('Instruct: ' || instruction || chr(10) || 'Query: ' || 'x') AS query_md5,
       md5(CASE WHEN task_type IN ('Reranking', 'Retrieval') THEN 'x'
                ELSE 'Instruct: ' || instruction || chr(10) || 'Query: x' END) AS corpus_md5,
       CASE WHEN task_type = 'Retrieval' THEN 'Represent this sentence for searching relevant passages: ' ELSE '' END AS bge,
       CASE WHEN task_name = 'MSMARCO' THEN 'dev' WHEN item_id % 2 = 0 THEN 'test' ELSE 'train,validation' END AS splits
FROM t"""


@register("eval_prompts", ops=("F13", "F14", "F37", "F9"), oracle=_eval_sql())
def eval_prompts(spark, sf_dir):
    """Each benchmark item is a row of one of nine tasks."""
    tasks = sorted(_TASKS)
    dim = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(tasks)], "k int, task_type string, task_name string")
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % len(tasks)).cast("int").alias("k"))
    t = EI.with_eval_instruction(b.join(F.broadcast(dim), "k"), spark)
    q, c = TX.eval_prompts(F.col("task_type"), F.col("instruction"), "e5")
    bge, _ = TX.eval_prompts(F.col("task_type"), F.col("instruction"), "bge")
    splits = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("train"), F.lit("test"))) \
        .otherwise(F.array(F.lit("train"), F.lit("validation")))
    return t.select("item_id", "task_name", F.md5(TX.with_prompt(q, F.lit("x"))).alias("query_md5"),
                    F.md5(TX.with_prompt(c, F.lit("x"))).alias("corpus_md5"), bge.alias("bge"),
                    F.array_join(TX.eval_split(F.col("task_name"), splits), ",").alias("splits"))


@register("train_prompts", ops=("F10", "F11", "F15"), oracle="""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'AllNLI' WHEN doc_id % 4 = 1 THEN 'msmarco'
                    WHEN doc_id % 4 = 2 THEN 'amazon_classification' ELSE 'quora_duplicates' END AS task,
       doc_id % 4 IN (0, 3) AS symmetric, doc_id % 4 = 2 AS hn_only,
       CASE WHEN doc_id % 4 IN (0, 3) THEN '' ELSE 'Represent this sentence for searching relevant passages: ' END AS bge
FROM documents
""")
def train_prompts(spark, sf_dir):
    m = F.col("doc_id") % 4
    task = F.when(m == 0, "AllNLI").when(m == 1, "msmarco").when(m == 2, "amazon_classification").otherwise("quora_duplicates")
    d = table(spark, sf_dir, "documents").select("doc_id", task.alias("task"))
    none = F.lit(None).cast("array<string>")
    return d.select("doc_id", "task", TX.is_symmetric(F.col("task")).alias("symmetric"),
                    TX.is_hn_only(F.col("task")).alias("hn_only"),
                    TX.train_prompt(F.col("task"), none, F.lit(0), "bge").alias("bge"))


_TOKENS = """
t AS (SELECT label AS doc_id, vec_id AS pos, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 END AS mask,
             vec_id % 3 AS layer FROM embeddings),
m AS (SELECT doc_id, layer, i, avg(x) AS x FROM (SELECT doc_id, layer, generate_subscripts(v, 1) AS i, unnest(v) AS x
      FROM t WHERE mask = 1) GROUP BY ALL)"""


@register("pooling", ops=("F20",), oracle=f"""
WITH {_TOKENS},
mean AS (SELECT doc_id, 'mean' AS kind, i, avg(x) AS x FROM (SELECT doc_id, generate_subscripts(v, 1) AS i, unnest(v) AS x
         FROM t WHERE mask = 1) GROUP BY ALL),
ends AS (SELECT doc_id, arg_min(v, pos) AS cls, arg_max(CASE WHEN mask = 1 THEN v END, CASE WHEN mask = 1 THEN pos END) AS last
         FROM t GROUP BY doc_id),
every AS (
  SELECT * FROM mean
  UNION ALL SELECT doc_id, 'cls', generate_subscripts(cls, 1), unnest(cls) FROM ends
  UNION ALL SELECT doc_id, 'lasttoken', generate_subscripts(last, 1), unnest(last) FROM ends
  UNION ALL SELECT doc_id, 'avg_first_last', i, avg(x) FROM m WHERE layer IN (0, 1) GROUP BY ALL
  UNION ALL SELECT doc_id, 'avg_top2', i, avg(x) FROM m WHERE layer IN (1, 2) GROUP BY ALL)
SELECT doc_id, kind, round(sum(x * i), 6) AS weighted, count(*) AS dim FROM every GROUP BY doc_id, kind
""")
def pooling(spark, sf_dir):
    """A label's vectors as the tokens of one document, in three layers."""
    tokens = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("vec"),
        F.when(F.col("vec_id") % 5 == 0, 0).otherwise(1).alias("mask"), (F.col("vec_id") % 3).alias("layer"))
    out = None
    for kind in ("mean", "cls", "lasttoken", "avg_first_last", "avg_top2"):
        one = encode.pool(tokens, kind, layer="layer").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    w = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("doc_id", "kind", F.round(w, 6).alias("weighted"), F.size("embedding").cast("long").alias("dim"))


@register("projection", ops=("F21", "V9"), oracle="""
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, round(sum(x * (i % 3)) + 0.5, 6) AS a, round(sum(x * (i % 3 + 1)) - 0.5, 6) AS b FROM x GROUP BY vec_id
""")
def projection(spark, sf_dir):
    """Saved and loaded vectors times a matrix."""
    path = stage_path(spark, "vectors")
    encode.save_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    i = np.arange(1, 65) % 3
    got = encode.project(encode.load_vectors(spark, path), np.stack([i, i + 1.0], axis=1), np.array([0.5, -0.5]))
    return got.select("vec_id", F.round(F.col("embedding")[0], 6).alias("a"), F.round(F.col("embedding")[1], 6).alias("b"))


@register("packed_signs", ops=("F22", "F23", "V2"), oracle="""
SELECT a.vec_id, 1::BIGINT AS words,
       list_sum(list_transform(a.embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE -1 END))::BIGINT AS sign_sum,
       list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a.embedding[i] > 0) <> (b.embedding[i] > 0) THEN 1 ELSE 0 END))::BIGINT
         AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)
""")
def packed_signs(spark, sf_dir):
    """Bits of each vector, unpacked again, and the distance to the next."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.binarize(F.col("embedding")).alias("bits"))
    n = e.count()
    other = e.select(((F.col("vec_id") + n - 1) % n).alias("vec_id"), F.col("bits").alias("next"))
    signs = V.unpack_signs(F.col("bits"), 64)
    return e.join(other, "vec_id").select(
        "vec_id", F.size("bits").cast("long").alias("words"),
        F.aggregate(signs, F.lit(0.0), lambda s, x: s + x).cast("long").alias("sign_sum"),
        V.hamming_words(F.col("bits"), F.col("next")).cast("long").alias("distance"))


@F.arrow_udf(T.StringType())
def _composed(texts: pa.Array) -> pa.Array:
    return normalized(texts, "NFC")


@register("decomposed_texts", ops=("F30",), oracle="""
SELECT doc_id, md5(nfc_normalize(text || chr(233) || 'e' || chr(769))) AS composed_md5,
       (length(text) < length(nfc_normalize(text)) + 2) AS same FROM documents
""")
def decomposed_texts(spark, sf_dir):
    """Decomposition undone by composition is composition; SQL has only the
    latter."""
    d = table(spark, sf_dir, "documents").select("doc_id", qa.nfd(F.concat("text", F.lit("\u00e9e\u0301"))).alias("t"))
    apart = F.regexp_count("t", F.lit("e\u0301")) >= 2
    return d.select("doc_id", F.md5(_composed("t")).alias("composed_md5"), apart.alias("same"))


@register("regex_answers", ops=("F35",), oracle="""
SELECT doc_id, regexp_matches(text, '(?i)the\\s+and') AS found, false AS broken FROM documents
""")
def regex_answers(spark, sf_dir):
    """A pattern in any case, and one that does not compile."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", qa.regex_match(F.col("text"), F.lit(r"THE\s+AND")).alias("found"),
                    qa.regex_match(F.col("text"), F.lit("(")).alias("broken"))


@register("tag_runs", ops=("F36",), oracle="""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'O' ELSE upper(role[1]) END AS tag, text AS token
           FROM conversations),
n AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM (
  SELECT *, (tag IS DISTINCT FROM lag(tag) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS new FROM t))
SELECT conv_id, min(turn) AS start, tag, string_agg(token, ' ' ORDER BY turn) AS text
FROM n WHERE tag <> 'O' GROUP BY conv_id, grp, tag
""")
def tag_runs(spark, sf_dir):
    """Roles as tags: runs of turns of one role."""
    t = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", "O").otherwise(F.upper(F.substring("role", 1, 1))).alias("tag"),
        F.col("text").alias("token"))
    return qa.entity_groups(t, "conv_id", "turn")


@register("single_domain_loss", ops=("L4", "F26"), oracle="""
WITH b AS (SELECT event_id // 4 AS batch_id, event_type, value FROM events),
one AS (SELECT batch_id, min(event_type) AS domain, avg(value) AS loss FROM b GROUP BY batch_id
        HAVING count(DISTINCT event_type) = 1)
SELECT batch_id, domain, round(loss, 6) AS loss,
       CASE WHEN batch_id % 3 = 0 THEN 'eval/loss' WHEN batch_id % 3 = 1 THEN 'test/loss' ELSE 'train/loss' END AS key
FROM one
""")
def single_domain_loss(spark, sf_dir):
    """Batches of four events; losses only of those with one domain, under
    their logging keys."""
    b = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).cast("long").alias("batch_id"),
                                              F.col("event_type").alias("domain"), "value")
    means = b.groupBy("batch_id").agg(F.avg("value").alias("loss"))
    out = losses.single_domain_loss(means, b.select("batch_id", "domain"))
    m = F.col("batch_id") % 3
    key = rename_metric_key(F.when(m == 0, "eval_loss").when(m == 1, "test_loss").otherwise("loss"))
    return out.select("batch_id", "domain", F.round("loss", 6).alias("loss"), key.alias("key"))


@register("encoded_texts", ops=("V8", "T1"), oracle="""
SELECT item_id::VARCHAR AS _id, length('query: ' || text)::DOUBLE AS a, 1.0::DOUBLE AS b,
       row_number() OVER (ORDER BY length(text) DESC, item_id::VARCHAR) - 1 AS place
FROM benchmark
""")
def encoded_texts(spark, sf_dir):
    """A user encoder over prompted texts; the longest passages first."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text")
    v = encode.encode(b, lambda texts: np.array([[len(t), 1.0] for t in texts]), 2, prompt="query: ")
    order = number_rows(b.select("_id", F.length("text").alias("length")), [F.desc("length"), "_id"], "place") \
        .select("_id", "place")
    return v.join(order, "_id").select("_id", F.col("embedding")[0].cast("double").alias("a"),
                                       F.col("embedding")[1].cast("double").alias("b"), "place")


@register("category_union", ops=("U2", "U3"), oracle="""
WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS place FROM (SELECT DISTINCT source FROM documents)
           WHERE source IS NOT NULL)
SELECT doc_id, source AS domain_name, CASE WHEN place % 3 = 0 THEN 0 ELSE 1 END AS domain_ids,
       CASE WHEN place % 2 = 1 THEN n_chars END AS n_chars
FROM documents JOIN s USING (source)
""")
def category_union(spark, sf_dir):
    """All domains, every second with a column more, concatenated into two
    categories."""
    d = table(spark, sf_dir, "documents")
    names = sorted(r[0] for r in d.select("source").where("source IS NOT NULL").distinct().collect())
    parts = [d.where(F.col("source") == s).select("doc_id", F.col("source").alias("domain_name"),
                                                  *(["n_chars"] if i % 2 else [])) for i, s in enumerate(names)]
    bridge = spark.createDataFrame([("y" if i % 3 else "x", s) for i, s in enumerate(names)], "category string, domain string")
    return readers.category_union(readers.align_union(parts), bridge, {"x": 0, "y": 1}).select(
        "doc_id", "domain_name", F.col("domain_ids").cast("int").alias("domain_ids"), "n_chars")
