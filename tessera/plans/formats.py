"""Round trips through the file formats: a driver table is written in a
format under the shared folder and read back with its reader; the SQL twin
works on the table itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import docid_default
from ..operators import mining
from ..session import stage_path, table
from ..sources import readers, sinks
from .registry import register


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _names(df, col):
    """The different values of a column that names languages or domains."""
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())


@register("read_corpus_documents", ops=("S1", "K1"), oracle="""
SELECT doc_id::VARCHAR AS _id, md5(text) AS text_md5, lang FROM documents
""")
def read_corpus_documents(spark, sf_dir):
    path = stage_path(spark, "corpus")
    sinks.write_jsonl(_documents(spark, sf_dir).select(F.col("doc_id").alias("docid"), F.col("text").alias("question"),
                                                       "lang"), path)
    return readers.read_corpus(spark, path).select("_id", F.md5("text").alias("text_md5"), "lang")


@register("beir_last_wins", ops=("S6",), oracle="""
SELECT (doc_id % 100)::VARCHAR AS _id, arg_max(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, doc_id) AS title,
       md5(arg_max(text, doc_id)) AS text_md5
FROM documents GROUP BY 1
""")
def beir_last_wins(spark, sf_dir):
    path = stage_path(spark, "beir")
    rows = _documents(spark, sf_dir).orderBy("doc_id").select(
        F.concat((F.col("doc_id") % 100).cast("string")).alias("_id"),
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("title"), "text")
    sinks.write_jsonl(rows, path)
    return readers.read_beir_jsonl(spark, path).select("_id", "title", F.md5("text").alias("text_md5"))


_PAIR_LINES = """
turns AS (SELECT q.conv_id, q.turn, q.text AS query, a.text AS answer FROM conversations q JOIN conversations a
          ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'),
lines AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM turns)"""


def _pair_lines(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    q = t.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = t.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


@register("train_pairs_conversations", ops=("S2",), oracle=f"""
WITH {_PAIR_LINES}
SELECT 'train-' || idx AS _id, md5(query) AS query_md5, 1 + (conv_id % 4 = 2)::BIGINT AS n_pos, md5(answer) AS last_md5
FROM lines WHERE query <> '' AND conv_id % 4 <> 3
""")
def train_pairs_conversations(spark, sf_dir):
    """Pair, query and set lines, by conversation, in one gzip collection;
    sets of one text are skipped but keep their line number."""
    path = stage_path(spark, "pairs")
    q, a, kind = F.col("query"), F.col("answer"), F.col("conv_id") % 4
    line = (F.when(kind == 0, F.to_json(F.array(q, a)))
            .when(kind == 1, F.to_json(F.struct(q.alias("query"), F.array(F.lit("\t"), a).alias("pos"))))
            .when(kind == 2, F.to_json(F.struct(F.array(q, F.lit("x"), a).alias("set"))))
            .otherwise(F.to_json(F.struct(F.array(q).alias("set")))))
    _pair_lines(spark, sf_dir).orderBy("conv_id", "turn").select(line.alias("value")) \
        .write.option("compression", "gzip").text(path)
    got = readers.read_train_pairs(spark, path)
    return got.select("_id", F.md5("text").alias("query_md5"), F.size("pos").cast("long").alias("n_pos"),
                      F.md5(F.element_at("pos", -1)).alias("last_md5"))


@register("training_groups_passages", ops=("S3", "L3"), oracle="""
SELECT 'train-' || row_number() OVER (ORDER BY doc_id) - 1 AS query_id, md5('{' || source || text) AS string_md5,
       doc_id::VARCHAR AS docid, lang AS title, n_chars::DOUBLE / 4 AS ce_score
FROM documents
""".replace("row_number() OVER (ORDER BY doc_id) - 1", "(row_number() OVER (ORDER BY doc_id) - 1)"))
def training_groups_passages(spark, sf_dir):
    """String passages (starting like an object) beside object passages."""
    path = stage_path(spark, "groups")
    obj = F.struct("doc_id", F.col("doc_id").alias("docid"), F.col("lang").alias("title"),
                   (F.col("n_chars").cast("double") / 4).alias("ce_score"))
    _documents(spark, sf_dir).orderBy("doc_id").select(F.to_json(F.struct(
        F.lit("q").alias("query"), F.array(F.concat(F.lit("{"), "source", "text")).alias("positive_passages"),
        F.array(obj).alias("negative_passages"))).alias("value")).write.text(path)
    got = readers.read_training_groups(spark, path)
    p, n = F.col("positive_passages")[0], F.col("negative_passages")[0]
    return got.select("query_id", F.md5(p["text"]).alias("string_md5"), n["docid"].alias("docid"),
                      n["title"].alias("title"), n["ce_score"].alias("ce_score"))


@register("medmcqa_groups", ops=("S4",), oracle="""
SELECT item_id, md5(text) AS positive_md5, 0::BIGINT AS n_negatives FROM benchmark WHERE item_id % 4 > 1
""")
def medmcqa_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn(
        "exp", F.when(F.col("item_id") % 4 == 1, F.lit("")).when(F.col("item_id") % 4 != 0, F.col("text")))
    return readers.medmcqa_groups(rows).select(
        "item_id", F.md5(F.col("positive_passages")[0]["text"]).alias("positive_md5"),
        F.size("negative_passages").cast("long").alias("n_negatives"))


@register("qrels_roundtrip", ops=("S5",), oracle="""
SELECT (doc_id % 50)::VARCHAR AS query_id, (doc_id % 7)::VARCHAR AS doc_id, arg_max(quality, doc_id) AS score
FROM labels GROUP BY ALL
""")
def qrels_roundtrip(spark, sf_dir):
    path = stage_path(spark, "qrels")
    table(spark, sf_dir, "labels").orderBy("doc_id").select(
        (F.col("doc_id") % 50).alias("query-id"), (F.col("doc_id") % 7).alias("corpus-id"), F.col("quality").alias("score")) \
        .write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_qrels_tsv(spark, path).select("query_id", "doc_id", "score")


@register("language_shards", ops=("S7", "U2"), oracle="""
SELECT doc_id::VARCHAR AS _id, lang, md5(text) AS text_md5 FROM documents WHERE lang IS NOT NULL
""")
def language_shards(spark, sf_dir):
    base = stage_path(spark, "shards")
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("docid"), "text", "lang")
    langs = _names(d, "lang")
    for lang in langs:
        d.where(F.col("lang") == lang).drop("lang").write.option("compression", "gzip").json(f"{base}/{lang}")
    return readers.read_lang_shards(spark, [f"{base}/{x}" for x in langs]).select("_id", "lang", F.md5("text").alias("text_md5"))


@register("topics_roundtrip", ops=("S8",), oracle="""
SELECT item_id::VARCHAR AS query_id, md5('"' || replace(text, chr(10), ' ')) AS text_md5 FROM benchmark
""")
def topics_roundtrip(spark, sf_dir):
    path = stage_path(spark, "topics")
    table(spark, sf_dir, "benchmark").select(F.concat(
        F.col("item_id").cast("string"), F.lit('\t"'), F.replace("text", F.lit("\n"), F.lit(" "))).alias("value")).write.text(path)
    return readers.read_topics_tsv(spark, path).select("query_id", F.md5("text").alias("text_md5"))


@register("trec_qrels_roundtrip", ops=("S9", "J4"), oracle="""
SELECT text_md5, n FROM (
  SELECT md5(b.text) AS text_md5, count(l.doc_id) AS n FROM benchmark b JOIN labels l ON l.doc_id % 20 = b.item_id
  WHERE l.quality >= 1 GROUP BY b.item_id, b.text)
""")
def trec_qrels_roundtrip(spark, sf_dir):
    """Judged queries only (a relevance of 0 judges nothing)."""
    path = stage_path(spark, "trec")
    table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 20).alias("q"), F.lit("Q0").alias("z"), "doc_id", "quality") \
        .write.option("sep", "\t").csv(path)
    qrels = readers.read_trec_qrels(spark, path)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text")
    judged = readers.judged_queries(queries, qrels).withColumnRenamed("_id", "query_id")
    return judged.join(qrels, "query_id").groupBy("query_id", "text").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.md5("text").alias("text_md5"), "n")


@register("run_file_depth", ops=("S10",), oracle="""
SELECT query_id, doc_id, score, rank FROM (
  SELECT 'q ' || label AS query_id, 'd ' || vec_id AS doc_id, (vec_id * 7 % 31)::DOUBLE / 4 AS score,
         row_number() OVER (PARTITION BY label ORDER BY vec_id * 7 % 31 DESC, vec_id) AS rank
  FROM embeddings) WHERE rank <= 20
""")
def run_file_depth(spark, sf_dir):
    """Ids with blanks inside, three and four columns, ties in file order."""
    path = stage_path(spark, "run")
    score = ((F.col("vec_id") * 7 % 31).cast("double") / 4).cast("string")
    q, d = F.concat(F.lit("q "), F.col("label").cast("string")), F.concat(F.lit("d "), F.col("vec_id").cast("string"))
    line = F.when(F.col("vec_id") % 2 == 0, F.concat_ws("\t", q, d, score)) \
        .otherwise(F.concat_ws("\t", F.concat(q, F.lit(" ")), F.lit("Q0"), d, score))
    table(spark, sf_dir, "embeddings").orderBy("vec_id").select(line.alias("value")).write.text(path)
    return readers.read_run_tsv(spark, path, depth=20).select(
        "query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@register("test_query_folder", ops=("S11", "U1", "F5"), oracle="""
WITH b AS (SELECT item_id, replace(item_id || '_' || text, '_', '') AS query FROM benchmark WHERE item_id % 5 <> 0)
SELECT query_id, md5(query) AS query_md5, idx FROM (
  SELECT item_id AS query_id, query, row_number() OVER (ORDER BY item_id % 2, item_id) - 1 AS idx FROM b)
""")
def test_query_folder(spark, sf_dir):
    """A folder of test files; rows of only underscores drop out; the union
    of two sets carries a running index."""
    path = stage_path(spark, "tests")
    text = F.when(F.col("item_id") % 5 == 0, F.lit("___")).otherwise(
        F.concat(F.col("item_id").cast("string"), F.lit("_"), F.col("text")))
    sinks.write_jsonl(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query")), path)
    got = readers.read_test_queries(spark, path).where(F.col("meta.filename").endswith(".json"))
    sets = [got.where(F.col("query_id") % 2 == k).select("query_id", "query").orderBy("query_id") for k in (0, 1)]
    return readers.union_test_sets(*sets).select("query_id", F.md5("query").alias("query_md5"), "idx")


@register("multilingual_qa", ops=("S12",), oracle="""
SELECT item_id::VARCHAR AS query_id, md5(text) AS text_md5, 2::BIGINT AS n_answers,
       CASE WHEN item_id % 2 = 0 THEN 'ar' ELSE 'zh' END AS lang, md5(d.body) AS body_md5
FROM benchmark b JOIN (SELECT doc_id, text AS body FROM documents) d ON d.doc_id = b.item_id
""")
def multilingual_qa(spark, sf_dir):
    """Question files by language and the corpus, joined by id."""
    base = stage_path(spark, "mkqa")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"),
                                                 F.array(F.lit("x"), F.lit("y")).alias("answers"))
    for k, lang in enumerate(("ar", "zh")):
        b.where(F.col("id") % 2 == k).write.json(f"{base}/test/{lang}.jsonl")
    _documents(spark, sf_dir).select(F.col("doc_id").alias("docid"), "text").write.json(f"{base}/corpus")
    qa = readers.read_multilingual_qa(spark, f"{base}/test")
    body = readers.read_multilingual_corpus(spark, f"{base}/corpus").select(
        F.col("_id").alias("query_id"), F.md5("text").alias("body_md5"))
    return qa.join(body, "query_id").select("query_id", F.md5("text").alias("text_md5"),
                                            F.size("answers").cast("long").alias("n_answers"), "lang", "body_md5")


@register("domain_files", ops=("S13", "T5", "U3"), oracle="""
SELECT source AS domain_name, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
       dense_rank() OVER (ORDER BY source) - 1 AS domain_ids
FROM documents WHERE source IS NOT NULL
""")
def domain_files(spark, sf_dir):
    base = stage_path(spark, "domains")
    d = _documents(spark, sf_dir).select("doc_id", "source", F.col("text").alias("query"))
    sinks.write_domain_files(d, base, "source", "doc_id")
    return readers.read_domain_files(spark, base, _names(d, "source")[::-1]).select(
        "domain_name", "doc_id", F.col("_train_dataset_idx").alias("idx"), F.col("domain_ids").cast("long").alias("domain_ids"))


@register("domain_config", ops=("S14", "K3", "A6"), oracle="""
WITH s AS (SELECT source AS domain, count(*) AS size FROM documents GROUP BY source)
SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS domain_id, size,
       round(size::DOUBLE / sum(size) OVER (), 9) AS weight FROM s
""")
def domain_config(spark, sf_dir):
    """A weight table written as a document and read as a configuration."""
    path = stage_path(spark, "config")
    s = _documents(spark, sf_dir).groupBy(F.col("source").alias("domain")).agg(F.count(F.lit(1)).alias("size"))
    ids = F.row_number().over(Window.orderBy("domain")) - 1
    w = s.withColumn("domain_id", ids).withColumn("weight", F.col("size").cast("double")) \
        .withColumn("epoch", F.lit(1.0)).withColumn("kind", F.lit("curr"))
    sinks.write_weight_tables(w, ["kind"], path)
    return readers.read_domain_config(spark, f"{path}/kind=curr").select(
        "domain", "domain_id", "size", F.round("weight", 9).alias("weight"))


@register("id_map_roundtrip", ops=("S15", "V9"), oracle="""
SELECT 'd' || doc_id AS doc_id, row_number() OVER (ORDER BY 'd' || doc_id) - 1 AS row_id FROM documents
""")
def id_map_roundtrip(spark, sf_dir):
    path = stage_path(spark, "id_map")
    corpus = _documents(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("_id"))
    readers.write_id_map(readers.build_id_map(corpus), path)
    return readers.read_id_map(spark, path)


@register("scores_resumed", ops=("K4",), oracle="""
WITH l AS (SELECT min(lang) AS first, max(lang) AS last FROM documents)
SELECT source AS task, lang, count(*)::BIGINT * CASE WHEN lang = last THEN -1 WHEN lang = first THEN 1 ELSE 100 END AS n
FROM documents, l WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY source, lang, first, last
""")
def scores_resumed(spark, sf_dir):
    """First the scores of one language, then of all, times 100: present
    groups stay; then the last language once more, replaced."""
    path = stage_path(spark, "scores")
    s = _documents(spark, sf_dir).where("lang IS NOT NULL AND source IS NOT NULL") \
        .groupBy(F.col("source").alias("task"), "lang").agg(F.count(F.lit(1)).alias("n"))
    langs = _names(s, "lang")
    sinks.append_scores(spark, s.where(F.col("lang") == langs[0]), path)
    sinks.append_scores(spark, s.withColumn("n", F.col("n") * 100), path)
    sinks.append_scores(spark, s.where(F.col("lang") == langs[-1]).withColumn("n", -F.col("n")), path, overwrite=True)
    return spark.read.parquet(path).select("task", "lang", "n")


@register("tokenised_cache", ops=("K5", "F31"), oracle=r"""
SELECT item_id, len(regexp_extract_all(text, '([\p{L}\p{N}\p{M}]+)|([^\p{Z}\p{C}])', 0))::BIGINT AS n FROM benchmark
""")
def tokenised_cache(spark, sf_dir):
    from ..functions import qa
    path = stage_path(spark, "tokens")

    def build():
        return table(spark, sf_dir, "benchmark").select("item_id", qa.words(F.col("text")).alias("text_tokenized"))
    sinks.cached(spark, path, build)
    return sinks.cached(spark, path, build).select("item_id", F.size("text_tokenized").cast("long").alias("n"))


@register("log_lines", ops=("K6", "F27"), oracle="""
SELECT '{"accuracy_at_' || k || '":' || n || ',"step":' || step || '}' AS value
FROM (SELECT (doc_id % 3 + 1) AS step, count(*) AS n FROM documents GROUP BY 1), (SELECT unnest([1, 10]) AS k)
""")
def log_lines(spark, sf_dir):
    from ..functions.schedule import rename_accuracy_key
    s = _documents(spark, sf_dir).groupBy((F.col("doc_id") % 3 + 1).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    keys = spark.createDataFrame([("Accuracy@1",), ("Accuracy@10",)], "k string")
    named = s.join(keys).withColumn("k", rename_accuracy_key(F.col("k"))).groupBy("step").pivot(
        "k", ["accuracy_at_1", "accuracy_at_10"]).agg(F.first("n"))
    parts = [sinks.log_lines(named.select("step", c)) for c in ("accuracy_at_1", "accuracy_at_10")]
    return parts[0].union(parts[1])


@register("id_lookup", ops=("J1", "J3", "A3", "F38"), oracle="""
SELECT q.item_id::VARCHAR AS query_id, (SELECT count(*) FROM documents d WHERE d.doc_id = q.item_id * 3) AS n_pos,
       md5(coalesce((SELECT source || text FROM documents d WHERE d.doc_id = q.item_id * 3), '')) AS first_md5,
       (SELECT count(*) FROM documents d WHERE d.doc_id IN (q.item_id * 5 + 1, q.item_id * 50 + 1)) AS n_neg
FROM benchmark q
""")
def id_lookup(spark, sf_dir):
    """Id-only groups get their texts; ids the corpus lacks fall out of the
    passages and are the rejects of the lookup."""
    corpus = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"),
                                              "text")
    b = table(spark, sf_dir, "benchmark")
    at = lambda k, c: b.select(F.col("item_id").cast("string").alias("query_id"),
                               (F.col("item_id") * k + c).cast("string").alias("docid"), F.lit(k).alias("pos"))
    pos, neg = at(3, 0), at(5, 1).union(at(50, 1)).distinct()
    hits, rejects = readers.lookup_ids(pos.withColumnRenamed("docid", "_id"), corpus)
    known = hits.select("query_id", F.col("_id").alias("docid"), "pos")
    missing = rejects.select("query_id").distinct().withColumn("missing", F.lit(True))
    groups = mining.assemble_groups(b.select(F.col("item_id").alias("_id"), "text"), known,
                                    neg.dropDuplicates(["query_id", "docid"]), corpus)
    first = F.col("positive_passages")[0]
    out = groups.join(missing, "query_id", "left")
    ok = F.when(F.col("missing") & (F.size("positive_passages") > 0), F.raise_error(F.lit("a rejected id has a passage"))) \
        .otherwise(F.size("positive_passages"))
    return out.select("query_id", ok.cast("long").alias("n_pos"),
                      F.md5(F.coalesce(F.concat(first["title"], first["text"]), F.lit(""))).alias("first_md5"),
                      F.size("negative_passages").cast("long").alias("n_neg"))
