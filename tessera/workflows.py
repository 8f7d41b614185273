"""End-to-end entry points matching the reference's three main programs,
each one composition of the library's operators (one Spark plan per
output; nothing passes through the driver).

* :func:`mine_from_pairs` — training pairs -> corpus + qrels -> encode ->
  exact top-k -> depth slice, positives removed, seeded sample -> training
  groups as JSON lines.
* :func:`mine_from_qrels` — the same from queries, corpus and judgements.
* :func:`evaluate_answers` — retrieve, find answers in the passages, accuracy
  at k per language into a resumable score store.
* :func:`decontaminate_files` — training JSONL files vs. test-query files:
  clean lines written verbatim, duplicates report as JSON.
* :func:`group_dro_weights` — per-example loss log + domain config ->
  curr/mean/ema and top-X% weight tables as JSON documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import passage_text
from .operators import answers, dedup, dro, mining, search
from .operators import corpus as C
from .operators.encode import encode
from .session import cut_lineage, number_rows
from .sources import readers, sinks


def mine_from_pairs(spark: SparkSession, pairs_path: str, encoder: Callable[[list[str]], np.ndarray],
                    dim: int, save_to: str | None = None, depth: tuple[int, int] = (2, 100),
                    topk: int = 100, n_sample: int = 16, seed: int = 42,
                    query_prompt: str = "", passage_prompt: str = "") -> DataFrame:
    """Hard-negative mining from a training-pair collection (E1)."""
    pairs = cut_lineage(readers.read_train_pairs(spark, pairs_path).withColumn(
        "row_idx", F.monotonically_increasing_id()), "pairs")
    groups = pairs.select(
        "row_idx", F.col("_id").alias("query_id"),
        F.col("text").alias("query"),
        F.transform("pos", lambda p: F.struct(F.lit("").alias("title"), p.alias("text")))
        .alias("positive_passages"))
    corpus = C.corpus_from_groups(groups)
    qrels = C.qrels_from_groups(groups, corpus).join(groups.select("row_idx", "query_id"), "row_idx")
    # dense numeric query ids for the search kernel
    ids = number_rows(groups.select("query_id").distinct(), ["query_id"], "qnum")
    # the model runs once over each side
    q_vec = cut_lineage(encode(groups.select("query_id", "query"), encoder, dim, "query_id", "query", query_prompt),
                        "query_vectors")
    d_vec = cut_lineage(encode(corpus.select("corpus_idx", passage_text(F.col("title"), F.col("text")).alias("t")),
                   encoder, dim, "corpus_idx", "t", passage_prompt), "passage_vectors")
    run = search.knn(q_vec.join(ids, "query_id").select(F.col("qnum").alias("query_id"), "embedding"),
                     d_vec.withColumnRenamed("corpus_idx", "doc_id"), topk, "dot")
    pos = (qrels.join(ids, "query_id")
           .select(F.col("qnum").alias("query_id"), F.col("corpus_idx").alias("doc_id"), F.lit(1).alias("rel"))
           .distinct())
    judged = run.join(pos, ["query_id", "doc_id"], "left").fillna(0, ["rel"])
    negs = mining.sample_hard_negatives(judged, depth, n_sample, seed)
    psg = corpus.select(F.col("corpus_idx"), F.struct(F.col("_id").alias("docid"), "title", "text").alias("p"))
    back = ids.select(F.col("query_id").alias("qid"), F.col("qnum").alias("query_id"))
    neg_groups = (negs.join(back, "query_id")
                  .join(psg, F.col("doc_id") == F.col("corpus_idx"))
                  .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("sample_rank", "p"))).alias("_n"))
                  .select(F.col("qid").alias("query_id"), F.transform("_n", lambda s: s["p"]).alias("negative_passages")))
    pos_groups = (qrels.join(psg, "corpus_idx").groupBy("query_id")
                  .agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("_p"))
                  .select("query_id", F.transform("_p", lambda s: s["p"]).alias("positive_passages")))
    empty = F.array().cast("array<struct<docid:string,title:string,text:string>>")
    out = (groups.select("query_id", "query").join(pos_groups, "query_id", "left")
           .join(neg_groups, "query_id", "left")
           .select("query_id", "query", F.coalesce("positive_passages", empty).alias("positive_passages"),
                   F.coalesce("negative_passages", empty).alias("negative_passages")))
    if save_to:
        sinks.write_jsonl(out, save_to)
    return out


def _search_texts(queries: DataFrame, corpus: DataFrame, encoder, dim: int, k: int, query_prompt: str,
                  passage_prompt: str, score_function: str = "dot") -> DataFrame:
    """Top-k of texts (``_id, text`` against ``_id, title, text``):
    ``query_id, doc_id`` (the given ids), ``score, rank``.  The model runs
    once over each side; the search works on dense numbers."""
    q = number_rows(queries.select("_id", "text"), ["_id"], "n")
    title = F.col("title") if "title" in corpus.columns else None
    d = number_rows(corpus.select("_id", passage_text(title, F.col("text")).alias("text")), ["_id"], "n")
    q, d = cut_lineage(q, "numbered_queries"), cut_lineage(d, "numbered_corpus")
    vectors = [cut_lineage(encode(x, encoder, dim, "n", "text", p), "vectors")
               for x, p in ((q, query_prompt), (d, passage_prompt))]
    run = search.knn(vectors[0].withColumnRenamed("n", "query_id"), vectors[1].withColumnRenamed("n", "doc_id"), k,
                     score_function)
    ids = lambda x, c: x.select(F.col("_id").alias(c), F.col("n").alias(f"_{c}"))
    return run.withColumnsRenamed({"query_id": "_query_id", "doc_id": "_doc_id"}) \
        .join(ids(q, "query_id"), "_query_id").join(ids(d, "doc_id"), "_doc_id") \
        .select("query_id", "doc_id", "score", "rank")


def mine_from_qrels(spark: SparkSession, queries: DataFrame, corpus: DataFrame, qrels: DataFrame,
                    encoder: Callable[[list[str]], np.ndarray], dim: int, depth: tuple[int, int] = (2, 100),
                    topk: int = 100, n_sample: int = 16, seed: int = 42, query_prompt: str = "",
                    passage_prompt: str = "") -> tuple[DataFrame, DataFrame]:
    """Hard-negative mining from judgements (E1): (training groups, positives
    that the corpus lacks).  ``queries``: _id, text; ``corpus``: _id, title,
    text; ``qrels``: query_id, doc_id, score.  Repeated judgements count
    once; a judged query without a text, and a query without any negative
    candidate, are errors."""
    pos = cut_lineage(qrels.where("score > 0").select("query_id", "doc_id").distinct(), "positives")
    judged = pos.select(F.col("query_id").alias("_id")).distinct()
    asked, lost = readers.lookup_ids(judged, queries)
    n_lost = lost.count()
    if n_lost:
        raise KeyError(f"{n_lost} judged queries have no text")
    known, missing = readers.lookup_ids(pos.withColumnRenamed("doc_id", "_id"), corpus.select("_id"))
    run = cut_lineage(_search_texts(asked, corpus, encoder, dim, topk, query_prompt, passage_prompt), "run")
    rel = pos.withColumn("rel", F.lit(1))
    marked = run.join(rel, ["query_id", "doc_id"], "left").fillna(0, ["rel"])
    negs = cut_lineage(mining.sample_hard_negatives(marked, depth, n_sample, seed), "negatives")
    mining.require_candidates(pos.select("query_id").distinct(), negs)
    groups = mining.assemble_groups(
        asked, known.select("query_id", F.col("_id").alias("docid"), F.col("_id").alias("pos")),
        negs.select("query_id", F.col("doc_id").alias("docid"), F.col("sample_rank").alias("pos")), corpus)
    return groups, missing.select("query_id", F.col("_id").alias("doc_id"))


def evaluate_answers(spark: SparkSession, queries: DataFrame, corpus: DataFrame,
                     encoder: Callable[[list[str]], np.ndarray], dim: int, store: str,
                     ks: tuple[int, ...] = (1, 3, 5, 10, 20, 100), task: str = "QA", overwrite: bool = False,
                     query_prompt: str = "", passage_prompt: str = "") -> DataFrame:
    """Accuracy at k of open-domain questions per language (P6).
    ``queries``: lang, query_id, text, answers (array); ``corpus``: _id,
    title, text.  One search answers all languages not yet in ``store``
    (with ``overwrite``: all); a query scores at k when one of its top-k
    passages holds an answer.  Returns the whole store: task, lang and
    ``accuracy_at_k`` columns, rounded to five digits."""
    todo = queries
    if not overwrite and sinks.exists(spark, store):
        done = spark.read.parquet(store).where(F.col("task") == task).select("lang").distinct()
        todo = queries.join(done, "lang", "left_anti")
    todo = cut_lineage(todo.withColumn("_id", F.concat_ws("|", "lang", "query_id")), "todo")
    if not todo.isEmpty():
        run = cut_lineage(_search_texts(todo, corpus, encoder, dim, max(ks), query_prompt, passage_prompt), "run")
        texts = corpus.select(F.col("_id").alias("doc_id"), passage_text(F.col("title"), F.col("text")).alias("text"))
        wanted = todo.select(F.col("_id").alias("query_id"), F.explode("answers").alias("answer"))
        hits = answers.answer_hits(run, texts, wanted)
        first = run.join(hits, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
        per = todo.select("lang", F.col("_id").alias("query_id")).join(first, "query_id", "left")
        scores = per.groupBy("lang").agg(*[
            F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 5).alias(f"accuracy_at_{k}") for k in ks])
        sinks.append_scores(spark, scores.withColumn("task", F.lit(task)), store, overwrite=overwrite)
    return spark.read.parquet(store).where(F.col("task") == task)


def decontaminate_files(spark: SparkSession, train_paths: list[str], test_folder: str,
                        clean_out: str, report_out: str, k: int = 2) -> tuple[int, int]:
    """Split training JSONL files against a folder of test queries (E2).
    Clean lines are written verbatim; the report only when non-empty.
    Returns (clean rows, reported rows)."""
    raw = spark.read.text(train_paths).withColumn("_line", F.monotonically_increasing_id())
    parsed = raw.withColumn("_j", F.from_json("value", "struct<query_id:string,query:string>")) \
        .select("_line", "value", F.col("_j.query_id").alias("query_id"), F.col("_j.query").alias("query"))
    test = readers.read_test_queries(spark, test_folder) \
        .withColumn("test_idx", F.monotonically_increasing_id()) \
        .select("test_idx", F.col("query_id").alias("test_query_id"), F.col("query").alias("test_query"),
                F.col("meta.filename").alias("filename"))
    clean, report = dedup.decontaminate(parsed, test, ["_line"], ["test_idx"], "query", "test_query", k,
                                        test_payload=["test_query_id", "test_query", "filename"])
    clean = cut_lineage(clean, "clean")
    sinks.write_verbatim(clean, clean_out)
    rep = report.join(parsed.select("_line", "query_id"), "_line").select("query_id", "query", "test_dups")
    sinks.write_if_any(rep, report_out)
    return clean.count(), rep.count()


def group_dro_weights(loss_rows: DataFrame, config_path: str, lr: float = 0.02, accum_steps: int = 4,
                      max_norm: float = 1.0, ema: float = 0.1, minus_ref: bool = False,
                      normalize_with_ref: bool = False, p_norm: float = 1.0,
                      percents=(20, 30, 40, 50, 60, 70, 80, 90)) -> DataFrame:
    """Group-DRO weight tables (E3): ``run_id, table, json`` where table is
    curr / mean / ema / topXX and json a domain-config document."""
    spark = loss_rows.sparkSession
    cfg = readers.read_domain_config(spark, config_path)
    domains = [r["domain"] for r in cfg.select("domain").collect()]   # configuration
    init = {r["domain"]: r["weight"] for r in cfg.select("domain", "weight").collect()}
    rows = dro.proxy_loss(loss_rows, minus_ref, normalize_with_ref, p_norm)
    g = dro.clip_gradient(dro.group_gradient(rows, domains, accum_steps), max_norm)
    a = dro.ema_weights(dro.sgd_weights(dro.with_lr(g, lr), init), init, ema)
    sizes = cfg.select("domain", "size")
    ids = cfg.select("domain", "domain_id")
    fin = dro.final_weights(a, {"curr": "alpha", "mean": "alpha_mean", "ema": "alpha_ema"})
    base = dro.with_epochs(fin, sizes).join(ids, "domain")
    tables = sinks.weight_tables_json(base, ["run_id", "kind"]).withColumnRenamed("kind", "table")
    curr = fin.where(F.col("kind") == "curr").join(ids, "domain").select("run_id", "domain", "domain_id", "weight")
    top = dro.top_percent(curr, sizes, percents).select(
        "run_id", F.concat(F.lit("top"), F.col("percent").cast("string")).alias("table"), "domain",
        F.col("new_id").alias("domain_id"), "weight", "size", "epoch")
    top_docs = sinks.weight_tables_json(top, ["run_id", "table"])
    return tables.unionByName(top_docs)
