"""Answer matching.

Per (query, passage) pairs of a run, :func:`tessera.functions.qa.has_answers`
is a row expression.  To find *every* passage that contains an answer,
:func:`contained_answers` builds an automaton over all answers' tokens, whose
failure links find every answer that ends at a token in one pass over a
passage, and emits one row for each passage and answer that it holds: nothing
but those rows leaves a passage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import qa
from ..session import cut_lineage, join_small, spread

#: UTF-8 bytes of the answers of one automaton.  A node takes some 60 bytes
#: and there is at most one for a character.
AUTOMATON_BYTES = 2 << 20


def _automaton(patterns: list[str]):
    import ahocorasick
    found = ahocorasick.Automaton()
    for number, pattern in enumerate(patterns):
        found.add_word(pattern, number)
    found.make_automaton()
    return found


def contained_answers(passages: DataFrame, answers: DataFrame, p_id: str = "doc_id",
                      a_id: str = "item_id", p_text: str = "text", a_text: str = "text",
                      normalize: bool = True, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """All (passage, answer) pairs where the answer's uncased tokens appear
    contiguously in the passage's tokens, with ``all_passages`` false.  An
    answer without tokens matches every passage: it is one row with a null
    passage id and ``all_passages`` true, never expanded to all pairs.

    Plan: passages are tokenised once and stored as tokens between separators;
    the different answers are dealt by hash into shards of about
    ``automaton_bytes``.  A shard is broadcast - its size is the bound - and
    every task builds its automaton and streams the stored passages through
    it.  Answers of one token sequence are one pattern and join their ids to
    what was found.
    """
    def prep(c):
        return qa.nfd(c) if normalize else c

    spark = answers.sparkSession
    every = cut_lineage(answers.select(F.col(a_id).alias("aid"), qa.words(prep(F.col(a_text))).alias("aw"))
                        .where(F.col("aw").isNotNull())
                        .select("aid", F.size("aw").alias("n"), qa.sentinel_join(F.col("aw")).alias("key")), "answer_words")
    free = every.where(F.col("n") == 0).select(
        F.lit(None).cast(dict(passages.dtypes)[p_id]).alias(p_id), F.col("aid").alias(a_id),
        F.lit(True).alias("all_passages"))
    some = every.where(F.col("n") > 0)
    patterns = some.select("key").distinct()
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0]
    shards = size // automaton_bytes + 1
    texts = spread(passages.select(F.col(p_id).alias("pid"), F.col(p_text).alias("_t")).where(F.col("_t").isNotNull()))
    texts = cut_lineage(texts.select("pid", qa.sentinel_join(qa.words(prep(F.col("_t")))).alias("tokens")), "passage_words")
    schema = f"pid {dict(passages.dtypes)[p_id]}, key string"

    def search(shared):
        def run(batches):
            keys = shared.value
            automaton = _automaton(keys)
            for batch in batches:
                at, hits = [], []
                for row, text in enumerate(batch.column(1)):
                    here = {number for _, number in automaton.iter(text.as_py())}
                    at.extend([row] * len(here))
                    hits.extend(sorted(here))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array([keys[h] for h in hits], pa.string())],
                    names=["pid", "key"])
        return run

    found = None
    for shard in range(shards if size else 0):
        keys = patterns.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard).orderBy("key").toArrow()["key"].to_pylist()
        if keys:
            hits = texts.mapInArrow(search(spark.sparkContext.broadcast(keys)), schema)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return free
    # an answer's sequence is found in a passage once
    return found.join(some.select("aid", "key"), "key").select(
        F.col("pid").alias(p_id), F.col("aid").alias(a_id), F.lit(False).alias("all_passages")).unionByName(free)


def seeded_run(queries: DataFrame, passages: DataFrame, order: Column, k: int) -> DataFrame:
    """``query_id, doc_id, rank``: the first ``k`` of all passages of each query
    by ``order`` (lower-case hex digits of a hash of both ids, nulls first),
    then ``doc_id``.  Pairs whose hash lies above a bound that ``k`` of each
    query's pairs undercut cannot be among the first, so they are dropped where
    they are made; the bound is raised until that holds for every query."""
    n = passages.count()
    pairs = queries.select("query_id").join(passages.select("doc_id")).withColumn("_o", order)
    asked = queries.select("query_id").distinct().count()
    part = 2 * k / max(n, 1)
    while part < 0.5:
        low = cut_lineage(pairs.where(F.col("_o").isNull() | (F.col("_o") < f"{int(part * 2 ** 32):08x}")), "low_pairs")
        full = low.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).count()
        if full == asked:
            pairs = low
            break
        part *= 4
    ranked = Window.partitionBy("query_id").orderBy("_o", "doc_id")
    return cut_lineage(pairs.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
                       .select("query_id", "doc_id", "rank"), "run")


def answer_hits(run: DataFrame, passages: DataFrame, answers: DataFrame, normalize: bool = True) -> DataFrame:
    """``query_id, doc_id``: retrieved passages that hold an answer of their
    query (J11, F34).  ``run``: query_id, doc_id; ``passages``: doc_id, text;
    ``answers``: query_id, answer, one row each.  Only retrieved passages are
    tokenised; an answer without tokens is in every passage."""
    def prep(c):
        return qa.nfd(c) if normalize else c

    pairs = run.select("query_id", "doc_id").distinct()
    texts = join_small(passages, pairs.select("doc_id").distinct(), "doc_id", "left_semi") \
        .select("doc_id", qa.words(prep(F.col("text"))).alias("pw"))
    aw = answers.select("query_id", qa.words(prep(F.col("answer"))).alias("aw")).where(F.col("aw").isNotNull())
    asked = cut_lineage(pairs.join(aw, "query_id"), "asked_words")
    return (join_small(cut_lineage(texts, "retrieved_words"), asked, "doc_id")
            .where(qa.contains_tokens(F.col("pw"), F.col("aw"))).select("query_id", "doc_id").distinct())


def top_k_accuracy(run: DataFrame, hits: DataFrame, ks: list[int], n_queries: DataFrame) -> DataFrame:
    """Answer-based accuracy@k (A12): a query scores at k when any of its
    top-k passages has an answer.  ``run``: query_id, doc_id, rank;
    ``hits``: query_id, doc_id pairs with an answer; divided by the number
    of queries in ``n_queries`` (one row per evaluated query)."""
    j = run.join(hits.withColumn("_hit", F.lit(1)), ["query_id", "doc_id"], "left")
    best = j.where(F.col("_hit") == 1).groupBy("query_id").agg(F.min("rank").alias("first"))
    total = n_queries.count()
    q = n_queries.select("query_id").join(best, "query_id", "left")
    return q.agg(*[(F.sum(F.when(F.col("first") <= k, 1).otherwise(0)) / F.lit(total))
                   .alias(f"accuracy_at_{k}") for k in ks])
