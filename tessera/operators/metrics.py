"""Retrieval metrics as grouped aggregations over a judged run.

A *run* is ``query_id, doc_id, score, rank`` (rank 1-based).  A *judged*
run adds ``rel`` (graded relevance, 0 when unjudged: left join, J12).
Per-query values are computed in one grouped pass for all cut-offs, then
averaged over the judged queries (queries with at least one relevant
document; a judged query missing from the run scores 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, join_small

METRICS = ("ndcg", "map", "recall", "precision", "mrr", "accuracy")


def judge(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Left join a run to qrels (``query_id, doc_id, rel``); missing = 0.  The
    run is written once; judgements of other pairs are dropped where they are
    read, before any shuffle, while the run's pairs fit a broadcast."""
    run = cut_lineage(run, "run")
    pairs = run.select("query_id", "doc_id").distinct()
    known = join_small(qrels.select("query_id", "doc_id", "rel"), pairs, ["query_id", "doc_id"], "left_semi")
    return (run.join(known, ["query_id", "doc_id"], "left")
            .withColumn("rel", F.coalesce(F.col("rel"), F.lit(0))))


def _log2(x):
    return F.log2(x.cast("double"))


def ideal_dcg_binary(n_rel: DataFrame, k: int) -> DataFrame:
    """Ideal DCG@k for binary relevance: sum_{i<=min(k,n_rel)} 1/log2(i+1)."""
    return n_rel.withColumn(
        f"idcg_{k}",
        F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.col("n_rel")), F.lit(1))),
                    F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
        * F.when(F.col("n_rel") > 0, 1.0).otherwise(0.0))


def query_base_from_qrels(qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Per judged query: number of relevant docs and ideal DCG@k for graded
    relevance.  Equal grades are alike in
    an ideal order, so the judgements are counted by grade, never sorted."""
    grades = qrels.where(F.col("rel") > 0).groupBy("query_id", "rel").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("query_id").orderBy(F.col("rel").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = grades.withColumn("lo", F.coalesce(F.sum("n").over(before), F.lit(0)))
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1

    def ideal(k):
        places = F.sequence(F.col("lo") + 1, F.least(F.col("lo") + F.col("n"), F.lit(k).cast("long")))
        return F.when(F.col("lo") < k, F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / _log2(i + 1)) * gain).otherwise(0.0)
    return placed.groupBy("query_id").agg(
        F.sum("n").alias("n_rel"), *[F.sum(ideal(k)).alias(f"idcg_{k}") for k in ks]).where(F.col("query_id").isNotNull())


def per_query(judged: DataFrame, base: DataFrame, ks: list[int]) -> DataFrame:
    """One row per judged query with ``{metric}_{k}`` columns."""
    w = (Window.partitionBy("query_id").orderBy("rank")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = (F.col("rel") > 0).cast("int")
    j = judged.withColumn("hits_so_far", F.sum(hit).over(w))
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [
            F.sum(F.when(inside, (F.pow(F.lit(2.0), F.col("rel")) - 1) / _log2(F.col("rank") + 1))
                  .otherwise(0.0)).alias(f"dcg_{k}"),
            F.sum(F.when(inside & (F.col("rel") > 0), F.col("hits_so_far") / F.col("rank"))
                  .otherwise(0.0)).alias(f"ap_{k}"),
            F.sum(F.when(inside, hit).otherwise(0)).alias(f"hits_{k}"),
            F.max(F.when(inside & (F.col("rel") > 0), 1.0 / F.col("rank")).otherwise(0.0))
            .alias(f"rr_{k}"),
        ]
    agg = j.groupBy("query_id").agg(*aggs)
    b = base.join(agg, "query_id", "left").na.fill(0)
    cols = ["query_id"]
    for k in ks:
        cols += [
            F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).otherwise(0.0)
            .alias(f"ndcg_{k}"),
            (F.col(f"ap_{k}") / F.col("n_rel")).alias(f"map_{k}"),
            (F.col(f"hits_{k}") / F.col("n_rel")).alias(f"recall_{k}"),
            (F.col(f"hits_{k}") / F.lit(float(k))).alias(f"precision_{k}"),
            F.col(f"rr_{k}").alias(f"mrr_{k}"),
            (F.col(f"hits_{k}") > 0).cast("double").alias(f"accuracy_{k}"),
        ]
    return b.select(*cols)


def summarize(pq: DataFrame, ks: list[int], metrics=METRICS, digits: int = 6) -> DataFrame:
    """Average per-query values into ``metric, k, value`` rows."""
    means = pq.agg(*[F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m in metrics for k in ks])
    pairs = ", ".join(f"'{m}', {k}, `{m}_{k}`" for m in metrics for k in ks)
    return (means.selectExpr(f"stack({len(metrics) * len(ks)}, {pairs}) AS (metric, k, value)")
            .select("metric", F.col("k").cast("int").alias("k"),
                    F.round("value", digits).alias("value")))


def evaluate(judged: DataFrame, base: DataFrame, ks: list[int], metrics=METRICS) -> DataFrame:
    return summarize(per_query(judged, base, ks), ks, metrics)


GROUP_METRICS = ("dcg", "ndcg", "mrr", "ctr", "recall")


def parse_metric(name: str) -> tuple[str, int]:
    """``"ndcg@10"`` -> ("ndcg", 10); default cut-off 5; unknown -> error."""
    metric, _, k = name.partition("@")
    if metric not in GROUP_METRICS:
        raise ValueError(f"unknown metric {metric}")
    return metric, int(k) if k else 5


def group_metric(rows: DataFrame, name: str, compat: bool = False) -> DataFrame:
    """A training-time metric by its ``name@k`` (A13-A17): ``group_id,
    value`` over rows ``group_id, pos, score, label`` (the passages of one
    query; label is the graded relevance).  Ties take the larger ``pos``
    first, as a reversed ascending sort does.

    * ``dcg``, ``ndcg``: gains ``2^label - 1``; no positive label gives 0.
    * ``ctr``: mean label of the first k (of all, with fewer passages).
    * ``recall``: 1 when the positive passage is among the first k.
    * ``mrr``: reciprocal rank of the first positive among the first k.

    ``compat`` gives the variants that the published trainer logs: ``mrr``
    walks every k-th passage from the worst on and divides the reciprocal
    places by the sum of labels seen; ``recall`` asks whether the passage at
    the positive's place in ascending order has a ``pos`` below k.
    """
    metric, k = parse_metric(name)
    down = Window.partitionBy("group_id").orderBy(F.col("score").desc(), F.col("pos").desc())
    up = Window.partitionBy("group_id").orderBy("score", "pos")
    r = rows.withColumn("i", F.row_number().over(down)).withColumn("j", F.row_number().over(up) - 1)
    label = F.col("label").cast("double")
    gain = F.pow(F.lit(2.0), label) - 1
    first = F.col("i") <= k

    def where(cond, x):
        return F.sum(F.when(cond, x).otherwise(0.0))

    if metric in ("dcg", "ndcg"):
        best = Window.partitionBy("group_id").orderBy(F.col("label").desc(), F.col("pos").desc())
        r = r.withColumn("b", F.row_number().over(best))
        dcg = where(first, gain / _log2(F.col("i") + 1))
        ideal = where(F.col("b") <= k, gain / _log2(F.col("b") + 1))
        value = dcg if metric == "dcg" else F.when(ideal > 0, dcg / ideal).otherwise(0.0)
    elif metric == "ctr":
        value = where(first, label) / F.sum(F.when(first, 1).otherwise(0))
    elif metric == "mrr" and compat:
        seen = F.col("j") % k == 0
        total = where(seen, label)
        value = F.when(total > 0, where(seen, label / (F.floor(F.col("j") / k) + 1)) / total).otherwise(0.0)
    elif metric == "mrr":
        value = F.max(F.when(first & (label > 0), 1.0 / F.col("i")).otherwise(0.0))
    elif compat:
        place = Window.partitionBy("group_id")
        r = r.withColumn("at", F.min(F.when(F.col("label") > 0, F.col("pos"))).over(place))
        value = F.max(F.when((F.col("j") == F.col("at")) & (F.col("pos") < k), 1.0).otherwise(0.0))
    else:
        value = F.max(F.when(first & (label > 0), 1.0).otherwise(0.0))
    return r.groupBy("group_id").agg(value.alias("value"))
