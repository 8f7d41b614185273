"""Hard-negative mining: rank-depth slice, positive exclusion, seeded
sampling and training-group assembly — one Catalyst plan after the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *cols: str) -> Column:
    """Deterministic pseudo-random order key: md5 of ``seed|c1|c2...``.
    Identical in every engine that has md5; never ``rand()``."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit("|"), F.col(c).cast("string")]
    return F.md5(F.concat(*parts))


def sample_hard_negatives(judged_run: DataFrame, depth: tuple[int, int] = (2, 100),
                          n_sample: int = 16, seed: int = 42) -> DataFrame:
    """From a judged run (``query_id, doc_id, rank, rel``): keep raw ranks in
    ``[depth0, depth1)`` (0-based, taken *before* removing positives), drop
    positives (``rel > 0``) and the padding id -1, then take all candidates
    when there are at most ``n_sample``, else a seeded uniform sample
    without replacement.  Returns ``query_id, doc_id, rank, sample_rank``."""
    lo, hi = depth
    cands = judged_run.where((F.col("rank") > lo) & (F.col("rank") <= hi)
                             & (F.col("rel") <= 0) & (F.col("doc_id").cast("string") != "-1"))
    w = Window.partitionBy("query_id").orderBy(seeded_key(seed, "query_id", "doc_id"), "doc_id")
    return (cands.withColumn("sample_rank", F.row_number().over(w))
            .where(F.col("sample_rank") <= n_sample)
            .select("query_id", "doc_id", "rank", "sample_rank"))


def passages(corpus: DataFrame, id_col: str = "_id") -> DataFrame:
    """Corpus rows -> passage structs ``docid, title, text``."""
    title = F.col("title") if "title" in corpus.columns else F.lit("")
    return corpus.select(F.col(id_col).cast("string").alias("docid"),
                         F.struct(F.col(id_col).cast("string").alias("docid"),
                                  F.coalesce(title, F.lit("")).alias("title"),
                                  F.col("text").alias("text")).alias("passage"))


def assemble_groups(queries: DataFrame, positives: DataFrame, negatives: DataFrame,
                    corpus: DataFrame) -> DataFrame:
    """Training groups ``query_id, query, positive_passages,
    negative_passages``.  ``positives``/``negatives`` are
    ``query_id, docid, pos`` rows (pos orders the array).  A query without
    positives or negatives still yields a row with empty arrays."""
    psg = passages(corpus)

    def collect(pairs: DataFrame, name: str) -> DataFrame:
        return (pairs.join(psg, "docid")
                .groupBy("query_id")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "passage"))).alias("_a"))
                .select("query_id", F.transform("_a", lambda x: x["passage"]).alias(name)))

    empty = F.array().cast("array<struct<docid:string,title:string,text:string>>")
    return (queries.select(F.col("_id").cast("string").alias("query_id"),
                           F.col("text").alias("query"))
            .join(collect(positives, "positive_passages"), "query_id", "left")
            .join(collect(negatives, "negative_passages"), "query_id", "left")
            .select("query_id", "query",
                    F.coalesce("positive_passages", empty).alias("positive_passages"),
                    F.coalesce("negative_passages", empty).alias("negative_passages")))


def hydrate_groups(groups: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Texts for id-only groups (J3): ``groups`` are ``query_id,
    positive_ids, negative_ids`` (arrays of corpus ids, order kept, repeats
    kept); ids the corpus lacks are left out of the passages.  Each id is
    looked up once by an equi join, however many groups name it."""
    def rows(name):
        return groups.select(F.col("query_id").cast("string").alias("query_id"), F.posexplode(name).alias("pos", "docid")) \
            .withColumn("docid", F.col("docid").cast("string"))
    named = queries.join(groups.select(F.col("query_id").cast("string").alias("_id")).distinct(), "_id", "left_semi")
    return assemble_groups(named, rows("positive_ids"), rows("negative_ids"), corpus)


def require_candidates(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates, or an error that names how many queries have none."""
    bare = queries.select("query_id").join(candidates.select("query_id").distinct(), "query_id", "left_anti").count()
    if bare:
        raise ValueError(f"{bare} queries have no negative candidate in the searched depth")
    return candidates
