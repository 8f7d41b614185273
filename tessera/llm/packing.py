"""Packing into optimal length buckets.

The lengths of all documents are counted into one histogram over a fixed
ladder of possible pad lengths.  Dynamic programming over that histogram
chooses the ``n_buckets`` pad lengths with the least total padding; inside a
bucket, documents in a seeded order form batches of ``budget // pad`` rows,
so a padded batch never exceeds the token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_hash, stage, word_count
from .prefix import prefix_sum


def rung(length: Column, exact: int = 1024, per_octave: int = 128) -> Column:
    """The smallest possible pad length that holds ``length``: every length
    up to ``exact``, above it ``per_octave`` steps for each doubling.  The
    ladder, and with it the histogram, stays some thousand rungs long
    however long documents get."""
    step = F.pow(F.lit(2.0), F.greatest(
        F.floor(F.log2(F.greatest(length - 1, F.lit(1)).cast("double"))) - np.log2(per_octave),
        F.lit(0.0))).cast("long")
    return F.when(length <= exact, F.greatest(length, F.lit(1))) \
        .otherwise(F.ceil(length / step) * step).cast("long")


def optimal_bounds(pads: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Pad lengths of at most ``n_buckets`` buckets with the least padded
    size: bucket (i, j] costs ``pads[j]`` for each of its documents.  Exact
    dynamic programming; ties take the shorter first bucket.  ``pads`` are
    ascending."""
    n = len(pads)
    if n == 0:
        return []
    pad = np.asarray(pads, dtype=np.float64)
    upto = np.concatenate(([0.0], np.cumsum(np.asarray(counts, dtype=np.float64))))
    k = min(n_buckets, n)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    choice = np.zeros((k, n + 1), dtype=np.int64)
    for b in range(k):
        new = np.full(n + 1, np.inf)
        for j in range(1, n + 1):
            cost = best[:j] + pad[j - 1] * (upto[j] - upto[:j])
            i = int(np.argmin(cost))
            new[j], choice[b, j] = cost[i], i
        best = new
    bounds, j = [], n
    for b in range(k - 1, -1, -1):
        bounds.append(int(pads[j - 1]))
        j = int(choice[b, j])
    return bounds[::-1]


def pack(docs: DataFrame, budget: int = 16384, n_buckets: int = 12, seed: int = 0,
         id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, bucket, padded_len,
    batch_in_bucket, slot``.  ``n_tokens`` is ``length`` (default: the words
    of the text), ``padded_len`` the bucket's pad length, ``slot`` the place
    in the batch.

    * Null and empty texts have length 0 and sit in the first bucket, whose
      pad length is at least 1.
    * A document longer than ``budget`` is never cut: its batch holds it alone.
    * Null ids and repeated rows are documents of their own; rows equal in id
      and length may swap slots.
    * An empty table gives an empty result; other columns are ignored.

    Only the histogram comes to the driver: its rows are rungs of
    :func:`rung`'s ladder, under 1024 + 128 for each doubling of the longest
    document, however many documents there are.
    """
    spark = docs.sparkSession
    n = word_count(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    sizes = stage(docs.select(F.col(id_col).alias("doc_id"), n.alias("n_tokens"),
                              id_hash(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("h"))
                  .withColumn("rung", rung(F.col("n_tokens"))), "lengths")
    histogram = sorted((r["rung"], r["count"]) for r in sizes.groupBy("rung").count().collect())
    bounds = optimal_bounds([r for r, _ in histogram], [c for _, c in histogram], n_buckets)
    if not bounds:
        return spark.createDataFrame([], "doc_id long, n_tokens long, bucket int, padded_len long, "
                                         "batch_in_bucket long, slot long")
    bucket = sum((F.col("rung") > F.lit(b)).cast("int") for b in bounds)
    padded = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    placed = sizes.withColumn("bucket", bucket).withColumn("padded_len", padded) \
        .withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sum(placed.withColumn("band", F.substring("h", 1, 2))
                        .withColumn("piece", F.substring("h", 3, 2)),
                        group=["bucket"], band=["band"], cell=["piece"],
                        order=["h", "doc_id", "n_tokens"], value="one", out="rank")
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("padded_len")))
    place = F.col("rank") - 1
    return ranked.select("doc_id", "n_tokens", "bucket", "padded_len",
                         F.floor(place / per_batch).alias("batch_in_bucket"),
                         (place % per_batch).alias("slot"))
