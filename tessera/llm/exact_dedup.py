"""Exact dedup with a heavy-hitter split (DataFrame functions only).

1. Each text is normalised and hashed (SHA-256) next to the scan; only
   (doc_id, digest) goes on.
2. ``freqItems`` - Misra-Gries counters, merged over partitions - names every
   digest held by more than ``support`` of the rows, and at most
   ``1/support`` candidates in all.  A second, map-side combined count
   verifies them and finds each winner's kept row.
3. The verified winners (a table of at most ``1/support`` rows, so its size
   is bounded whatever the input) are broadcast and their rows are answered
   map-side.  All other digests go through one ordinary shuffle, in which no
   group can hold more than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: A single space stays as it is, so only other runs need replacing.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                support: float = 0.002) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.

    * Rows with equal normalised texts form a group; the smallest ``doc_id``
      stays and is every member's ``keep_id``.
    * Null and empty texts are one group (the empty text).
    * A null ``doc_id`` sorts after all others: it stays only where its whole
      group has no id, and ``keep_id`` is then null.
    * Repeated rows (same id and text) count as members; exactly one is kept.
    * An empty table gives an empty result; other columns are ignored, so
      their names cannot clash.

    ``support`` is the share of rows above which a digest is answered by
    broadcast.  It moves work, never results.
    """
    digests = stage(docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("text_sha256"),
    ).withColumn("row", F.monotonically_increasing_id()), "digests")
    # order of members: ids first, nulls last, then a stable row number
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    frequent = digests.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256"))
    winners = (digests.join(F.broadcast(frequent), "text_sha256")
               .groupBy("text_sha256")
               .agg(F.min(member).alias("first"), F.count(F.lit(1)).alias("group_size"))
               .filter(F.col("group_size") > 1))
    marked = digests.join(F.broadcast(winners), "text_sha256", "left")
    group = Window.partitionBy("text_sha256")
    rest = (marked.filter(F.col("group_size").isNull())
            .withColumn("first", F.min(member).over(group))
            .withColumn("group_size", F.count(F.lit(1)).over(group)))
    return marked.filter(F.col("group_size").isNotNull()).unionByName(rest).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("first.row") == F.col("row")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, all columns as
    they are.  Rows repeated under one id and text stay once: the semi join
    and the final distinct share one key, so texts are shuffled once."""
    def key(i, sha):
        return F.concat_ws("|", i.cast("string"), sha)

    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(
        key(F.col("doc_id"), F.col("text_sha256")).alias("__key"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       key(docs[id_col], F.sha2(normalised(docs[text_col]).cast("binary"), 256))
                       .alias("__key"))
    return rows.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select("row.*")
