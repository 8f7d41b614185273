"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source_size`` times.  The
expectations are prefix-summed inside the source (fixed point, so the sums
are exact and reruns agree), one random offset per source is added, and a
document is emitted once for each integer boundary its step crosses.
Documents are walked in order of size, so that the taken words differ from
the target by about the size of one document at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_hash, stage, word_count
from .prefix import prefix_sum

#: Fixed point of an expected copy: 24 bits leave room for 10^11 documents.
ONE = 1 << 24


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_ratio: int = 3) -> DataFrame:
    """``source, source_size, target`` from rows of (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and
    share the whole size by weight; a target stops at ``max_ratio`` times its
    source and the excess goes to the others by weight until none is above.
    In the order of size/weight the stopped sources come first, so one pass
    over the per-source totals settles all of them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (n % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_ratio)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    ratio = F.col("cap") / F.col("weight")
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    per = (per.withColumn("ratio", ratio)
           .withColumn("all_size", F.sum("source_size").over(everything))
           .withColumn("all_weight", F.sum("weight").over(everything))
           .withColumn("cap_before", F.sum("cap").over(upto) - F.col("cap"))
           .withColumn("weight_left", F.col("all_weight") - F.sum("weight").over(upto) + F.col("weight"))
           .withColumn("stopped", (F.col("all_size") - F.col("cap_before")).cast("double")
                       / F.col("weight_left") > F.col("ratio"))
           .withColumn("cap_all", F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(everything))
           .withColumn("weight_all", F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(everything)))
    share = (F.col("all_size") - F.col("cap_all")).cast("double") * F.col("weight") / F.col("weight_all")
    return per.select("source", "source_size",
                      F.when(F.col("stopped"), F.col("cap").cast("double"))
                      .otherwise(share).alias("target"))


def systematic_mix(docs: DataFrame, seed: int = 0, weights=(5, 2, 1), max_ratio: int = 3,
                   id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target,
    copies, taken, text_hash``; ``copies`` is how often the mix takes the document and
    ``taken`` the words that makes.

    * Null and empty texts have size 0; they get copies like others but add
      no words.  A source whose documents are all empty gets none.
    * A null source is a source of its own, ordered last.
    * Null ids and repeated rows are ordinary documents; rows equal in id and
      size may swap places, which changes no result.
    * No document is taken more than ``max_ratio`` times.  An empty table
      gives an empty result; other columns are ignored.
    """
    sizes = stage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h"),
        F.xxhash64(F.col(text_col)).alias("text_hash")), "sizes")
    targets = source_targets(sizes, weights, max_ratio).select(
        F.col("source").alias("__s"), "source_size", "target",
        F.when(F.col("source_size") > 0,
               F.floor(F.col("target") / F.col("source_size") * ONE + 0.5)).otherwise(0)
        .cast("long").alias("step"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit(""))).cast("binary")),
                           1, 6), 16, 10).cast("long").alias("offset"))
    known = sizes.join(targets, sizes["source"].eqNullSafe(targets["__s"])).drop("__s")
    walked = prefix_sum(
        known.withColumn("band", F.floor(F.log2(F.col("size") + 1.0) * 16))
        .withColumn("piece", F.substring("h", 1, 2)),
        group=["source"], band=["band"], cell=["size", "piece"], order=["h", "doc_id"],
        value="step", out="reach")
    copies = F.expr(f"(reach + offset) div {ONE} - (reach + offset - step) div {ONE}")
    return walked.select(
        "doc_id", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), "text_hash")


def _key(id_col, source, size, text_hash):
    # a null id or source keeps its place: concat_ws would skip it
    return F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("")),
                       F.coalesce(F.concat(F.lit("="), source), F.lit("")), size.cast("string"),
                       text_hash.cast("string"))


def mixed_documents(docs: DataFrame, seed: int = 0, id_col: str = "doc_id",
                    text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`systematic_mix` takes
    it.  Rows repeated under one id, source and text come out as one document
    with the copies of all of them.  The join and the distinct share one key,
    so texts are shuffled once."""
    mix = systematic_mix(docs, seed=seed, id_col=id_col, text_col=text_col,
                         source_col=source_col, **kw)
    per = (mix.select(_key(mix["doc_id"], mix["source"], mix["size"], mix["text_hash"]).alias("__key"),
                      "copies")
           .groupBy("__key").agg(F.sum("copies").alias("copies")).filter("copies > 0"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       _key(docs[id_col], docs[source_col], word_count(docs[text_col]),
                            F.xxhash64(docs[text_col])).alias("__key"))
    hit = rows.join(per, "__key").dropDuplicates(["__key"])
    copy = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return hit.select("row", F.explode(copy).alias("copy")).select("row.*")
