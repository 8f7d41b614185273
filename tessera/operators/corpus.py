"""Corpus and qrels from training pairs (the mining input step).

Passages of all rows (positives before negatives within a row) are
deduplicated by content ``title + text`` - by its 128-bit digest, so texts
are not shuffled as keys; the first occurrence wins and
fixes the order; each distinct passage gets a dense 0-based index (computed
bucket-wise, never by a single global sort).  Qrels map each query to the
index of each of its positives by a content join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import corpus_key, docid_default
from .mixing import dense_index


def passage_rows(groups: DataFrame, row_col: str = "row_idx") -> DataFrame:
    """``row_idx, pos, role, _id, title, text`` for every positive and
    negative passage of every group (positives first)."""
    cols = set(groups.columns)
    neg = F.col("negative_passages") if "negative_passages" in cols else \
        F.array().cast(groups.schema["positive_passages"].dataType)
    both = F.concat(F.transform("positive_passages", lambda p: F.struct(F.lit("pos").alias("role"), p.alias("p"))),
                    F.transform(neg, lambda p: F.struct(F.lit("neg").alias("role"), p.alias("p"))))
    x = groups.select(row_col, F.posexplode(both).alias("pos", "e"))
    ptype = groups.schema["positive_passages"].dataType.elementType
    names = set(ptype.fieldNames())
    pid = [F.col(f"e.p.{c}") for c in ("_id", "docid") if c in names]
    title = F.col("e.p.title") if "title" in names else F.lit("")
    return x.select(row_col, "pos", F.col("e.role").alias("role"),
                    (F.coalesce(*pid) if pid else F.lit(None).cast("string")).alias("_given_id"),
                    F.coalesce(title, F.lit("")).alias("title"), F.col("e.p.text").alias("text"))


def corpus_from_groups(groups: DataFrame, row_col: str = "row_idx", chunk: int = 1 << 16) -> DataFrame:
    """Distinct passages by content with ``corpus_idx`` (first-occurrence
    order) and ``_id`` (given id, else the index).  Returns ``corpus_idx,
    _id, title, text, key, first_row``."""
    rows = passage_rows(groups, row_col).withColumn("key", F.md5(corpus_key(F.col("title"), F.col("text"))))
    first = (rows.groupBy("key")
             .agg(F.min(F.struct(row_col, "pos", "_given_id", "title", "text")).alias("f")))
    ordered = first.select("key", F.col(f"f.{row_col}").alias("first_row"), F.col("f.pos").alias("first_pos"),
                           F.col("f._given_id").alias("_given_id"), F.col("f.title").alias("title"),
                           F.col("f.text").alias("text"), F.lit(0).alias("_g"))
    idx = dense_index(ordered, "_g", F.struct("first_row", "first_pos"),
                      F.floor(F.col("first_row") / chunk), out="corpus_idx")
    return idx.select("corpus_idx", docid_default(F.col("_given_id"), index=F.col("corpus_idx")).alias("_id"),
                      "title", "text", "key", "first_row")


def qrels_from_groups(groups: DataFrame, corpus: DataFrame, row_col: str = "row_idx") -> DataFrame:
    """``row_idx, corpus_idx`` per positive (duplicates within a row kept)."""
    pos = passage_rows(groups, row_col).where(F.col("role") == "pos") \
        .withColumn("key", F.md5(corpus_key(F.col("title"), F.col("text"))))
    return pos.join(corpus.select("key", "corpus_idx"), "key").select(row_col, "pos", "corpus_idx")
