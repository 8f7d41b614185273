"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut_lineage, stage_path

#: White space and words as every contract of this package means them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back."""
    return cut_lineage(df, f"llm-{name}")


def bucketed(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """``df`` written under the shared folder in buckets of ``key``, so that
    grouping by it, and what is joined to its rows, leaves them where they
    are.  The table's name is gone at once; its files are dropped like any
    stage's."""
    spark, table = df.sparkSession, f"tessera_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", stage_path(spark, f"llm-{name}")).bucketBy(parts, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def id_hash(col: Column) -> Column:
    """Hex md5 of an id's decimal form (null: of the empty text); the order
    it gives is the same on every run and in every SQL engine."""
    return F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def same(a: DataFrame, b: DataFrame, cols) -> Column:
    """Null-safe equality of ``cols`` on both sides."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond
