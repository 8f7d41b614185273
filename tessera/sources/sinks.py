"""Sinks: JSON lines, verbatim text, weight tables, resumable metric files,
caches and log lines.  All are ordinary DataFrame writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .files import exists, hadoop_path


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """One JSON object per line (K1); folders are created as needed."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_domain_files(df: DataFrame, folder: str, domain_col: str, order_col: str) -> None:
    """``<folder>/<domain>.jsonl`` for every domain of ``df`` (the files of
    S13), rows in the order of ``order_col``.  One pass for all domains: rows
    are range-sorted, so a large domain is spread over several part files,
    whose names keep the order; rows without a domain are left out.  A domain
    appears under its name when all of them are written."""
    spark = df.sparkSession
    ordered = df.where(F.col(domain_col).isNotNull()).withColumn("_domain", F.col(domain_col)).drop(domain_col)
    ordered.repartitionByRange("_domain", order_col).sortWithinPartitions("_domain", order_col) \
        .write.mode("overwrite").partitionBy("_domain").json(f"{folder}/_parts")
    names = [r["_domain"] for r in ordered.select("_domain").distinct().collect()]
    fs, parts = hadoop_path(spark, f"{folder}/_parts")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for name in names:
        fs.rename(path(parts, f"_domain={escape(name)}"), path(folder, f"{name}.jsonl"))
    fs.delete(parts, True)


def write_verbatim(df: DataFrame, path: str, raw_col: str = "value", mode: str = "overwrite") -> None:
    """Write the original input lines unchanged (K2 clean split)."""
    df.select(F.col(raw_col).alias("value")).write.mode(mode).text(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write a report only when it has rows (K2); returns whether written."""
    if df.limit(1).count() == 0:
        return False
    write_jsonl(df, path)
    return True


def weight_tables_json(w: DataFrame, keys: list[str]) -> DataFrame:
    """Domain-config documents (K3): one JSON text per ``keys`` group of
    ``domain, domain_id, weight, size, epoch`` rows, with the four maps
    ``domain_ids, domain_weights, size, epoch``."""
    doc = w.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("domain", "domain_id"))).alias("domain_ids"),
        F.map_from_entries(F.collect_list(F.struct("domain", "weight"))).alias("domain_weights"),
        F.map_from_entries(F.collect_list(F.struct("domain", "size"))).alias("size"),
        F.map_from_entries(F.collect_list(F.struct("domain", "epoch"))).alias("epoch"))
    return doc.select(*keys, F.to_json(F.struct("domain_ids", "domain_weights", "size", "epoch"))
                      .alias("json"))


def write_weight_tables(w: DataFrame, keys: list[str], path: str) -> None:
    """The documents of :func:`weight_tables_json`, one text file per group
    under ``path/<key>=<value>/`` (K3)."""
    weight_tables_json(w, keys).repartition(*keys).write.mode("overwrite").partitionBy(*keys).text(path)


def append_scores(spark: SparkSession, scores: DataFrame, path: str,
                  keys: tuple[str, ...] = ("task", "lang"), overwrite: bool = False) -> DataFrame:
    """Resumable metric store (K4): Parquet partitioned by ``keys``; groups
    already present are skipped, or with ``overwrite`` replaced; other groups
    stay as they are.  Returns the rows written."""
    todo = scores
    if not overwrite and exists(spark, path):
        done = spark.read.parquet(path).select(*keys).distinct()
        todo = scores.join(done, list(keys), "left_anti")
    todo = cut_lineage(todo, "scores")  # the store it is compared with is about to change
    todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return todo


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """Build-once Parquet cache (K5): read ``path`` if it was written to the
    end (its success mark is there), else write ``build()`` and read that."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def log_lines(metrics: DataFrame, step_col: str = "step") -> DataFrame:
    """``{metrics..., step}`` JSON text per row (K6)."""
    cols = [c for c in metrics.columns if c != step_col] + [step_col]
    return metrics.select(F.to_json(F.struct(*cols)).alias("value"))
