"""Files of any Hadoop file system, and the places of rows in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where a row was read: its file, its split and its place in the split.
WHERE = ["_file", "_block", "_m"]


def hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def files_of(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> list[str]:
    """``path`` itself if it is a file; of a folder, what is in it (files, or
    folders of part files) whose names end in one of ``suffixes``, sorted by
    name."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return [path]
    names = sorted(st.getPath().getName() for st in fs.listStatus(p)
                   if st.getPath().getName().endswith(suffixes))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def decoded(file_path) -> Column:
    """A file path as it was given: readers report it percent-encoded."""
    path = F.col(file_path) if isinstance(file_path, str) else file_path
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def with_place(df: DataFrame) -> DataFrame:
    """Adds :data:`WHERE` to a DataFrame straight from a file reader; rows
    ordered by it are in the order of file names and of lines."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_m"))


def with_line_numbers(df: DataFrame, out: str = "idx", per: Column | None = None) -> DataFrame:
    """Adds the 0-based line number (over all files in name order, or over
    those with one value of ``per``, an expression on ``_file``) to a
    DataFrame straight from a file reader.  A split's first number comes from
    the table of split sizes: one row per split, no row moves."""
    placed = with_place(df)
    splits = placed.groupBy("_file", "_block").agg(F.min("_m").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("_file", "_block") if per is None else Window.partitionBy(per).orderBy("_file", "_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_block",
                           (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_s"))
    return placed.join(F.broadcast(starts), ["_file", "_block"]) \
        .withColumn(out, F.col("_m") + F.col("_s")).drop("_file", "_block", "_m", "_s")


def last_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last row, in file and line order, of each key; ``df`` carries
    :data:`WHERE`.  Earlier rows are dropped before the shuffle."""
    cols = [c for c in df.columns if c not in WHERE]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*WHERE)).alias("_r")).select("_r.*")
