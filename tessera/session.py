"""Session helpers: building a local session for tests/bench, reading the
cluster's checkpoint folder, and size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes a side may hold before we stop broadcasting it and fall back
# to a shuffled join.  Callers pass their own bound of rows where they know one.
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 128 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tessera") -> SparkSession:
    """Session for tests and the bench harness (local mode, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A folder the user set with ``setCheckpointDir`` wins, then the setting,
    which on a cluster names a shared (HDFS/S3/...) folder.  Only a local
    session (one JVM, so a local folder *is* shared) may run without either;
    on a cluster that is an error, never a silent machine-local folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back.  Used where a costly intermediate (e.g. a Python-computed
    fingerprint) feeds several branches: it is computed exactly once, the
    later plan reads a columnar table, and a lost executor only re-reads
    files instead of recomputing the lineage.  Never machine-local."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, noted for
    :func:`drop_stage_tables`."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _STAGE_TABLES.append(path)
    return path


_STAGE_TABLES: list[str] = []


def drop_stage_tables(spark: SparkSession, since: int = 0) -> int:
    """Delete the intermediate tables this process wrote with
    :func:`cut_lineage` (through the Hadoop FileSystem API, so it works on
    any shared store), oldest ``since`` ones excepted.  Call once the results
    that read them are written.  Returns the number of tables removed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while len(_STAGE_TABLES) > since:
        path = jvm.org.apache.hadoop.fs.Path(_STAGE_TABLES.pop())
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            fs.delete(path, True)
            removed += 1
    return removed


@contextmanager
def stage_scope(spark: SparkSession):
    """Intermediate tables written inside the ``with`` block are dropped at
    its end, so a job that writes its result in there leaves none behind."""
    since = len(_STAGE_TABLES)
    try:
        yield
    finally:
        drop_stage_tables(spark, since)


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows.  Reads at most limit+1
    rows, so the check itself stays bounded."""
    return df.limit(limit + 1).count() <= limit


def _bytes_of(col, kind) -> Column:
    """About the bytes of a value in a broadcast relation."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            own = F.aggregate(col, F.lit(0).cast("long"), lambda s, x: s + _bytes_of(x, kind.elementType).cast("long"))
        else:
            own = F.size(col) * 8
        return F.coalesce(own, F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(col[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.MapType):
        return _bytes_of(F.map_keys(col), T.ArrayType(kind.keyType)) + _bytes_of(F.map_values(col), T.ArrayType(kind.valueType))
    return F.lit(8)


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                   max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows that take about
    ``max_bytes`` at most, both measured.  Reads at most max_rows + 1 rows."""
    width = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Join that broadcasts ``small`` only after measuring its rows and
    bytes; beyond the bounds the join is left to the shuffled strategies (and
    AQE's runtime broadcast/skew handling)."""
    if fits_broadcast(small, max_rows, max_bytes):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, target: int | None = None) -> DataFrame:
    """Round-robin repartition only when the input is split into fewer
    partitions than the cluster's parallelism (e.g. one big single-row-group
    file).  Inputs that already arrive as many splits are left alone, so on
    a large cluster this adds no shuffle."""
    target = target or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def number_rows(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds ``out``: the 0-based place of every row in the order of ``order``
    (ties in any order).  The rows are range-sorted and written once; a
    partition's start comes from the table of partition sizes, so no task
    sees more than its own rows."""
    placed = cut_lineage(df.orderBy(*order).withColumn("_p", F.spark_partition_id())
                         .withColumn("_m", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy("_p").agg(F.min("_m").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_s"))
    return placed.join(F.broadcast(starts), "_p").withColumn(out, F.col("_m") + F.col("_s")).drop("_p", "_m", "_s")
