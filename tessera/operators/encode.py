"""Encoding hooks and vector I/O.

* :func:`encode` runs a user encoder (``list[str] -> np.ndarray``) over
  Arrow batches with ``mapInPandas``, after sorting each partition by text
  length (similar lengths batch together, as an encoder wants).  The model
  itself is outside this library.
* :func:`hashed_shingle_encoder` is a deterministic test encoder built from
  ``pyspark.ml`` (``HashingTF`` over character shingles + ``Normalizer``).
* :func:`pool` reduces a token-vector table to one vector per document
  (cls / mean / avg_first_last / avg_top2 / lasttoken).
* :func:`project` applies a small linear map ``xW + b``.
* :func:`save_vectors` / :func:`load_vectors` round-trip vectors as Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], dim: int,
           id_col: str = "_id", text_col: str = "text", prompt: str = "") -> DataFrame:
    """``id, embedding`` from a text column with a user-supplied encoder."""
    src = df.select(F.col(id_col).alias("id"), F.concat(F.lit(prompt), F.col(text_col)).alias("t")) \
        .sortWithinPartitions(F.length("t").desc())

    def run(batches):
        for pdf in batches:
            vecs = np.asarray(encoder(pdf["t"].tolist()), dtype=np.float32).reshape(len(pdf), dim)
            yield pd.DataFrame({"id": pdf["id"], "embedding": list(vecs)})

    id_type = dict(src.dtypes)["id"]
    return src.mapInPandas(run, f"id {id_type}, embedding array<float>").withColumnRenamed("id", id_col)


def hashed_shingle_encoder(df: DataFrame, id_col: str = "_id", text_col: str = "text",
                           dim: int = 256, width: int = 3) -> DataFrame:
    """Deterministic JVM-side test encoder: character ``width``-shingles of
    the lower-cased text, hashed into ``dim`` buckets, L2-normalised."""
    t = F.lower(F.col(text_col))
    sh = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - width + 1, F.lit(1))),
                     lambda i: F.substring(t, i, width))
    tf = HashingTF(inputCol="sh", outputCol="tf", numFeatures=dim)
    nm = Normalizer(inputCol="tf", outputCol="v", p=2.0)
    out = nm.transform(tf.transform(df.select(id_col, sh.alias("sh"))))
    return out.select(id_col, vector_to_array("v", "float32").alias("embedding"))


def pool(tokens: DataFrame, strategy: str, doc: str = "doc_id", pos: str = "pos",
         vec: str = "vec", mask: str = "mask", layer: str | None = None,
         left_padded: bool = False) -> DataFrame:
    """Token vectors -> one vector per document (F20).  ``tokens`` rows are
    ``doc, pos, vec, mask`` (and ``layer`` for the layer-mixing
    strategies: 0 = first, 1 = last, 2 = second to last)."""
    def mean_of(df: DataFrame) -> DataFrame:
        # a document's tokens (a model's sequence length at most) are summed
        # as one matrix
        live = df.where(F.col(mask) == 1).select(doc, F.col(vec).cast("array<double>").alias("v"))

        def mean(t: pa.Table) -> pa.Table:
            m = np.array(t["v"].to_pylist()).mean(axis=0)
            return pa.table({doc: t[doc].slice(0, 1), "embedding": pa.array([m.tolist()], pa.list_(pa.float64()))})
        return live.groupBy(doc).applyInArrow(mean, f"{doc} {dict(live.dtypes)[doc]}, embedding array<double>")

    if strategy == "cls":
        w = Window.partitionBy(doc).orderBy(pos)
        return (tokens.withColumn("_r", F.row_number().over(w)).where("_r = 1")
                .select(doc, F.col(vec).alias("embedding")))
    if strategy == "mean":
        return mean_of(tokens)
    if strategy == "lasttoken":
        live = tokens if left_padded else tokens.where(F.col(mask) == 1)
        return live.groupBy(doc).agg(F.max_by(vec, pos).alias("embedding"))
    if strategy in ("avg_first_last", "avg_top2"):
        if layer is None:
            raise ValueError(f"{strategy} needs a layer column")
        pick = (0, 1) if strategy == "avg_first_last" else (1, 2)
        per = [mean_of(tokens.where(F.col(layer) == lv)).withColumnRenamed("embedding", f"e{lv}")
               for lv in pick]
        j = per[0].join(per[1], doc)
        return j.select(doc, F.zip_with(f"e{pick[0]}", f"e{pick[1]}", lambda a, b: (a + b) / 2)
                        .alias("embedding"))
    raise ValueError(f"unknown pooling {strategy}")


def project(df: DataFrame, weight: np.ndarray, bias: np.ndarray | None = None,
            vec: str = "embedding") -> DataFrame:
    """``x W + b`` for a model-sized ``W`` (in_dim x out_dim), shipped to
    the workers once and applied to whole batches (F21)."""
    w = np.asarray(weight, dtype=np.float64)
    b = np.zeros(w.shape[1]) if bias is None else np.asarray(bias, dtype=np.float64)
    shared = df.sparkSession.sparkContext.broadcast((w, b))
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == vec else f
                           for f in df.schema])
    place = df.columns.index(vec)

    def run(batches):
        w, b = shared.value
        for batch in batches:
            x = np.array(batch.column(place).to_pylist(), dtype=np.float64).reshape(-1, w.shape[0]) @ w + b
            cols = list(batch.columns)
            cols[place] = pa.array(x.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])
    return df.mapInArrow(run, schema)


def save_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors (and any id map columns) as Parquet (V9)."""
    df.write.mode(mode).parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sort_by_length(corpus: DataFrame, title: str | None = "title", text: str = "text") -> DataFrame:
    """Longest passages first inside each partition (T1), ties by id; a
    partition-local sort, so similar lengths share encoder batches."""
    ln = F.length(F.col(text)) if title is None else F.length(F.concat_ws("", F.col(title), F.col(text)))
    return corpus.sortWithinPartitions(ln.desc(), F.col("_id"))
