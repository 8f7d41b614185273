"""A vector index on disk (V9, with the codes of V3, V4 and the lists of V7).

``<path>/codes`` holds the encoded documents, partitioned by inverted list;
``<path>/model`` holds what they are read with - centroids, code books,
ranges - and is written last, so an index without it was not finished.  A
search reads the lists that its queries probe and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ann import (
    FIT_ROWS,
    ByteCodes,
    ProductCodes,
    fit_sample,
    kmeans,
    learned_rotation,
    nearest,
    pq_books,
    sq_ranges,
)
from .search import CELL_DOCUMENTS, Dot, _best, cell_topk, float_type, pack, rerank

CODES = ("flat", "fp16", "sq8", "pq", "opq")
_MODEL = "name string, kind string, shape array<long>, data binary"


@dataclass
class VectorIndex:
    """An index as read: arrays by name, and the codes (``id, payload,
    list``)."""

    arrays: dict
    codes: DataFrame

    @property
    def form(self) -> str:
        return str(self.arrays["form"])

    def scorer(self, query_type: str):
        a = self.arrays
        if self.form == "sq8":
            return ByteCodes(query_type, a["lo"], a["spread"])
        if self.form in ("pq", "opq"):
            books = [a[f"book{m}"] for m in range(int(a["books"]))]
            return ProductCodes(query_type, books, a.get("rotation"))
        return Dot(query_type, "<f2" if self.form == "fp16" else str(a["float"]))


def _encoder(arrays: dict, kind: str):
    """Maps a matrix of doubles to the rows of a stored array."""
    form = str(arrays["form"])
    if form == "flat":
        return lambda x: x.astype(kind)
    if form == "fp16":
        return lambda x: x.astype("<f2")
    return VectorIndex(arrays, None).scorer("<f8").encode


def write_index(corpus: DataFrame, path: str, form: str = "flat", n_lists: int = 64, n_sub: int = 96, n_bits: int = 8,
                out_dim: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 42,
                books: list[np.ndarray] | None = None) -> None:
    """Writes an index of ``corpus`` (``doc_id, embedding``) in one of the
    ``CODES``.  Model parts are fitted on at most ``fit_rows`` vectors, every
    document is indexed; large lists are spread over several files by a hash
    of the ids.  Null vectors are left out."""
    if form not in CODES:
        raise ValueError(f"unknown codes {form}")
    kind = float_type(corpus, "embedding")
    sample = fit_sample(corpus, fit_rows)
    centres = kmeans(sample, n_lists, seed) if len(sample) else np.zeros((0, 0))
    arrays = {"form": np.array(form), "float": np.array(kind), "centres": centres}
    if form == "sq8":
        arrays["lo"], arrays["spread"] = sq_ranges(corpus)
    elif form == "opq":
        arrays["rotation"], books = learned_rotation(sample, n_sub, n_bits, out_dim or 4 * n_sub, seed=seed)
    elif form == "pq":
        books = books if books is not None else pq_books(sample, n_sub, n_bits, seed)
    if form in ("pq", "opq"):
        arrays["books"] = np.array(len(books))
        arrays |= {f"book{m}": b for m, b in enumerate(books)}
    encode = _encoder(arrays, kind)

    def run(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            if raw:
                x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
                codes = np.ascontiguousarray(encode(x))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(nearest(x, centres))],
                    names=["id", "payload", "list"])
    packed = pack(corpus, "doc_id", "embedding").select("id", "payload").mapInArrow(run, "id long, payload binary, list long")
    packed = cut_lineage(packed, "index_codes")
    pieces = packed.count() // (max(1, len(centres)) * CELL_DOCUMENTS) + 1
    packed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(pieces))).sortWithinPartitions("list", "id") \
        .write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")
    rows = [(n, a.dtype.str, [int(s) for s in a.shape], bytearray(a.tobytes())) for n, a in arrays.items()]
    corpus.sparkSession.createDataFrame(rows, _MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    """Opens what :func:`write_index` wrote; the model is collected (centroids
    and books), the codes stay a table."""
    arrays = {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"])
              for r in spark.read.schema(_MODEL).parquet(f"{path}/model").collect()}
    return VectorIndex(arrays, spark.read.schema("id long, payload binary, list long").parquet(f"{path}/codes"))


def probed(queries: DataFrame, index: VectorIndex, n_probe: int) -> DataFrame:
    """``id, payload, grp, key``: every query once for each of its
    ``n_probe`` nearest lists."""
    kind, centres = float_type(queries, "embedding"), index.arrays["centres"]
    n = min(n_probe, len(centres))

    def run(batches):
        half = (centres * centres).sum(1) / 2
        for b in batches:
            raw = b.column(1).to_pylist()
            if raw and n:
                x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
                at = np.argsort(half - x @ centres.T, axis=1, kind="stable")[:, :n].astype(np.int64)
                for t in range(n):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.ascontiguousarray(at[:, t]))],
                                                     names=["id", "payload", "grp", "key"])
    return pack(queries, "query_id", "embedding").mapInArrow(run, "id long, payload binary, grp long, key long")


def index_search(queries: DataFrame, index: VectorIndex, k: int, n_probe: int = 40, refine: int = 0,
                 corpus: DataFrame | None = None) -> DataFrame:
    """Top-k from the stored codes: ``query_id, doc_id, score, rank``.  Only
    the files of probed lists are opened.  With ``refine`` that many
    candidates are scored again by the vectors of ``corpus``."""
    q = cut_lineage(probed(queries, index, n_probe), "index_queries")
    # at most as many numbers as there are lists
    wanted = [r["key"] for r in q.select("key").distinct().collect()]
    d = index.codes.where(F.col("list").isin(wanted)) if wanted else index.codes.limit(0)
    d = d.select("id", "payload", F.lit(0).cast("long").alias("grp"), F.col("list").alias("key"))
    found = cell_topk(q, d, ["key"], max(k, refine), index.scorer(float_type(queries, "embedding")))
    if refine:
        return rerank(found, queries, corpus, k)
    return _best(found.select("query_id", "doc_id", "score"), k).select("query_id", "doc_id", "score", "rank")
