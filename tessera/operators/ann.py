"""Compressed and approximate vector search.

* scalar quantisation, 8 bits or half precision (V3): one code a dimension;
* PCA reduction with mean centring, eigenvalue scaling and an optional random
  rotation (V6);
* product quantisation (V4), also behind a learned rotation (V5): documents
  are stored as centroid numbers and scored by table lookup;
* inverted lists and hyperplane hashing (V7): documents sharing a cell with
  the query are scored exactly.

Codebooks, centroids and rotations are fitted with numpy on at most
``fit_rows`` vectors, chosen by a hash of the id: a documented bound, so what
is fitted is the same on every run and never grows with the corpus.  Every
document is indexed.  Lossy codes find ``refine`` candidates a query, which
the exact product reorders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, join_small
from .search import BROADCAST_QUERY_BYTES, BoundedDot, Dot, all_scores, cell_topk, float_type, knn, pack, rerank, top_k

#: Most vectors that a codebook or a rotation is fitted on.
FIT_ROWS = 65_536


def fit_sample(corpus: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """At most ``fit_rows`` vectors, those whose ids hash lowest."""
    rows = corpus.where(F.col("embedding").isNotNull()).select(
        F.xxhash64("doc_id").alias("h"), F.col("embedding").cast("array<double>").alias("v")) \
        .orderBy("h").limit(fit_rows).select("v").toArrow()
    return np.array(rows["v"].to_pylist(), dtype=np.float64)


def kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 20) -> np.ndarray:
    """Lloyd's algorithm from ``k`` distinct points picked by distance; a
    sample with fewer distinct points gives those."""
    points = np.unique(x, axis=0)
    if len(points) <= k:
        return points
    rng = np.random.default_rng(seed)
    centres = [points[rng.integers(len(points))]]
    near = ((points - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centres.append(points[rng.choice(len(points), p=near / near.sum())])
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], axis=1)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre; ties take the smaller number."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(half - x[i:i + 8192] @ centres.T).argmin(axis=1) for i in range(0, len(x), 8192)]) \
        if len(x) else np.empty(0, np.int64)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> float:
    """Fraction of exact top-k pairs found by the approximate run."""
    hit = exact.join(approx.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").count()
    return hit / max(1, exact.count())


# ------------------------------------------------------------------ exact, with bounds

def bounded_search(queries: DataFrame, corpus: DataFrame, k: int, score_function: str = "dot",
                   ignore_identical: bool = False, n_centres: int = 128, fit_rows: int = 16_384,
                   broadcast_bytes: int = BROADCAST_QUERY_BYTES,
                   observation: Observation | None = None) -> DataFrame:
    """Exact top-k (the rows of :func:`tessera.operators.search.knn`, ties
    included) without working out every product.  Documents are parted by the
    nearest of ``n_centres`` centres where they are read; a part is skipped
    for the queries whose k-th score is above what the part can reach at most
    (see ``_BoundedTopK``).  The k-th score starts from each query's exact
    top-k among at most ``fit_rows`` documents, those whose ids hash lowest,
    on which the centres are fitted too: the sample only decides how early
    parts are skipped, never which rows come out.  No shuffle of documents.

    Vectors must be finite.  Data without clusters and of one length skips
    little and costs a product with each centre more.  ``observation``: see
    :func:`tessera.operators.search.top_k`; ``products`` over ``queries *
    documents`` is the part that was not skipped."""
    cosine = score_function == "cos_sim"
    sample = cut_lineage(corpus.where(F.col("embedding").isNotNull()).select("doc_id", "embedding")
                         .orderBy(F.xxhash64("doc_id")).limit(fit_rows), "bound_sample")
    x = fit_sample(sample, fit_rows)
    if not len(x):
        return knn(queries, corpus, k, score_function, ignore_identical, observation=observation)
    if cosine:
        x = Dot(normalize=True).docs([r.tobytes() for r in x])
    kind = float_type(queries, "embedding")
    first = knn(queries, sample, k, score_function, ignore_identical, broadcast_bytes=broadcast_bytes) \
        .where(F.col("rank") == k).groupBy("query_id").agg(F.min("score").alias("floor"))
    # a document comes again with its scores worked out in other tiles
    slack = 1e-9 * (1 if cosine else float(np.linalg.norm(x, axis=1).max()) + 1)
    started = join_small(queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding"), first,
                         "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.array(batch.column(1).to_pylist(), dtype=kind)
                low = batch.column(2).to_numpy() - slack * (1 + np.linalg.norm(v.astype(np.float64), axis=1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([f.tobytes() + r.tobytes() for f, r in zip(low.astype("<f8"), v)], pa.binary()),
                     pa.array(np.zeros(batch.num_rows, np.int64))], names=["id", "payload", "grp"])

    packed = started.select(F.col("query_id").cast("long").alias("id"), "embedding", "floor") \
        .mapInArrow(run, "id long, payload binary, grp long")
    scorer = BoundedDot(kmeans(x, n_centres), kind, float_type(corpus, "embedding"), cosine)
    return top_k(packed, pack(corpus, "doc_id", "embedding"), k, scorer, ignore_identical, None, broadcast_bytes,
                 observation).select("query_id", "doc_id", "score", "rank")


# ------------------------------------------------------------------ scalar codes

def sq_ranges(corpus: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Smallest value and spread of every dimension over all documents; a
    partition reports one pair of vectors."""
    def run(batches):
        lo = hi = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), dtype=np.float64)
                lo = x.min(0) if lo is None else np.minimum(lo, x.min(0))
                hi = x.max(0) if hi is None else np.maximum(hi, x.max(0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lo))), pa.array(lo), pa.array(hi)],
                                             names=["i", "lo", "hi"])

    rows = corpus.where(F.col("embedding").isNotNull()).select("embedding") \
        .mapInArrow(run, "i long, lo double, hi double") \
        .groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect()
    lo, hi = (np.array([r[c] for r in rows]) for c in ("lo", "hi"))
    return lo, hi - lo


class ByteCodes(Dot):
    """8-bit codes ``floor(255 * (x - lo) / spread)`` (0 in a constant
    dimension), read as the middle of their step."""

    def __init__(self, query_type: str, lo: np.ndarray, spread: np.ndarray):
        super().__init__(query_type)
        self.lo, self.spread = lo, spread

    def encode(self, x: np.ndarray) -> np.ndarray:
        part = (x - self.lo) / np.where(self.spread > 0, self.spread, 1)
        return np.where(self.spread > 0, np.floor(255 * np.clip(part, 0, 1)), 0).astype(np.uint8)

    def docs(self, raw: list[bytes]) -> np.ndarray:
        codes = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        return self.lo + (codes + 0.5) / 255 * self.spread


def sq8_search(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Search in 8-bit codes (QT_8bit)."""
    scorer = ByteCodes(float_type(queries, "embedding"), *sq_ranges(corpus))
    return top_k(pack(queries, "query_id", "embedding"), pack(corpus, "doc_id", "embedding", scorer.encode),
                 k, scorer).select("query_id", "doc_id", "score", "rank")


def fp16_search(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Search in half-precision codes (QT_fp16, the usual default)."""
    index = pack(corpus, "doc_id", "embedding", lambda x: x.astype("<f2"))
    return top_k(pack(queries, "query_id", "embedding"), index, k,
                 Dot(float_type(queries, "embedding"), "<f2")).select("query_id", "doc_id", "score", "rank")


# ------------------------------------------------------------------ PCA

def random_rotation(rows: int, cols: int, seed: int = 42) -> np.ndarray:
    """A matrix with orthonormal rows or columns, whichever are fewer."""
    n = max(rows, cols)
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0][:rows, :cols]


def pca_transform(corpus: DataFrame, out_dim: int, eigen_power: float = 0.0, rotate: bool = False,
                  seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): ``(x - mean) @ matrix`` are the ``out_dim`` principal
    components, each times its eigenvalue to the ``eigen_power``, rotated at
    random where asked.  Fitted on all documents."""
    v = corpus.where(F.col("embedding").isNotNull()).select(array_to_vector("embedding").alias("v"))
    model = PCA(k=out_dim, inputCol="v", outputCol="p").fit(v)
    stats = v.select(Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s")).select("s.*").first()
    scale = np.maximum(np.asarray(model.explainedVariance.toArray()) * float(sum(stats["variance"])), 1e-12)
    matrix = model.pc.toArray() * scale ** eigen_power
    if rotate:
        matrix = matrix @ random_rotation(out_dim, out_dim, seed)
    return np.asarray(stats["mean"].toArray()), matrix


def pca_search(queries: DataFrame, corpus: DataFrame, k: int, out_dim: int, eigen_power: float = 0.0,
               rotate: bool = False, refine: int = 0, seed: int = 42) -> DataFrame:
    """Search by the inner product of reduced vectors; with ``refine`` that
    many candidates are reordered by the full vectors."""
    mean, matrix = pca_transform(corpus, out_dim, eigen_power, rotate, seed)
    reduce = lambda x: (x - mean) @ matrix
    found = top_k(pack(queries, "query_id", "embedding", reduce), pack(corpus, "doc_id", "embedding", reduce),
                  max(k, refine), Dot())
    return rerank(found, queries, corpus, k) if refine else found.select("query_id", "doc_id", "score", "rank")


# ------------------------------------------------------------------ product codes

class ProductCodes:
    """Centroid numbers per sub-vector.  A query's products with all
    centroids form one table; a document's score is the sum of its entries.
    ``rotation`` is applied to both sides first."""

    second = bounded = False

    def __init__(self, query_type: str, books: list[np.ndarray], rotation: np.ndarray | None = None):
        self.float, self.books, self.rotation = Dot(query_type), books, rotation
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    def _turn(self, x: np.ndarray) -> np.ndarray:
        return x if self.rotation is None else x @ self.rotation

    def encode(self, x: np.ndarray) -> np.ndarray:
        x = self._turn(x)
        codes = np.stack([nearest(x[:, a:b], c) for a, b, c in zip(self.cuts, self.cuts[1:], self.books)], axis=1)
        return codes.astype("<u2")

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, in the rotated space."""
        return np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)

    def queries(self, raw: list[bytes]):
        x = self._turn(self.float.queries(raw))
        return tuple(x[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.books))

    def docs(self, raw: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), -1)

    def score(self, q, d: np.ndarray) -> np.ndarray:
        out = q[0][:, d[:, 0]].copy()
        for m in range(1, len(q)):
            out += q[m][:, d[:, m]]
        return out


def pq_books(x: np.ndarray, n_sub: int, n_bits: int, seed: int = 42) -> list[np.ndarray]:
    """A codebook of up to ``2**n_bits`` centroids for each of ``n_sub``
    equal pieces of the dimensions.  With a session the pieces are fitted by
    its tasks, one each."""
    if x.shape[1] % n_sub:
        raise ValueError("dimension must be divisible by the number of sub-vectors")
    parts = np.split(x, n_sub, axis=1)
    spark = SparkSession.getActiveSession()
    if spark is None:
        return [kmeans(part, 2 ** n_bits, seed + m) for m, part in enumerate(parts)]
    shared = spark.sparkContext.broadcast([np.ascontiguousarray(part) for part in parts])

    def fit(batches):
        for batch in batches:
            for m in batch.column(0).to_pylist():
                book = kmeans(shared.value[m], 2 ** n_bits, seed + m)
                yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([book.tobytes()], pa.binary())], names=["m", "book"])

    books = spark.range(0, n_sub, 1, n_sub).mapInArrow(fit, "m long, book binary").orderBy("m").collect()
    shared.unpersist()
    return [np.frombuffer(bytes(r["book"])).reshape(-1, x.shape[1] // n_sub) for r in books]


def learned_rotation(x: np.ndarray, n_sub: int, n_bits: int, out_dim: int, rounds: int = 8,
                     seed: int = 42) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotation to ``out_dim`` dimensions and codebooks in it: codebooks for
    the rotated sample and the best rotation onto its reconstruction (from
    the singular vectors of their cross product) in turn."""
    turn = random_rotation(x.shape[1], out_dim, seed)
    books = pq_books(x @ turn, n_sub, n_bits, seed)
    for _ in range(rounds):
        codes = ProductCodes("<f8", books)
        u, _, vt = np.linalg.svd(x.T @ codes.decode(codes.encode(x @ turn)), full_matrices=False)
        turn = u @ vt
        books = pq_books(x @ turn, n_sub, n_bits, seed)
    return turn, books


def pq_search(queries: DataFrame, corpus: DataFrame, k: int | None, n_sub: int = 96, n_bits: int = 8, refine: int = 0,
              fit_rows: int = FIT_ROWS, seed: int = 42, books: list[np.ndarray] | None = None,
              rotation: np.ndarray | None = None) -> DataFrame:
    """Search in product codes.  ``books`` (and ``rotation``) fitted before
    may be passed in.  Without ``k`` every document is scored and ranked for
    every query, none dropped."""
    if books is None:
        books = pq_books(fit_sample(corpus, fit_rows), n_sub, n_bits, seed)
    scorer = ProductCodes(float_type(queries, "embedding"), books, rotation)
    q, d = pack(queries, "query_id", "embedding"), pack(corpus, "doc_id", "embedding", scorer.encode)
    if k is None:
        return all_scores(q, d, scorer)
    found = top_k(q, d, max(k, refine), scorer)
    return rerank(found, queries, corpus, k) if refine else found.select("query_id", "doc_id", "score", "rank")


def opq_search(queries: DataFrame, corpus: DataFrame, k: int, n_sub: int = 96, n_bits: int = 8, refine: int = 0,
               out_dim: int | None = None, rounds: int = 8, fit_rows: int = FIT_ROWS, seed: int = 42) -> DataFrame:
    """Product codes behind a learned rotation to ``out_dim`` (default
    ``4 * n_sub``) dimensions."""
    sample = fit_sample(corpus, fit_rows)
    rotation, books = learned_rotation(sample, n_sub, n_bits, out_dim or 4 * n_sub, rounds, seed)
    return pq_search(queries, corpus, k, refine=refine, books=books, rotation=rotation)


# ------------------------------------------------------------------ cells

def _keyed(df: DataFrame, id_col: str, keys_of, columns: int) -> DataFrame:
    """Packed rows with ``table`` and ``key``, one for each of the
    ``columns`` cell numbers that ``keys_of`` gives a vector."""
    kind = float_type(df, "embedding")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(1).to_pylist()
            keys = keys_of(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64))
            for t in range(columns):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(len(raw), t)), pa.array(np.ascontiguousarray(keys[:, t]))],
                    names=["id", "payload", "grp", "table", "key"])

    return pack(df, id_col, "embedding").mapInArrow(run, "id long, payload binary, grp long, table long, key long")


def ivf_search(queries: DataFrame, corpus: DataFrame, k: int, n_lists: int = 64, n_probe: int = 40,
               fit_rows: int = FIT_ROWS, seed: int = 42) -> DataFrame:
    """Inverted lists: documents belong to the nearest of ``n_lists``
    centroids, a query looks into the lists of its ``n_probe`` nearest ones
    and scores their documents exactly.  All lists probed is exact search."""
    centres = kmeans(fit_sample(corpus, fit_rows), n_lists, seed)
    probes = min(n_probe, len(centres))

    def lists(x):
        half = (centres * centres).sum(1) / 2
        return np.argsort(half - x @ centres.T, axis=1, kind="stable")[:, :probes].astype(np.int64)

    q = _keyed(queries, "query_id", lists, probes)
    d = _keyed(corpus, "doc_id", lambda x: nearest(x, centres)[:, None].astype(np.int64), 1)
    scorer = Dot(float_type(queries, "embedding"), float_type(corpus, "embedding"))
    return cell_topk(q, d, ["key"], k, scorer)


def lsh_search(queries: DataFrame, corpus: DataFrame, k: int, n_tables: int = 24, bits: int = 4,
               seed: int = 42) -> DataFrame:
    """Random hyperplanes: a key of ``bits`` signs in each of ``n_tables``
    tables; documents that share a key in any table are scored exactly.
    Inner products become angles by one more dimension that gives every
    document the same length (F24).  No bits is exact search."""
    longest = corpus.where(F.col("embedding").isNotNull()).agg(
        F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    first = corpus.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
    dim = first[0] if first else 0
    planes = np.random.default_rng(seed).standard_normal((dim + 1, n_tables * bits))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def keys(x, extra):
        signs = (np.column_stack([x, extra]) @ planes > 0).reshape(len(x), n_tables, bits)
        return (signs * weights).sum(axis=2).astype(np.int64)

    q = _keyed(queries, "query_id", lambda x: keys(x, np.zeros(len(x))), n_tables)
    d = _keyed(corpus, "doc_id", lambda x: keys(x, np.sqrt(np.maximum((longest or 0.0) - (x * x).sum(1), 0))), n_tables)
    scorer = Dot(float_type(queries, "embedding"), float_type(corpus, "embedding"))
    return cell_topk(q, d, ["table", "key"], k, scorer)
