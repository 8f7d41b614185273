"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are normalised and rotated into the principal axes, leading axis
first; a rotation keeps every cosine.  Sorted along the first axis they are
dealt into blocks, and a cell - one pair of blocks whose ranges on that axis
are near enough - is compared in tiles: the products of the leading axes come
first, what the other axes can add is bounded by the product of the rest
norms, and pairs that cannot reach the threshold any more are left there.
A cell answers with link counts and a spanning forest, never with pairs.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .graph import connected_components, min_roots

TILE = 1024
#: Entries of all vectors of a block that is sized by itself.
BLOCK_ENTRIES = 1 << 22
#: Ranges of the first axis that are told apart; each is cut into blocks.
RANGES = 256


def tile_links(a: np.ndarray, b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray,
               cuts: list[int], least: float, raw: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``a``, row of ``b``) with a product of ``least`` at
    least.  ``cuts`` are numbers of leading axes, the last one all of them;
    ``rest_*[k]`` the norms of what is behind ``cuts[k]``; ``raw`` the vectors
    that ``a`` and ``b`` were rotated from."""
    slack = 1e-9  # above any rounding of the partial sums
    part = a[:, :cuts[0]] @ b[:, :cuts[0]].T
    i, j = np.nonzero(part + np.outer(rest_a[0], rest_b[0]) >= least - slack)
    dots = part[i, j]
    for k in range(1, len(cuts)):
        dots = dots + np.einsum("ij,ij->i", a[i, cuts[k - 1]:cuts[k]], b[j, cuts[k - 1]:cuts[k]])
        open_ = dots + rest_a[k][i] * rest_b[k][j] >= (least - slack if k + 1 < len(cuts) or raw else least)
        i, j, dots = i[open_], j[open_], dots[open_]
    if raw:
        # what rounding could turn is decided on the vectors as they came
        sure = dots >= least + slack
        near = np.flatnonzero(~sure)
        for at in range(0, len(near), 1 << 14):
            some = near[at:at + (1 << 14)]
            sure[some] = cosines(raw[0][i[some]], raw[1][j[some]]) >= least
        i, j = i[sure], j[sure]
    return i, j


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, worked out in extended precision and rounded once."""
    x, y = (v.astype(np.longdouble) / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return ((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))).astype(np.float64)


def _rest(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    return np.stack([np.sqrt((x[:, c:] ** 2).sum(1)) for c in cuts])


def _unit(raw: list, kind: str, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they came, and normalised in the principal axes."""
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, len(axes)).astype(np.float64)
    y = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x, (y / np.sqrt((y * y).sum(1))[:, None]) @ axes


def _cell_links(rows, least: float, kind: str, axes: np.ndarray):
    """(vertex, links, root) of one cell; rows: vertex, weight, block, raw."""
    block = np.array([r["block"] for r in rows])
    sides = []
    for own in np.unique(block):
        mine = [r for r, k in zip(rows, block) if k == own]
        raw, x = _unit([r["raw"] for r in mine], kind, axes)
        order = np.argsort(x[:, 0], kind="stable")
        sides.append((x[order], np.array([r["vertex"] for r in mine])[order],
                      np.array([r["weight"] for r in mine])[order], raw[order]))
    dim = len(axes)
    cuts = sorted({max(1, dim // 4), max(1, dim // 2), dim})
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    (xa, va, wa, raw_a), (xb, vb, wb, raw_b) = sides[0], sides[-1]
    one = len(sides) == 1
    ra, rb = _rest(xa, cuts), _rest(xb, cuts)
    vertex, weight = (va, wa) if one else (np.concatenate([va, vb]), np.concatenate([wa, wb]))
    shift = 0 if one else len(va)
    count = np.zeros(len(vertex), np.int64)
    ends = [np.empty((2, 0), np.int64)]
    for s in range(0, len(xa), TILE):
        for t in range(s if one else 0, len(xb), TILE):
            a, b = xa[s:s + TILE], xb[t:t + TILE]
            if b[0, 0] - a[-1, 0] > reach or a[0, 0] - b[-1, 0] > reach:
                continue
            i, j = tile_links(a, b, ra[:, s:s + TILE], rb[:, t:t + TILE], cuts, least,
                              (raw_a[s:s + TILE], raw_b[t:t + TILE]))
            i, j = i + s, j + t + shift
            if one:
                i, j = i[i < j], j[i < j]
            if len(i):
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                ids, roots = min_roots(i, j)
                ends.append(np.stack([ids, roots]))
    ids, roots = min_roots(*np.concatenate(ends, axis=1))
    root = np.arange(len(vertex))
    root[ids] = roots
    linked = np.flatnonzero(count)
    return vertex[linked], count[linked], vertex[root[linked]]


def _cells(least: float, kind: str, axes: np.ndarray):
    names = ["vertex", "links", "root"]

    def done(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _cell_links(rows, least, kind, axes)],
                                          names=names)

    def run(batches):
        cell, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["cell"] != cell:
                    yield done(rows)
                    rows = []
                cell = row["cell"]
                rows.append(row)
        if rows:
            yield done(rows)
    return run


def _leads(kind: str, axes: np.ndarray):
    """Adds the place on the first axis."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lead = _unit(batch.column(2).to_pylist(), kind, axes)[1][:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)], names=["vertex", "weight", "raw", "lead"])
    return run


def _pack(kind: str):
    def run(batches):
        for batch in batches:
            vectors = [None if v is None else np.asarray(v, kind).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())],
                                             names=["row", "vec_id", "raw"])
    return run


def _links(classes: DataFrame, n: int, dim: int, kind: str, least: float, block: int | None) -> DataFrame:
    """``vertex, links, root`` of the classes (``vertex, weight, raw``) of one
    length, cell by cell."""
    spark = classes.sparkSession
    axes = np.eye(dim)
    if n > 1 and dim > 1:
        def unit(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _unit(batch.column(0).to_pylist(), kind, np.eye(dim))[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.ListArray.from_arrays(np.arange(0, x.size + 1, dim, dtype=np.int32), pa.array(x.ravel()))], names=["x"])
        rows = classes.select("raw").mapInArrow(unit, "x array<double>").select(array_to_vector("x").alias("x"))
        axes = PCA(k=dim, inputCol="x", outputCol="y").fit(rows).pc.toArray()
        if not np.allclose(axes.T @ axes, np.eye(dim), atol=1e-9):
            axes = np.linalg.qr(axes)[0]
    turned = stage(classes.select("vertex", "weight", "raw").mapInArrow(
        _leads(kind, axes), "vertex long, weight long, raw binary, lead double"), "turned")
    if block is None:
        # as many blocks as give every core a few cells, more only where a
        # block would not fit a task: a vector travels once for each block
        cores = spark.sparkContext.defaultParallelism
        block = min(max(2048, ceil(n / ceil((5 * cores) ** 0.5))), max(2048, BLOCK_ENTRIES // dim))

    # ranges of the first axis, cut into blocks of about `block` vectors
    wanted = min(RANGES, -(-n // block))
    edges = sorted(set(turned.approxQuantile("lead", [k / wanted for k in range(1, wanted)], 1 / (4 * wanted)))) \
        if wanted > 1 else []
    in_range = sum((F.col("lead") >= F.lit(e)).cast("int") for e in edges) if edges else F.lit(0)
    ranged = turned.withColumn("range", in_range)
    stats = {r["range"]: r for r in ranged.groupBy("range").agg(
        F.count(F.lit(1)).alias("n"), F.min("lead").alias("lo"), F.max("lead").alias("hi")).collect()}
    reach = (max(0.0, 2 - 2 * least)) ** 0.5 + 1e-9
    start, plan = 0, []
    for k in sorted(stats):
        plan.append((k, start, -(-stats[k]["n"] // block)))
        start += plan[-1][2]
    spans = [(k, first, cut,
              min(f for q, f, _ in plan if stats[k]["lo"] - stats[q]["hi"] <= reach and q <= k),
              max(f + c - 1 for q, f, c in plan if stats[q]["lo"] - stats[k]["hi"] <= reach and q >= k))
             for k, first, cut in plan]
    plan = spark.createDataFrame(spans, "range int, first int, cut int, near_from int, near_to int")
    placed = ranged.join(F.broadcast(plan), "range").withColumn(
        "block", (F.col("first") + F.pmod(F.xxhash64("vertex"), F.col("cut"))).cast("long")) \
        .select("vertex", "weight", "raw", "block", F.explode(F.sequence("near_from", "near_to")).alias("other"))
    cells = placed.withColumn("cell", F.least("block", "other") * F.lit(1 << 31) + F.greatest("block", "other"))
    return stage(cells.select("cell", "block", "vertex", "weight", "raw")
                 .repartition("cell").sortWithinPartitions("cell")
                 .mapInArrow(_cells(least, kind, axes), "vertex long, links long, root long"), "met")


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.9, block: int | None = None,
                           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Two vectors link when their cosine in double precision reaches ``least``;
    ``n_links`` counts the other vectors linked directly, ``component_id`` is
    the smallest ``vec_id`` that links reach.

    * Null and zero vectors, and vectors with null or non-finite components,
      link with nothing; vectors link with those of their own length.
    * Where the cosine is so close to ``least`` that a rotation's rounding
      could turn it, it is worked out anew from the vectors as they came, in
      extended precision, rounded to a double once and compared.
    * Equal vectors (repeated rows too) are one vertex with a weight, so a
      group of copies costs one comparison.
    * A null ``vec_id`` takes part in links but never represents a component
      that has an id.
    * An empty table gives an empty result; other columns are ignored.

    All vectors are compared with all that the first axis does not rule out,
    so work can grow with the square of the number of *different* vectors;
    memory is two blocks for each task.  A vector is shuffled once for each
    block near its own: by default there are about as many blocks as give
    every core a few pairs of them, whatever the number of vectors, until a
    block would exceed ``BLOCK_ENTRIES``.
    """
    v = F.col(vector_col)
    fine = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                                               & (F.abs(x) < float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    # 4-byte floats stay 4 bytes; the work is done in double precision
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = stage(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                                F.when(fine, v.cast("array<float>" if kind == "<f4" else "array<double>")).alias("vector"))
                 .mapInArrow(_pack(kind), "row long, vec_id long, raw binary"), "vectors")
    classes = stage(rows.filter("raw is not null").groupBy("raw").agg(
        F.min("row").alias("vertex"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight")), "classes")
    # a length is a table of its own; one with a single vector has no pairs
    lengths = classes.groupBy(F.length("raw").alias("bytes")).count().filter("count > 1").collect()
    met = classes.sparkSession.createDataFrame([], "vertex long, links long, root long")
    for own in sorted(lengths):
        met = met.union(_links(classes.filter(F.length("raw") == own["bytes"]), own["count"],
                               own["bytes"] // np.dtype(kind).itemsize, kind, least, block))
    comps = connected_components(met.select(F.col("vertex").alias("a"), F.col("root").alias("b")))

    links = met.groupBy("vertex").agg(F.sum("links").alias("links"))
    placed = classes.select("raw", "vertex", "first_id", "weight").join(links, "vertex", "left") \
        .join(comps, "vertex", "left").withColumn("comp", F.coalesce("comp", "vertex"))
    first = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = placed.join(first, "comp").select(
        "raw", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = rows.filter("raw is not null").join(named, "raw").select("vec_id", "n_links", "component_id")
    alone = rows.filter("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                              F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
