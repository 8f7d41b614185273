"""Whitening of embeddings from exact second moments.

Entries become integers.  Their cross-products over all rows come from bit
planes: each dimension's planes are packed across the rows into words, and
the products of two dimensions are the popcounts of ANDed planes, weighted by
the planes' powers of two.  Sums and products are exact integers and are
centred as such; only the centred matrix becomes floating point for the
eigenvectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no long; their vectors count as non-finite.
LIMIT = float(1 << 56)
#: Eigenvalues below this share of the largest are rounding, not variance.
NEGLIGIBLE = 1e-11
#: A dimension's partial sums are added in this many tasks before the last.
FAN = 16


def integers(flat: np.ndarray) -> np.ndarray:
    """``floor(64 c) + 1000000`` of entries."""
    return np.floor(SCALE * flat.astype(np.float64)).astype(np.int64) + SHIFT


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vector`` (double) of rows that can be whitened."""
    entry = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), entry.alias("vector")).filter(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda c: F.abs(c) < LIMIT))


def _by_length(batch, column: int):
    """(dim, row numbers, matrix) of a batch's vectors, by their lengths."""
    vectors = batch.column(column)
    starts = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, flat[starts[rows][:, None] + np.arange(dim)]


def _ranges(batches):
    """Smallest and largest integer of every dimension."""
    held = {}
    for batch in batches:
        for dim, rows, m in _by_length(batch, 0):
            x = integers(m)
            lo, hi, n = held.get(dim, (x[0], x[0], 0))
            held[dim] = np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0)), n + len(rows)
    for dim, (lo, hi, n) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(lo), pa.array(hi),
             pa.array(np.full(dim, n))], names=["dim", "j", "lo", "hi", "n"])


def packed_planes(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bit planes of the columns of ``y`` (unsigned), a row of words for
    each plane: those of column 0 from the lowest, then of column 1, ..."""
    out = np.zeros((int(bits.sum()), -(-len(y) // 64)), np.uint64)
    size, k = -(-len(y) // 8), 0
    for j, n in enumerate(bits.tolist()):
        col = np.ascontiguousarray(y[:, j])
        for p in range(n):
            one = (col >> np.uint64(p) & np.uint64(1)).astype(np.uint8)
            out[k].view(np.uint8)[:size] = np.packbits(one, bitorder="little")
            k += 1
    return out


def add_products(planes: np.ndarray, bits: np.ndarray, products: np.ndarray, ones: np.ndarray) -> None:
    """Adds to ``products[i, j, w]`` (j >= i) the rows in which planes of i
    and j of total weight 2^w are both set, to ``ones[i, p]`` those in which
    plane p of i is."""
    column = np.repeat(np.arange(len(bits)), bits)
    power = np.concatenate([np.arange(n) for n in bits.tolist()]) if len(bits) else column
    first = np.cumsum(bits) - bits
    for k in range(len(planes)):
        i, p = column[k], power[k]
        start = first[i]  # a column's planes meet each other in both orders
        n = np.bitwise_count(planes[k] & planes[start:]).sum(axis=1, dtype=np.int64)
        products[i, column[start:], p + power[start:]] += n
        ones[i, p] += n[k - start]


_PARTS = "dim int, j int, part int, products binary, ones binary"


def _part(dim, part, products, ones):
    n = len(products)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, dim, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
         pa.array(np.full(n, part, np.int32)), pa.array([p.tobytes() for p in products], pa.binary()),
         pa.array([o.tobytes() for o in ones], pa.binary())], names=["dim", "j", "part", "products", "ones"])


def _scatter(ranges: dict):
    """Plane counts of a partition; ``ranges`` holds (lo, bits) by length."""
    def run(batches):
        from pyspark import TaskContext
        held = {}
        for batch in batches:
            for dim, _, m in _by_length(batch, 0):
                lo, bits = ranges[dim]
                if dim not in held:
                    top = max(1, int(bits.max()))
                    held[dim] = np.zeros((dim, dim, 2 * top - 1), np.int64), np.zeros((dim, top), np.int64)
                planes = packed_planes((integers(m) - lo).astype(np.uint64), bits)
                add_products(planes, bits, *held[dim])
        for dim, (products, ones) in held.items():
            yield _part(dim, TaskContext.get().partitionId(), products, ones)
    return run


def _add(batches):
    """Sums the parts of each (dim, j) of sorted rows."""
    last, held, part = None, None, 0
    names = ["dim", "j", "part", "products", "ones"]

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.int32()), pa.array([part], pa.int32()),
             pa.array([held[0].tobytes()], pa.binary()), pa.array([held[1].tobytes()], pa.binary())], names=names)
    for batch in batches:
        for r in batch.to_pylist():
            own = [np.frombuffer(r["products"], np.int64), np.frombuffer(r["ones"], np.int64)]
            if last != (r["dim"], r["j"]):
                if held is not None:
                    yield done()
                last, held, part = (r["dim"], r["j"]), own, r["part"]
            else:
                held = [held[0] + own[0], held[1] + own[1]]
    if held is not None:
        yield done()


@dataclass
class Whitening:
    """What whitens vectors of one length.  ``lo`` and ``sums`` (of x - lo)
    are exact; ``axes`` holds a unit eigenvector per column."""

    n: int
    lo: np.ndarray
    width: int
    sums: list
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def explained(self) -> list:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.values]

    def has_variance(self) -> np.ndarray:
        return self.values > (NEGLIGIBLE * self.values[0] if len(self.values) else 0)

    def apply(self, matrix: np.ndarray):
        """(deviation, whitened) of rows; a component without variance is NaN."""
        y = integers(matrix) - self.lo
        largest = self.n * (self.width + 1)
        if largest ** 2 * len(self.lo) < 1 << 62:
            centred = self.n * y - np.array(self.sums, np.int64)
            deviation = (centred * centred).sum(axis=1)
        else:
            centred = y.astype(object) * self.n - np.array(self.sums, object)
            deviation = (centred * centred).sum(axis=1)
        offset = (centred / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            white = offset @ self.axes / np.sqrt(np.where(self.has_variance(), self.values, np.nan))
        return deviation, white


def centred_products(n: int, sums: list, products: list) -> np.ndarray:
    """Covariance from exact integers: n C - S S', then one division."""
    d, out = len(sums), np.empty((len(sums), len(sums)))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = (n * products[i][j] - sums[i] * sums[j]) / (n * n)
    return out


def fit(vectors: DataFrame, components: int = 32) -> dict[int, Whitening]:
    """A :class:`Whitening` for every length among ``vectors`` (column
    ``vector`` of doubles).  The driver sees ranges, plane counts and one
    d x d matrix for a length, never rows."""
    d = vectors.select("vector")
    found = d.mapInArrow(_ranges, "dim int, j int, lo long, hi long, n long").groupBy("dim", "j").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).orderBy("dim", "j").collect()
    lo, width, count = {}, {}, {}
    for r in found:
        lo.setdefault(r["dim"], []).append(r["lo"])
        width.setdefault(r["dim"], []).append(r["hi"] - r["lo"])
        count[r["dim"]] = r["n"]
    if not lo:
        return {}
    ranges = {k: (np.array(lo[k], np.int64), np.array([w.bit_length() for w in width[k]], np.int64)) for k in lo}
    parts = d.mapInArrow(_scatter(ranges), _PARTS)
    # two steps, so that no task adds up the parts of all partitions
    for of in ((F.col("part") % FAN).alias("part"), F.lit(0).cast("int").alias("part")):
        parts = parts.select("dim", "j", of, "products", "ones") \
            .repartition("dim", "j", "part").sortWithinPartitions("part", "dim", "j").mapInArrow(_add, _PARTS)
    out, rows = {}, {}
    for r in parts.collect():
        rows.setdefault(r["dim"], {})[r["j"]] = r
    for dim, own in rows.items():
        sums, products = [], []
        for j in range(dim):
            ones = np.frombuffer(own[j]["ones"], np.int64).tolist()
            sums.append(sum(c << p for p, c in enumerate(ones)))
            counts = np.frombuffer(own[j]["products"], np.int64).reshape(dim, -1)
            products.append([sum(c << w for w, c in enumerate(row)) for row in counts.tolist()])
        n = count[dim]
        v = centred_products(n, sums, products)
        values, axes = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:min(components, dim)]
        axes = axes[:, order]
        # either sign would do: the largest entry is positive
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
        out[dim] = Whitening(n, ranges[dim][0], max(width[dim]), sums, axes, np.maximum(values[order], 0), float(np.trace(v)))
    return out


_WHITE = "vec_id long, dim int, deviation decimal(38,0), whitened array<double>"


def whiten(vectors: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """``vec_id, dim, deviation, whitened`` (an array over the components)
    of every row.  ``deviation`` is null where 38 digits do not hold it."""
    models = {k: tuple(vars(m).values()) for k, m in models.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        kind = pa.decimal128(38, 0)
        for batch in batches:
            ids = batch.column(0)
            for dim, rows, m in _by_length(batch, 1):
                deviation, white = Whitening(*shared.value[dim]).apply(m)
                if deviation.dtype == object:
                    dev = pa.array([Decimal(v) if v < 10 ** 38 else None for v in deviation], kind)
                else:
                    dev = pa.array(deviation).cast(kind)
                k = white.shape[1]
                white = pa.array(white.ravel(), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), dev,
                     pa.ListArray.from_arrays(np.arange(0, k * len(rows) + 1, k, dtype=np.int32), white)],
                    names=["vec_id", "dim", "deviation", "whitened"])
    return vectors.select("vec_id", "vector").mapInArrow(run, _WHITE)


_MOMENTS = "dim int, part int, moments binary"


def _moments(batches):
    """Sums and products of the whitened rows of a partition."""
    from pyspark import TaskContext
    held = {}
    for batch in batches:
        for dim in np.unique(batch.column(0).to_numpy()).tolist():
            own = batch.column(1).filter(pa.array(batch.column(0).to_numpy() == dim))
            z = own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            z = np.column_stack([np.ones(len(z)), np.nan_to_num(z)])
            held[dim] = held.get(dim, 0) + z.T @ z
    for dim, m in held.items():
        yield _moment(dim, TaskContext.get().partitionId(), m)


def _moment(dim, part, m):
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int32()),
                                       pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())],
                                      names=["dim", "part", "moments"])


def _add_moments(batches):
    last, held, part = None, None, 0
    for batch in batches:
        for r in batch.to_pylist():
            own, key = np.frombuffer(r["moments"]), (r["dim"], r["part"] % FAN)
            if key != last:
                if held is not None:
                    yield _moment(last[0], last[1], held)
                last, held = key, own
            else:
                held = held + own
    if held is not None:
        yield _moment(last[0], last[1], held)


def identity_errors(white: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """By length: the largest absolute entry of the covariance of the stored
    ``whitened`` rows minus the identity, over components with variance."""
    sums = white.select("dim", "whitened").mapInArrow(_moments, _MOMENTS) \
        .withColumn("fan", F.col("part") % FAN).repartition("dim", "fan").sortWithinPartitions("dim", "fan", "part") \
        .drop("fan").mapInArrow(_add_moments, _MOMENTS).collect()
    total = {}
    for r in sorted(sums, key=lambda r: (r["dim"], r["part"])):
        total[r["dim"]] = total.get(r["dim"], 0) + np.frombuffer(r["moments"])
    out = {}
    for dim, flat in total.items():
        m = models[dim]
        k = 1 + len(m.values)
        moments = flat.reshape(k, k) / m.n
        own = m.has_variance()
        cov = (moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]))[np.ix_(own, own)]
        out[dim] = float(np.abs(cov - np.eye(len(cov))).max()) if len(cov) else 0.0
    return out


def whitened_components(df: DataFrame, components: int = 32, id_col: str = "vec_id",
                        vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n,
    deviation, whitened, explained, identity_error``.

    * Rows whose vector is null, empty, or holds null or non-finite entries
      are left out; so are entries of 2^56 and more, which have no long.
    * Vectors of different lengths are whitened apart, each length from its
      own rows; ``n`` counts those.
    * A component without variance (one row only, equal rows, a constant or
      dependent dimension) has a null ``whitened``; ``explained`` is null
      where there is no variance at all.
    * Null and repeated ids are rows like others; an empty table gives an
      empty result; other columns are ignored.
    """
    vectors = usable(df, id_col, vec_col)
    models = fit(vectors, components)
    white = stage(whiten(vectors, models), "whitened")
    errors = identity_errors(white, models)
    table = [(dim, k + 1, m.n, e, errors[dim]) for dim, m in models.items() for k, e in enumerate(m.explained())]
    told = df.sparkSession.createDataFrame(
        table, "dim int, component int, n long, explained double, identity_error double")
    rows = white.select("vec_id", "dim", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    # at most `components` rows for a length
    return rows.withColumn("component", F.col("place") + 1).join(F.broadcast(told), ["dim", "component"]).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
