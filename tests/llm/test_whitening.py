import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening
from tessera.llm.registry import op11_whitening, op11_rows

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, component int"


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)
    return make


def twin(rows, k=32):
    """n, deviations, covariance and offsets by plain integers."""
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    c = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[sum(r[i] * r[j] for r in c) / n ** 3 for j in range(d)] for i in range(d)])
    return n, [sum(a * a for a in r) for r in c], v, np.array(c, float) / n


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 1 << 40, (131, 5)).astype(np.uint64)
    y[:, 3] = 7  # a constant dimension
    y[:, 4] = 0
    bits = np.array([40, 40, 40, 3, 0])
    products, ones = np.zeros((5, 5, 79), np.int64), np.zeros((5, 40), np.int64)
    for part in (y[:70], y[70:]):
        whitening.add_products(whitening.packed_planes(part, bits), bits, products, ones)
    for i in range(5):
        assert sum(int(c) << p for p, c in enumerate(ones[i])) == sum(map(int, y[:, i]))
        for j in range(i, 5):
            want = sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j]))
            assert sum(int(c) << w for w, c in enumerate(products[i, j])) == want


@pytest.mark.parametrize("d,n,spread", [(3, 40, 1.0), (40, 300, 0.3), (5, 100, 1e9)])
def test_against_plain_integers(table, d, n, spread):
    rng = np.random.default_rng(d)
    rows = [(i, [float(c) for c in rng.normal(0.2, spread, d) * (1 + np.arange(d))]) for i in range(n)]
    out = whitening.whitened_components(table(rows).repartition(4)).collect()
    n_, dev, v, offset = twin(rows)
    k = min(32, d)
    assert len(out) == n * k and {r.n for r in out} == {n_}
    assert {r.vec_id: int(r.deviation) for r in out} == dict(enumerate(dev))
    values = np.linalg.eigvalsh(v)[::-1]
    z = np.empty((n, k))
    for r in out:
        z[r.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-6 * r.explained
        assert 0 <= r.identity_error < 1e-6
    error = np.abs(z.T @ z / n - np.outer(z.mean(0), z.mean(0)) - np.eye(k)).max()
    assert abs(error - out[0].identity_error) < 1e-9
    # z * sqrt(e) are the offsets in axes that are orthonormal eigenvectors
    axes = np.linalg.lstsq(offset, z * np.sqrt(values[:k]), rcond=None)[0]
    assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-6)
    assert np.allclose(v @ axes, axes * values[:k], atol=1e-6 * values[0])


def test_edges(table, spark):
    assert whitening.whitened_components(table([])).collect() == []
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [1e30, 0.0])]
    assert whitening.whitened_components(table(bad)).collect() == []
    good = [(i, [float(i), float(-2 * i)]) for i in range(6)]  # dependent dimensions
    rows = bad + good + [(None, [3.0, 5.0]), (2, [0.0, 9.0]), (2, [0.0, 9.0])] + [(50, [1.0]), (51, [2.5]), (60, [1.0] * 3)]
    out = whitening.whitened_components(table(rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in out if r.n == 9) == \
        sorted([(False, i) for i in range(6)] * 2 + [(True, 0)] * 2 + [(False, 2)] * 4)
    one = sorted((r.vec_id, r.whitened) for r in out if r.n == 2)
    assert one == [(50, pytest.approx(-1)), (51, pytest.approx(1))]
    assert [(r.vec_id, r.component, r.whitened, r.explained, int(r.deviation)) for r in out if r.n == 1] == \
        [(60, c, None, None, 0) for c in (1, 2, 3)]
    line = whitening.whitened_components(table(good)).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)


def test_far_off_values_stay_exact(table):
    """A deviation beyond a long is whole in the operator, null in the query."""
    rows = [(0, [1e15, 0.5]), (1, [-1e15, 0.25]), (2, [3.0, 0.75])]
    out = whitening.whitened_components(table(rows))
    _, dev, _, _ = twin(rows)
    assert {r.vec_id: int(r.deviation) for r in out.collect()} == dict(enumerate(dev))
    thin = op11_rows(table(rows))
    assert {r.deviation for r in thin.collect() if r.vec_id == 0} == {None}
    assert dict(thin.dtypes)["deviation"] == "bigint"


def test_query_runs_on_the_given_table(spark):
    out = op11_whitening(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    got = out.agg(F.count("*").alias("rows"), F.max("identity_error").alias("e"), F.countDistinct("identity_error").alias("k")).first()
    assert got.rows == 32 * n and got.e < 1e-4 and got.k == 1
