"""The block-wise in-batch loss against the form with a row for each pair."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import losses as L
from tessera.plans.registry import all_queries

from conftest import SF001


def _batch(spark, sizes, dim=6, kind="float", seed=0):
    rng = np.random.default_rng(seed)
    q, p = [], []
    for b, n in enumerate(sizes):
        for g in range(n):
            q.append((b, b // 2, g, rng.normal(0, 1, dim).tolist(), bool(g % 5 == 0)))
            p += [(b, b // 2, g, k, rng.normal(0, 1, dim).tolist()) for k in range(4)]
    return (spark.createDataFrame(q, f"batch_id long, step long, group_id long, q_vec array<{kind}>, hn_only boolean"),
            spark.createDataFrame(p, f"batch_id long, step long, group_id long, pos int, p_vec array<{kind}>"))


def _losses(df):
    return {(r.batch_id, r.group_id): r.loss for r in df.collect()}


@pytest.mark.parametrize("blocks", [{}, {"query_block": 7, "passage_block": 11}, {"query_block": 1, "passage_block": 1}])
@pytest.mark.parametrize("across", [None, "step"])
def test_equals_the_form_by_pairs(spark, blocks, across):
    """Small temperature, masked queries, one and many tiles a batch, batches
    of one step that hold the same group numbers."""
    q, p = _batch(spark, [30, 1, 9, 17], kind="double")
    want = _losses(L.in_batch_loss(q, p, 0.01, V.dot, across=across))
    assert _losses(L.in_batch_loss_blocks(q, p, 0.01, across=across, **blocks)) == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert len(want) == 57


def test_large_logits_do_not_overflow(spark):
    q, p = _batch(spark, [6])
    big = _losses(L.in_batch_loss_blocks(q, p, 1e-6, query_block=2, passage_block=3))
    assert all(np.isfinite(v) for v in big.values())


def test_edges(spark):
    q, p = _batch(spark, [3])
    assert _losses(L.in_batch_loss_blocks(q.limit(0), p, 1.0)) == {}
    lone = _losses(L.in_batch_loss_blocks(q, p.where("group_id <> 1 OR pos > 0"), 1.0))
    assert lone[0, 1] is None and lone[0, 0] is not None
    gone = q.withColumn("q_vec", F.when(F.col("group_id") != 2, F.col("q_vec")))
    assert set(_losses(L.in_batch_loss_blocks(gone, p, 1.0))) == {(0, 0), (0, 1)}
    one = p.withColumn("p_vec", F.when(F.col("pos") != 3, F.col("p_vec")))
    want = _losses(L.in_batch_loss(q, p.where("pos <> 3"), 1.0, V.dot))
    assert _losses(L.in_batch_loss_blocks(q, one, 1.0)) == pytest.approx(want, rel=1e-6)


def test_vectors_travel_once_and_no_row_stands_for_a_pair(spark):
    q, p = _batch(spark, [40, 25])
    out = L.in_batch_loss_blocks(q, p, 1.0)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "MapInArrow" in plan
    run = all_queries()["loss_in_batch"].build(spark, SF001)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "p_vec" in plan and "q_vec" in plan and "aggregate(zip_with" not in plan
