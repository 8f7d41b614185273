"""Contrastive losses as table computations over (query, passage) score
rows.  Every log-sum-exp subtracts the group maximum first (temperatures
are as small as 0.002).

Input rows: ``group_id, batch_id, pos, score`` where ``pos`` 0 is the
positive of the group; ``score`` is the raw similarity (divide by the
temperature here).  The in-batch loss takes the vectors themselves: queries
and passages of a batch meet in blocks, one matrix product each, and a query
carries only its running log-sum-exp, so no row stands for a pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import float_type

#: Queries and passages of a tile; a batch of up to so many is one tile.
QUERY_BLOCK, PASSAGE_BLOCK = 2048, 32_768
#: Scores computed at once inside a tile.
_SCORES = 1 << 22


def _lse_loss(rows: DataFrame, keys: list[str], logit: str, target) -> DataFrame:
    w = Window.partitionBy(*keys)
    m = rows.withColumn("_m", F.max(logit).over(w))
    return (m.groupBy(*keys)
            .agg((F.max("_m") + F.log(F.sum(F.exp(F.col(logit) - F.col("_m"))))
                  - F.max(F.when(target, F.col(logit)))).alias("loss")))


def hn_only_loss(rows: DataFrame, temperature: float, coef: float = 1.0) -> DataFrame:
    """Cross-entropy over each group's own passages, target position 0
    (L1).  Returns ``group_id, loss``."""
    r = rows.withColumn("_logit", F.col("score") / temperature)
    out = _lse_loss(r, ["group_id"], "_logit", F.col("pos") == 0)
    return out.withColumn("loss", F.col("loss") * coef)


def in_batch_loss(queries: DataFrame, passages: DataFrame, temperature: float,
                  score_fn, across: str | None = None) -> DataFrame:
    """In-batch / cross-batch contrastive loss (L2, J10).  ``across`` names a
    column of both sides that widens a batch: queries score the passages of
    all batches with its value (batches of several devices in one step).

    ``queries``: ``batch_id, group_id, q_vec, hn_only``; ``passages``:
    ``batch_id, group_id, pos, p_vec``.  Every query of a batch scores every
    passage of the batch; the target is the query's own positive; for
    ``hn_only`` queries passages of other groups are masked out.  Returns
    per query ``batch_id, group_id, loss``."""
    key = across or "batch_id"
    passages = passages.select(key, F.col("group_id").alias("p_group"), "pos", "p_vec")
    pairs = (queries.join(passages, key)
             .where(~F.col("hn_only") | (F.col("p_group") == F.col("group_id")))
             .withColumn("_logit", score_fn(F.col("q_vec"), F.col("p_vec")) / temperature))
    target = (F.col("p_group") == F.col("group_id")) & (F.col("pos") == 0)
    return _lse_loss(pairs, ["batch_id", "group_id"], "_logit", target)


def _tiles(q_kind: str, p_kind: str, temperature: float):
    """Of every tile: each query's largest logit, the sum of exponentials
    below it and its positive's logit, where it has any."""
    def run(batches):
        tile, queries, state = None, None, None

        def done():
            top, total, positive = state
            ok = np.isfinite(top)
            return pa.RecordBatch.from_arrays(
                [pa.array(queries[0][ok]), pa.array(top[ok]), pa.array(total[ok]),
                 pa.array(positive[ok], from_pandas=True)], names=["query", "top", "total", "positive"])

        for batch in batches:
            tiles, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((tiles[1:] != tiles[:-1]) | (sides[1:] != sides[:-1])) + 1
            for lo, hi in zip(np.append(0, change), np.append(change, len(tiles))):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                raw = part.column(6).to_pylist()
                keys, groups = part.column(2).to_numpy(), part.column(3).to_numpy()
                if tiles[lo] != tile:
                    if state is not None:
                        yield done()
                    tile, queries, state = tiles[lo], None, None
                if sides[lo] == 0:
                    x = np.frombuffer(b"".join(raw), q_kind).reshape(len(raw), -1).astype(np.float64)
                    own = [keys, groups, part.column(5).to_numpy(zero_copy_only=False), x]
                    queries = own if queries is None else [np.concatenate(z) for z in zip(queries, own)]
                elif queries is not None:
                    if state is None:
                        n = len(queries[0])
                        state = np.full(n, -np.inf), np.zeros(n), np.full(n, np.nan)
                    d = np.frombuffer(b"".join(raw), p_kind).reshape(len(raw), -1).astype(np.float64)
                    _add_tile(state, queries, groups, part.column(4).to_numpy(), d, temperature)
        if state is not None:
            yield done()
    return run


def _add_tile(state, queries, groups, pos, d, temperature) -> None:
    top, total, positive = state
    step = max(1, _SCORES // len(d))
    for lo in range(0, len(top), step):
        rows = slice(lo, lo + step)
        logits = queries[3][rows] @ d.T / temperature
        same = queries[1][rows, None] == groups[None, :]
        target = same & (pos == 0)[None, :]
        hit = target.any(axis=1)
        positive[rows][hit] = np.where(target, logits, -np.inf).max(axis=1)[hit]
        logits[queries[2][rows, None] & ~same] = -np.inf
        new = np.maximum(top[rows], logits.max(axis=1))
        safe = np.where(np.isfinite(new), new, 0.0)
        total[rows] = total[rows] * np.exp(top[rows] - safe) + np.exp(logits - safe[:, None]).sum(axis=1)
        top[rows] = new


def in_batch_loss_blocks(queries: DataFrame, passages: DataFrame, temperature: float, across: str | None = None,
                         query_block: int = QUERY_BLOCK, passage_block: int = PASSAGE_BLOCK) -> DataFrame:
    """:func:`in_batch_loss` of inner products (L2, J10), without a row for
    each pair; a query without a positive has a null loss, null vectors are
    left out.

    A batch is cut into blocks of about ``query_block`` queries and
    ``passage_block`` passages; a tile is one of each.  A vector travels once
    for each block of the other side - once, for batches of that size - and a
    task holds a tile's queries and streams its passages.  Tiles of one batch
    may run in different tasks: their log-sum-exps are merged.
    """
    key = across or "batch_id"
    sizes = queries.groupBy(key).agg(F.count(F.lit(1)).alias("_q")).join(
        passages.groupBy(key).agg(F.count(F.lit(1)).alias("_p")), key).select(
        F.col(key), F.ceil(F.col("_q") / query_block).alias("_nq"), F.ceil(F.col("_p") / passage_block).alias("_np"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def packed(df, vec, name):
        """The vector column as bytes, beside the others."""
        kind = float_type(df, vec)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    at = b.schema.get_field_index(vec)
                    x = np.array(b.column(at).to_pylist(), dtype=kind)
                    out = pa.array([r.tobytes() for r in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(b.columns)],
                                                     names=[name if i == at else n for i, n in enumerate(b.schema.names)])
        schema = ", ".join(f"`{name if f == vec else f}` {'binary' if f == vec else t}" for f, t in df.dtypes)
        return df.mapInArrow(run, schema)

    q = queries.select("batch_id", "group_id", F.col(key).alias("_key"), "hn_only", "q_vec").where(F.col("q_vec").isNotNull())
    p = passages.select(F.col(key).alias("_key"), "group_id", "pos", "p_vec").where(F.col("p_vec").isNotNull())
    sizes = sizes.withColumnRenamed(key, "_key")
    deal = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.col(n))
    query, group = F.xxhash64("batch_id", "group_id"), F.xxhash64("group_id").alias("_group")
    qs = packed(q, "q_vec", "payload").join(sizes, "_key").withColumn("_qb", deal("_nq", "group_id")).withColumn("_pb", all_of("_np"))
    ps = packed(p, "p_vec", "payload").join(sizes, "_key").withColumn("_pb", deal("_np", "group_id", "pos")).withColumn("_qb", all_of("_nq"))
    tile = F.xxhash64("_key", "_qb", "_pb").alias("_tile")
    rows = qs.select(tile, F.lit(0).alias("_side"), query.alias("_query"), group, F.lit(0).cast("int").alias("pos"),
                     F.coalesce("hn_only", F.lit(False)).alias("hn_only"), "payload").unionByName(
        ps.select(tile, F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_query"), group, F.col("pos").cast("int").alias("pos"),
                  F.lit(False).alias("hn_only"), "payload"))
    found = rows.repartition("_tile").sortWithinPartitions("_tile", "_side").mapInArrow(
        _tiles(float_type(queries, "q_vec"), float_type(passages, "p_vec"), temperature),
        "query long, top double, total double, positive double")
    # a query has one row for each block of passages
    merged = found.groupBy("query").agg(
        F.max("top").alias("top"), F.collect_list(F.struct("top", "total")).alias("parts"), F.max("positive").alias("positive"))
    total = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["total"] * F.exp(x["top"] - F.col("top")))
    loss = (F.col("top") + F.log(total) - F.col("positive")).alias("loss")
    ids = q.select("batch_id", "group_id", query.alias("query")).distinct()
    return ids.join(merged.select("query", loss), "query").select("batch_id", "group_id", "loss")


def kl_loss(rows: DataFrame, temperature: float) -> DataFrame:
    """KL(softmax(teacher) || softmax(student / T)) per group (L3); the
    batch mean of these values is the 'batchmean' reduction.  Rows:
    ``group_id, score (student), teacher``."""
    w = Window.partitionBy("group_id")
    s = F.col("score") / temperature
    r = (rows.withColumn("_s", s)
         .withColumn("_sl", F.col("_s") - F.max("_s").over(w))
         .withColumn("_tl", F.col("teacher") - F.max("teacher").over(w))
         .withColumn("_ls", F.col("_sl") - F.log(F.sum(F.exp("_sl")).over(w)))
         .withColumn("_lt", F.col("_tl") - F.log(F.sum(F.exp("_tl")).over(w))))
    return r.groupBy("group_id").agg(
        F.sum(F.exp("_lt") * (F.col("_lt") - F.col("_ls"))).alias("kl"))


def single_domain_loss(batch_loss: DataFrame, batch_domains: DataFrame) -> DataFrame:
    """Per-domain loss logged only for batches holding one domain (L4).
    ``batch_loss``: ``batch_id, loss``; ``batch_domains``: ``batch_id,
    domain`` rows."""
    one = (batch_domains.groupBy("batch_id")
           .agg(F.countDistinct("domain").alias("_n"), F.first("domain").alias("domain"))
           .where(F.col("_n") == 1).drop("_n"))
    return batch_loss.join(one, "batch_id")
