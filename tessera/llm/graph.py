"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Links that one task contracts at a time.
BLOCK = 200_000


def min_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for every vertex of the
    links a-b: hook the larger root onto the smaller, then shorten paths."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    root = np.arange(len(ids))
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            return ids, ids[root]
        u, v = u[open_], v[open_]
        np.minimum.at(root, np.maximum(ru, rv)[open_], np.minimum(ru, rv)[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contract(batches):
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    if a:
        ids, roots = min_roots(np.concatenate(a), np.concatenate(b))
        far = ids != roots
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(roots[far])], names=["a", "b"])


def _forest(links: DataFrame, blocks: int) -> DataFrame:
    """Links with the same components, one fewer than vertices in each dealt
    block: blocks of bounded size are contracted on their own."""
    return links.repartition(blocks, "a").mapInArrow(_contract, "a long, b long")


def connected_components(links: DataFrame) -> DataFrame:
    """``vertex, comp`` (the component's smallest vertex) of every vertex of
    ``links`` (columns ``a``, ``b``: longs, not null).

    Each round contracts blocks of ``BLOCK`` links locally, lets every vertex
    left point at its smallest neighbour, follows the pointers to their ends
    by doubling, and goes on with the links between different ends; at least
    half of the vertices vanish in a round, and when one block holds what is
    left, its contraction is the last round.  No task ever holds more than a
    block, however large a component is, and every round starts from written
    tables.
    """
    links = stage(links.select("a", "b").filter("a <> b"), "links")
    rounds = []
    while True:
        n = links.count()
        if n <= BLOCK:  # what is left fits one block
            last = stage(links.coalesce(1).mapInArrow(_contract, "a long, b long"), "last")
            roots = last.select("b", "b").distinct()
            rounds.append(last.union(roots).toDF("vertex", "comp"))
            break
        links = stage(_forest(links, n // BLOCK + 1), "forest")
        both = links.union(links.select("b", "a"))
        up = stage(both.groupBy(F.col("a").alias("vertex"))
                   .agg(F.least(F.min("b"), F.col("vertex")).alias("comp")), "up")
        while True:
            to = up.select(F.col("vertex").alias("comp"), F.col("comp").alias("next"))
            jumped = stage(up.join(to, "comp").select("vertex", "comp", "next"), "jump")
            if jumped.filter("comp <> next").isEmpty():
                break
            up = jumped.select("vertex", F.col("next").alias("comp"))
        rounds.append(up)
        ends_a = up.select(F.col("vertex").alias("a"), F.col("comp").alias("ra"))
        ends_b = up.select(F.col("vertex").alias("b"), F.col("comp").alias("rb"))
        links = stage(links.join(ends_a, "a").join(ends_b, "b").filter("ra <> rb")
                      .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    out = rounds[0]
    for step in rounds[1:]:
        step = step.select(F.col("vertex").alias("comp"), F.col("comp").alias("next"))
        out = out.join(step, "comp", "left").select("vertex", F.coalesce("next", "comp").alias("comp"))
    return out
