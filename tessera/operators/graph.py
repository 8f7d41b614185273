"""Search over a graph of nearest neighbours (V7).

Different vectors are nodes; they are dealt into shards of bounded size (the
nearest of some centroids, large cells split further) and edges stay inside a
shard.  The neighbours of a node, and the nodes that name it as a neighbour,
are likely neighbours of each other, so every round groups the nodes by shard,
compares each node's surroundings with one matrix product and keeps the best
``degree`` neighbours of every node.  Rounds end when few edges change.  A search runs best-first through the shards' graphs,
many queries at a time.

Inner products become distances by one more dimension that gives every
document the same length (F24); the graph is built in that space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, join_small
from .ann import FIT_ROWS, fit_sample, kmeans, nearest
from .search import BROADCAST_QUERY_BYTES, _best, _select, float_type, pack

#: Neighbours of a node; with those that name it and the next and previous
#: node of its shard, a search sees at most 2 * DEGREE + 2 from one node.
DEGREE = 24
#: Nodes of a shard, which one task of a search holds.
SHARD_ROWS = 20_000
#: Neighbours that a surrounding offers to each of its nodes, and
#: surroundings that are compared at once.
OFFERS, OFFERED = 12, 1024
#: Queries that walk at once, and nodes that each opens in a step.
WALKERS, WIDTH = 128, 4
#: Nodes of a shard that every walk starts from.
ENTRIES = 64


@dataclass
class NeighbourGraph:
    """``nodes``: shard, cell, id, payload, nbrs; ``members``: node, doc_id
    (every document of a node's vector); ``changed``: edges that each round
    replaced."""

    nodes: DataFrame
    members: DataFrame
    kind: str
    degree: int
    centres: np.ndarray
    changed: list


def _vectors(raw: list, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours start, and the end."""
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)


def _grouped(batches, column: int = 0):
    """Batches of whole runs of equal keys, from sorted batches."""
    held = None
    for batch in batches:
        whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
        if not whole:
            continue
        keys = whole[0].column(column).to_numpy()
        last = _starts(keys)[-2]
        if last:
            yield whole[0].slice(0, last)
        held = whole[0].slice(last)
    if held is not None and held.num_rows:
        yield held


def _lists(ids: list, of: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32),
                                    pa.array(np.concatenate(ids) if ids else [], of))


def _dealt(nodes: DataFrame, kind: str, shard_rows: int, fit_rows: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """Adds ``cell`` and ``shard``; a cell of more than ``shard_rows`` nodes
    is split by a hash of the ids."""
    n = nodes.count()
    sample = nodes.select(F.col("id").alias("doc_id"), "payload").orderBy(F.xxhash64("id")).limit(fit_rows) \
        .select("payload").toArrow()["payload"].to_pylist()
    cells = -(-n // shard_rows)
    centres = kmeans(_vectors(sample, kind), cells, seed) if sample else np.zeros((0, 0))

    def run(batches):
        for b in batches:
            x = _vectors(b.column(1).to_pylist(), kind)
            if len(x):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(x, centres))],
                                                 names=["id", "payload", "cell"])
    found = cut_lineage(nodes.mapInArrow(run, "id long, payload binary, cell long"), "graph_cells")
    sizes = found.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("cuts"))
    out = join_small(found, sizes, "cell").withColumn(
        "shard", F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.col("cuts"))))
    return cut_lineage(out.select("shard", "cell", "id", "payload"), "graph_nodes"), centres


_GRAPH = "shard long, cell long, id long, payload binary, nbrs array<long>, sims array<double>, fresh long"


def _first_links(ids: np.ndarray, x: np.ndarray, degree: int, seed: int) -> np.ndarray:
    """For each node of a shard the next ones along a few random directions, -1 for none."""
    n, out = len(ids), []
    for at in (x @ np.random.default_rng(seed).standard_normal((x.shape[1], 3))).T:
        order = np.lexsort((ids, at))
        for j in range(1, max(1, degree // 2) + 1):
            next_ = np.full(n, -1, np.int64)
            next_[order[:-j]] = order[j:]
            out.append(next_)
    return np.stack(out, axis=1)


def _mixed(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """A hash of two numbers, another one each turn."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) + np.uint64(turn + 1)
    for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(c)
    return h ^ (h >> np.uint64(31))


def _namers(ids: np.ndarray, node: np.ndarray, member: np.ndarray, degree: int, turn: int) -> np.ndarray:
    """Nodes that name each node of a shard, -1 for none: one that very many
    name hears a bounded part of them, another one each turn."""
    order = np.lexsort((node, _mixed(ids[member], ids[node], turn), member))
    node, member = node[order], member[order]
    nth = np.arange(len(member)) - np.searchsorted(member, member)
    out = np.full((len(ids), degree), -1, np.int64)
    few = nth < degree
    out[member[few], nth[few]] = node[few]
    return out


def _offers(x: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of places in ``around`` (-1 for none): every member's best
    others, as ``to * n + other`` and products."""
    around = np.sort(around, axis=1)
    none = np.append(np.zeros((len(around), 1), bool), around[:, 1:] == around[:, :-1], axis=1) | (around < 0)
    y = x[around]
    s = y @ y.transpose(0, 2, 1)
    s[np.broadcast_to(none[:, None, :] | none[:, :, None], s.shape)] = -np.inf
    s[:, np.arange(s.shape[1]), np.arange(s.shape[1])] = -np.inf
    k = min(OFFERS, s.shape[1] - 1)
    at = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
    sims = np.take_along_axis(s, at, axis=2)
    others = np.take_along_axis(np.broadcast_to(around[:, None, :], s.shape), at, axis=2)
    ok = np.isfinite(sims)
    keys, first = np.unique((around[:, :, None] * len(x) + others)[ok], return_index=True)
    return keys, sims[ok][first]


def _keep_best(keys: np.ndarray, sims: np.ndarray, n: int, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``degree`` of all that was offered to each node, best first."""
    keys, first = np.unique(keys, return_index=True)
    sims = sims[first]
    order = np.lexsort((keys, -sims, keys // n))
    to = keys[order] // n
    order = order[np.arange(len(to)) - np.searchsorted(to, to) < degree]
    return keys[order], sims[order]


def _round(kind: str, degree: int, longest: float, index: int, seed: int):
    """One round in each shard, whose nodes come with the neighbours they have;
    ``fresh`` counts those that a node had not."""
    def run(batches):
        for b in _grouped(batches):
            cuts = _starts(b.column(0).to_numpy())
            for lo, hi in zip(cuts, cuts[1:]):
                part, n = b.slice(lo, hi - lo), int(hi - lo)
                ids, x = part.column(2).to_numpy(), _vectors(part.column(3).to_pylist(), kind)
                sizes = np.zeros(n, np.int64) if not index else pc.list_value_length(part.column(4)).to_numpy()
                node, member = np.repeat(np.arange(n), sizes), np.empty(0, np.int64)
                if index:
                    member = np.searchsorted(ids, part.column(4).flatten().to_numpy())
                    links = np.full((n, degree), -1, np.int64)
                    links[node, np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = member
                    links = np.hstack([links, _namers(ids, node, member, degree, index)])
                else:
                    links = _first_links(ids, x, degree, seed)
                around = np.hstack([links, np.arange(n)[:, None]])
                x = np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))])
                had = node * n + member
                keys, sims = had, part.column(5).flatten().to_numpy() if index else np.empty(0)
                for at in range(0, n, OFFERED):
                    more = _offers(x, around[at:at + OFFERED])
                    keys, sims = _keep_best(np.concatenate([keys, more[0]]), np.concatenate([sims, more[1]]), n, degree)
                to, ends = keys // n, np.arange(n + 1)
                ends = np.searchsorted(to, ends).astype(np.int32)
                fresh = np.bincount(to[~np.isin(keys, had)], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.ListArray.from_arrays(ends, pa.array(ids[keys % n], pa.int64())),
                     pa.ListArray.from_arrays(ends, pa.array(sims, pa.float64())), pa.array(fresh, pa.int64())],
                    names=["shard", "cell", "id", "payload", "nbrs", "sims", "fresh"])
    return run


def build_graph(corpus: DataFrame, degree: int = DEGREE, rounds: int = 8, settled: float = 0.01,
                shard_rows: int = SHARD_ROWS, fit_rows: int = FIT_ROWS, seed: int = 42) -> NeighbourGraph:
    """The graph of ``corpus`` (``doc_id, embedding``).  A round shuffles each
    node once, its vector and at most ``degree`` neighbours, to the task of
    its shard; it is the last when no more than ``settled`` of all edges
    changed.  Documents with equal vectors are one node, so copies do not fill
    each other's lists; null vectors are left out."""
    kind = float_type(corpus, "embedding")
    packed = cut_lineage(pack(corpus, "doc_id", "embedding").select(F.col("id").alias("doc_id"), "payload"), "graph_docs")
    nodes = packed.groupBy("payload").agg(F.min("doc_id").alias("id")).select("id", "payload")
    members = cut_lineage(packed.join(nodes, "payload").select(F.col("id").alias("node"), "doc_id"), "graph_members")
    nodes, centres = _dealt(nodes, kind, shard_rows, fit_rows, seed)

    def square(batches):
        for b in batches:
            x = _vectors(b.column(0).to_pylist(), kind)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([(x * x).sum(1).max()])], names=["s"])
    size = nodes.select("payload").mapInArrow(square, "s double").agg(F.max("s"), F.count(F.lit(1))).first()
    longest, n = size[0] or 0.0, nodes.count()
    state = nodes.select("shard", "cell", "id", "payload", F.lit(None).cast("array<long>").alias("nbrs"),
                         F.lit(None).cast("array<double>").alias("sims"))
    changed = []
    for index in range(rounds if n else 0):
        state = cut_lineage(state.select("shard", "cell", "id", "payload", "nbrs", "sims")
                            .repartition("shard").sortWithinPartitions("shard", "id")
                            .mapInArrow(_round(kind, degree, longest, index, seed), _GRAPH), "graph_edges")
        changed.append(state.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0])
        if changed[-1] <= settled * n * degree:
            break
    return NeighbourGraph(state.select("shard", "cell", "id", "payload", "nbrs"), members, kind, degree, centres, changed)


def _adjacency(ids: np.ndarray, nbrs: list, degree: int) -> np.ndarray:
    """A row of places for each node of a shard (ids ascending), -1 for none:
    its neighbours, up to ``degree`` nodes that name it, nearest first, and
    the nodes before and after it, by which every node can be reached."""
    n = len(ids)
    sizes = np.array([len(x) if x is not None else 0 for x in nbrs])
    source = np.repeat(np.arange(n), sizes)
    place = np.arange(len(source)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    target = np.searchsorted(ids, np.concatenate([x for x in nbrs if x] or [np.empty(0, np.int64)])).astype(np.int64)
    back = np.lexsort((source, place, target))
    nth = np.arange(len(back)) - np.searchsorted(target[back], target[back])
    few = back[nth < degree]
    a = np.concatenate([source, target[few], np.arange(n), np.arange(n)])
    b = np.concatenate([target, source[few], np.roll(np.arange(n), 1), np.roll(np.arange(n), -1)])
    pairs = np.unique(np.stack([a, b])[:, a != b], axis=1)
    nth = np.arange(pairs.shape[1]) - np.searchsorted(pairs[0], pairs[0])
    out = np.full((n, max(1, int(nth.max(initial=0)) + 1)), -1, np.int64)
    out[pairs[0], nth] = pairs[1]
    return out


def _reached(near: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Places that walks from ``entries`` meet which drop no node: all of them
    open every node, so whole fronts are opened at once, for all queries."""
    seen, front = np.zeros(len(near) + 1, bool), entries
    seen[-1] = True  # stands for "none"
    while len(front):
        seen[front] = True
        new = np.unique(near[front])
        front = new[~seen[new]]
    return np.flatnonzero(seen[:-1])


def walk(q: np.ndarray, x: np.ndarray, near: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places) of the best ``ef`` nodes that best-first walks of the
    queries meet; -inf and -1 where fewer were met.  Every walk opens its best
    unopened nodes until the best ``ef`` are all open."""
    rows = np.arange(len(q))[:, None]
    entries = np.unique(np.linspace(0, len(x) - 1, min(ENTRIES, len(x))).astype(np.int64))
    if ef >= len(x):
        met = _reached(near, entries)
        return q @ x[met].T, np.broadcast_to(met, (len(q), len(met)))
    seen = np.zeros((len(q), len(x) + 1), bool)
    at = np.broadcast_to(entries, (len(q), len(entries)))
    seen[rows, at] = seen[:, -1] = True  # the last column stands for "none"
    score, place, opened = q @ x[entries].T, at, np.zeros(at.shape, bool)
    while True:
        if score.shape[1] > ef:
            keep = np.argpartition(-score, ef - 1, axis=1)[:, :ef]
            score, place, opened = (np.take_along_axis(v, keep, axis=1) for v in (score, place, opened))
        open_ = np.where(opened, -np.inf, score)
        width = min(WIDTH, open_.shape[1])
        pick = np.argpartition(-open_, width - 1, axis=1)[:, :width]
        live = np.isfinite(np.take_along_axis(open_, pick, axis=1))
        if not live.any():
            return score, np.where(np.isfinite(score), place, -1)
        np.put_along_axis(opened, pick, True, axis=1)
        new = near[np.take_along_axis(place, pick, axis=1)]
        new = np.where(live[:, :, None], new, -1).reshape(len(q), -1)
        new = np.sort(np.where(seen[rows, new], -1, new), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        filled = int((new >= 0).sum(axis=1).max())
        if not filled:
            continue
        new = np.sort(new, axis=1)[:, -filled:]
        seen[rows, new] = True
        s = np.where(new >= 0, np.einsum("qd,qkd->qk", q, x[new]), -np.inf)
        score, place = np.hstack([score, s]), np.hstack([place, new])
        opened = np.hstack([opened, new < 0])


def graph_search(queries: DataFrame, graph: NeighbourGraph, k: int, ef: int = 128, probes: int | None = None,
                 query_bytes: int = BROADCAST_QUERY_BYTES) -> DataFrame:
    """Top-k by inner product: ``query_id, doc_id, score, rank``.  A query
    walks the shards of its ``probes`` nearest cells (default: of all); an
    ``ef`` of a shard's size or more makes the search exact.  A task holds one
    shard and one block of queries."""
    kind, q_kind, centres = graph.kind, float_type(queries, "embedding"), graph.centres
    q = cut_lineage(pack(queries, "query_id", "embedding").select("id", "payload"), "graph_queries")
    size = q.agg(F.coalesce(F.sum(F.length("payload") + 16), F.lit(0))).first()[0]
    blocks = -(-size // query_bytes) or 1
    chosen = min(probes or len(centres), len(centres))

    def cells(batches):
        half = (centres * centres).sum(1) / 2
        for b in batches:
            if b.num_rows and chosen:
                x = _vectors(b.column(1).to_pylist(), q_kind)
                at = np.argsort(half - x @ centres.T, axis=1, kind="stable")[:, :chosen]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), _lists(list(at), pa.int64())], names=["id", "payload", "cells"])
    shards = graph.nodes.select("cell", "shard").distinct()
    q = q.mapInArrow(cells, "id long, payload binary, cells array<long>").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    q = join_small(q.select("id", "payload", "block", F.explode("cells").alias("cell")), shards, "cell")
    d = graph.nodes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    columns = ["task", "side", "id", "payload", "nbrs"]
    rows = q.select(F.xxhash64("shard", "block").alias("task"), F.lit(0).alias("side"), "id", "payload",
                    F.lit(None).cast("array<long>").alias("nbrs")).unionByName(
        d.select(F.xxhash64("shard", "block").alias("task"), F.lit(1).alias("side"), "id", "payload", "nbrs"))

    def run(batches):
        for b in _grouped(batches):
            cuts, side = _starts(b.column(0).to_numpy()), b.column(1).to_numpy()
            for lo, hi in zip(cuts, cuts[1:]):
                n = int((side[lo:hi] == 0).sum())
                if not n or n == hi - lo:
                    continue
                asked, raw = b.column(2)[lo:lo + n].to_numpy(), b.column(3)[lo:lo + n].to_pylist()
                ids = b.column(2)[lo + n:hi].to_numpy()
                x = _vectors(b.column(3)[lo + n:hi].to_pylist(), kind)
                near = _adjacency(ids, b.column(4)[lo + n:hi].to_pylist(), graph_degree)
                for at in range(0, n, WALKERS):
                    score, place = walk(_vectors(raw[at:at + WALKERS], q_kind), x, near, min(ef, len(ids)))
                    score, order = _select(score, place, k)
                    place = np.take_along_axis(place, order, axis=1)
                    ok = (place >= 0).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(asked[at:at + WALKERS], score.shape[1])[ok]), pa.array(ids[place.ravel()[ok]]),
                         pa.array(score.ravel()[ok])], names=["query_id", "node", "score"])
    graph_degree = graph.degree
    found = rows.select(*columns).repartition("task").sortWithinPartitions("task", "side", "id").mapInArrow(
        run, "query_id long, node long, score double")
    # of a node's documents only the k smallest ids can be among a query's k
    turn = Window.partitionBy("node").orderBy("doc_id")
    few = graph.members.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= k).drop("r")
    return _best(found.join(few, "node").select("query_id", "doc_id", "score"), k) \
        .select("query_id", "doc_id", "score", "rank")
