"""MinHash near-dedup by a chosen-path set similarity join.

Documents become sets of hashed shingles, equal sets become one vertex, and
every vertex keeps ``COORDINATES`` minwise tokens.  Several independent trees
branch the vertices: a node chooses a few token positions (a function of the
node's path alone, so every document knows them), and a document goes to one
child for each chosen position, named by the path and the document's token
there.  Two sets of similarity s share a token with probability s, so with
``branches * s > 1`` a similar pair survives any depth with a probability
that a tree fixes and ``trees`` repeat towards 1.

* Nodes of up to ``leaf`` documents (beside their largest group of copies)
  are compared exhaustively by their minwise tokens; larger ones branch again.  A node answers with a spanning
  forest of its candidates, so a group of copies gives about as many rows as
  it has members, and nodes whose documents are already joined are left out.
* The candidates' components - clusters - hold every pair that may link.
  Inside a cluster all pairs are then decided on the full shingle sets, again
  with a spanning forest as the answer.
"""

from __future__ import annotations

from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import join_small

from .common import stage
from .graph import connected_components, min_roots
from .substring import window_hashes
from .words import WordHashes, mix64

COORDINATES = 128
#: Most pairs at the threshold that the comparison of tokens may lose, and
#: that all trees together may miss.
LOST, MISSED = 2e-7, 6e-7


def agreeing(percent: int) -> int:
    """Tokens that must agree for a pair to be confirmed: at ``percent`` a
    pair has fewer at most ``LOST`` times (70 at 75, where 96 agree on
    average)."""
    s, below, k = percent / 100, 0.0, 0
    while True:
        below += comb(COORDINATES, k) * s ** k * (1 - s) ** (COORDINATES - k)
        if below > LOST:
            return k
        k += 1


def missed(percent: int, trees: int, branches: int, depth: int) -> float:
    """The share of pairs at ``percent`` that all trees miss: all of them
    read the same tokens, so it is a mean over how many of those agree."""
    s, out = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        one = 0.0
        for _ in range(depth):  # a node misses if its agreeing children do
            one = sum(comb(k, j) * comb(COORDINATES - k, branches - j) / comb(COORDINATES, branches) * one ** j
                      for j in range(branches + 1))
        out += comb(COORDINATES, k) * s ** k * (1 - s) ** (COORDINATES - k) * one ** trees
    return out


def forest_size(percent: int, trees: int, branches: int, depth: int) -> tuple[int, int]:
    """(trees, branches) that miss at most ``MISSED`` pairs at ``percent``,
    no fewer than asked for; lower similarities take more of both."""
    if not 20 <= percent <= 100:
        raise ValueError("percent must be between 20 and 100")
    branches = max(branches, ceil(225 / percent))
    while missed(percent, trees, branches, depth) > MISSED:
        trees += 1
    return trees, branches


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all ``width``-word shingles; fewer words
    form one shingle, no words none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < width:
        return mix64(window_hashes(words, n) ^ np.uint64(n))
    return np.unique(window_hashes(words, width))


def minwise_tokens(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For every factor the smallest product with a shingle, as 32 bits."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[k:k + 1024, None] * factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _factors(seed: int) -> np.ndarray:
    return mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


_SKETCH = "row long, doc_id long, text_hash long, n_shingles long, set_hash binary, tokens binary"


def _sketch(width: int, seed: int):
    def run(batches):
        hashes, factors = WordHashes(), _factors(seed)
        for batch in batches:
            n, names, tokens = [], [], []
            for text in batch.column(3):
                s = shingle_set(hashes.of((text.as_py() or b"").lower().split()), width)
                n.append(len(s))
                names.append(xxhash.xxh3_128_digest(s.tobytes()))
                tokens.append(minwise_tokens(s, factors).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(tokens, pa.binary())],
                names=["row", "doc_id", "text_hash", "n_shingles", "set_hash", "tokens"])
    return run


def _matrix(column, dtype, width) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _children(branches: int, trees: int):
    """Rows (node, vertex, tokens) to the rows of the node's children; node
    null stands for the roots of all trees."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vertex = batch.column(1).to_numpy()
            tokens = _matrix(batch.column(2), "<u4", COORDINATES)
            if batch.column(0).null_count:
                paths = [np.full(len(vertex), t + 1, np.uint64) for t in range(trees)]
            else:
                paths = [batch.column(0).to_numpy().view(np.uint64)]
            rows = np.arange(len(vertex))
            for path in paths:
                for k in range(branches):
                    # the k-th of the node's positions; distinct for all k
                    start = mix64(path ^ np.uint64(0x5851F42D4C957F2D))
                    at = ((start + np.uint64(k) * (start >> np.uint64(8) | np.uint64(1)))
                          % np.uint64(COORDINATES)).astype(np.int64)
                    node = mix64(mix64(path + np.uint64(k + 1)) ^ (at.astype(np.uint64) << np.uint64(32))
                                 ^ tokens[rows, at].astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(vertex)],
                                                     names=["node", "vertex"])
    return run


def _close(short, n, i, j, percent: int, agree: int) -> np.ndarray:
    """Which of the pairs may reach the similarity: by set sizes, then by the
    low bytes of their minwise tokens."""
    ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    ok[ok] = np.count_nonzero(short[i[ok]] == short[j[ok]], axis=1) >= agree
    return ok


def _pairs(vertex, i, j):
    a, b = np.minimum(vertex[i], vertex[j]), np.maximum(vertex[i], vertex[j])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _neighbours(percent: int, agree: int):
    """Candidates among neighbouring rows of one node; the rows are sorted."""
    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if batch.num_rows < 2:
                held = batch
                continue
            node, vertex, n = (batch.column(k).to_numpy() for k in range(3))
            short = _matrix(batch.column(3), np.uint8, COORDINATES)
            i = np.flatnonzero((node[1:] == node[:-1]) & (vertex[1:] != vertex[:-1]))
            i = i[_close(short, n, i, i + 1, percent, agree)]
            yield _pairs(vertex, i, i + 1)
            held = batch.slice(batch.num_rows - 1)
    return run


def _leaves(percent: int, agree: int, block: int = 1 << 15):
    """A forest of the candidates inside each cell (sorted rows of one node,
    a few thousand at most): compares row k with row k+1, k+2, ...; rows that
    are joined already, by ``comp`` or by a pair found before, are skipped."""
    def compare(batch):
        node, vertex, n, comp = (batch.column(k).to_numpy() for k in (0, 1, 2, 4))
        short = _matrix(batch.column(3), np.uint8, COORDINATES)
        label = np.unique(comp, return_inverse=True)[1]
        first = np.ones(len(node), bool)
        first[1:] = node[1:] != node[:-1]
        start = np.flatnonzero(first)
        left = np.repeat(np.append(start[1:], len(node)), np.diff(np.append(start, len(node)))) \
            - np.arange(len(node))  # rows from this one to the end of its cell
        i = np.arange(len(node))
        for step in range(1, int(left.max(initial=1))):
            i = i[left[i] > step]
            for k in range(0, len(i), 1 << 16):
                x = i[k:k + (1 << 16)]
                x = x[label[x] != label[x + step]]
                x = x[_close(short, n, x, x + step, percent, agree)]
                if not len(x):
                    continue
                lo, hi = np.minimum(label[x], label[x + step]), np.maximum(label[x], label[x + step])
                _, once = np.unique(lo * len(label) + hi, return_index=True)
                x, lo, hi = x[once], lo[once], hi[once]
                ids, roots = min_roots(lo, hi)
                to = np.arange(len(label))
                to[ids] = roots
                label = to[label]
                yield _pairs(vertex, x, x + step)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                whole = pa.concat_batches(held)
                node = whole.column(0).to_numpy()
                cut = int(np.searchsorted(node, node[-1]))  # the last cell may go on
                yield from compare(whole.slice(0, cut))
                held, rows = [whole.slice(cut)], whole.num_rows - cut
        if rows:
            yield from compare(pa.concat_batches(held))
    return run


def _sets(width: int):
    """Rows (cell, vertex, label, set_hash, text) to (cell, vertex, label,
    shingles); texts of another set under the same key fall out, and so does
    what a task has seen: a text that many rows repeat is formed once."""
    def run(batches):
        hashes, seen = WordHashes(), set()
        for batch in batches:
            sets = []
            for cell, vertex, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                batch.column(3).to_pylist(), batch.column(4)):
                if (cell, vertex) in seen:
                    sets.append(None)
                    continue
                seen.add((cell, vertex))
                s = shingle_set(hashes.of((text.as_py() or b"").lower().split()), width).tobytes()
                sets.append(s if xxhash.xxh3_128_digest(s) == name else None)
            sets = pa.array(sets, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], names=["cell", "vertex", "label", "shingles"]) \
                .filter(sets.is_valid())
    return run


def exact_links(sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets`` beyond what ``label``
    joins already.  One row at a time is counted against all others through
    the shingles' holders; rows of the component that is largest so far wait,
    since any pair it is in is met from the other side."""
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    holder = owner[order]
    first = np.ones(len(flat), bool)
    first[1:] = flat[order][1:] != flat[order][:-1]
    run = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(flat)))
    of = np.empty(len(flat), np.int64)
    of[order] = run
    ends = np.cumsum(n)
    label = np.unique(label, return_inverse=True)[1]
    open_ = np.ones(len(sets), bool)
    found = []
    while True:
        size = np.bincount(label)
        wait = np.flatnonzero(open_ & (label != size.argmax()))
        if not len(wait):
            return found
        x = int(wait[0])
        open_[x] = False
        runs = of[ends[x] - n[x]:ends[x]]
        reps = length[runs]
        at = np.repeat(start[runs] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
        common = np.bincount(holder[at], minlength=len(sets))
        linked = np.flatnonzero((100 * common >= percent * (n[x] + n - common)) & (label != label[x]))
        for y in linked:
            if label[y] != label[x]:
                found.append((x, int(y)))
                label[label == label[y]] = label[x]


def _decide(percent: int):
    """Links inside each cell (sorted rows cell, vertex, label, shingles)."""
    def done(rows):
        rows = list({r["vertex"]: r for r in rows}.values())  # tasks may repeat a vertex
        sets = [np.frombuffer(r["shingles"], "<u8") for r in rows]
        found = exact_links(sets, np.array([r["label"] for r in rows]), percent)
        vertex = [r["vertex"] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([vertex[i] for i, _ in found], pa.int64()),
                                           pa.array([vertex[j] for _, j in found], pa.int64())], names=["a", "b"])

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


def _links(placed: DataFrame, vertices: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links inside cells; ``placed`` has (cell, vertex, label).  Sets are
    formed anew from the texts of the documents that are in a cell."""
    wanted = stage(placed.join(vertices.select("vertex", "key", "text_hash", "set_hash"), "vertex"), "wanted")
    sets = join_small(texts, wanted, ["key", "text_hash"], max_rows=1_000_000).select("cell", "vertex", "label", "set_hash", "text") \
        .mapInArrow(_sets(width), "cell long, vertex long, label long, shingles binary")
    return sets.repartition("cell").sortWithinPartitions("cell").mapInArrow(_decide(percent), "a long, b long")


def _confirmed(clusters: DataFrame, vertices: DataFrame, texts: DataFrame, width: int, percent: int,
               room: int) -> DataFrame:
    """All links inside the clusters (vertex, cluster), up to what keeps
    their components, decided on full sets in cells of about ``room``
    shingles.

    A cluster that fits is one cell.  A larger one is dealt into cells twice
    at random, which joins groups of copies of any size; then every part of
    it that is still apart is compared with every other: components too large
    for a cell are cut into blocks of their own, small ones are put together,
    and a cell is a pair of blocks, except two blocks of one component."""
    sized = clusters.join(vertices.select("vertex", "n"), "vertex")
    weights = sized.groupBy("cluster").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("members")) \
        .filter("members > 1")
    sized = stage(sized.join(weights, "cluster"), "clusters")
    own = F.col("vertex").alias("label")
    small = sized.filter(F.col("weight") <= room).select(F.col("cluster").alias("cell"), "vertex", own)
    links = _links(small, vertices, texts, width, percent)
    large = sized.filter(F.col("weight") > room)
    if large.isEmpty():
        return links
    parts = F.ceil(F.col("weight") / room).cast("long")
    dealt = large.withColumn("deal", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.xxhash64("cluster", "deal", F.pmod(F.xxhash64("vertex", "deal"), parts)).alias("cell"), "vertex", own)
    first = stage(_links(dealt, vertices, texts, width, percent), "dealt")
    comps = connected_components(first)
    left = large.join(comps, "vertex", "left").withColumn("comp", F.coalesce("comp", "vertex"))
    apart = left.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    left = stage(left.join(apart.select("cluster"), "cluster").select("cluster", "vertex", "comp", "n"), "apart")
    if left.isEmpty():
        return links.union(first)
    half = room // 2
    by_comp = left.groupBy("cluster", "comp").agg(F.sum("n").alias("comp_weight"))
    rest = by_comp.filter(F.col("comp_weight") <= half).groupBy("cluster").agg(F.sum("comp_weight").alias("rest"))
    cut = by_comp.join(rest, "cluster", "left").withColumn("whole", F.col("comp_weight") > half).select(
        "cluster", "comp", "whole",
        F.ceil(F.when(F.col("whole"), F.col("comp_weight")).otherwise(F.col("rest")) / half).cast("long").alias("cuts"))
    blocked = left.join(cut, ["cluster", "comp"]).select(
        "cluster", "vertex", F.col("comp").alias("label"),
        F.when(F.col("whole"), F.col("comp")).alias("pure"),
        F.when(F.col("whole"), F.xxhash64("comp", F.pmod(F.xxhash64("vertex"), F.col("cuts"))))
        .otherwise(F.xxhash64("cluster", F.pmod(F.xxhash64("comp"), F.col("cuts")))).alias("block"))
    blocked = stage(blocked, "blocked")
    blocks = blocked.select("cluster", "block", "pure").distinct()
    other = blocks.select("cluster", F.col("block").alias("block2"), F.col("pure").alias("pure2"))
    cells = blocks.join(other, "cluster").filter("block <= block2 and not coalesce(pure = pure2, false)") \
        .select("block", "block2", F.xxhash64("block", "block2").alias("cell"))
    seats = cells.select("cell", "block").union(cells.select("cell", F.col("block2").alias("block"))).distinct()
    across = _links(blocked.join(seats, "block").select("cell", "vertex", "label"), vertices, texts, width, percent)
    return links.union(first).union(across)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, trees: int = 4, branches: int = 3,
                    leaf: int = 1024, depth: int = 4, room: int = 1 << 20, seed: int = 1,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Texts are lower-cased (A-Z) and cut into words; two documents link when
    ``100 * common >= percent * union`` of their distinct ``width``-word
    shingles, and ``component_id`` is the smallest ``doc_id`` that links
    reach.  Found links are exact; a pair at 0.75 is missed by all ``trees``
    trees about 5 times in ten million at ``depth`` levels (2 at one level):
    the mean over the share of the 128 tokens that agree, since all trees read
    the same tokens.  The token comparison misses another 2 in ten million.
    Other thresholds keep these rates: below 75 there are more branches and
    trees than asked for, and fewer tokens need to agree.

    * Null texts and texts without words have no shingles and link with
      nothing; fewer than ``width`` words form one shingle.
    * Documents with equal sets (repeated rows too) are one vertex.
    * A null ``doc_id`` takes part in links; it has the component's smallest
      id, or null where no member has one, and ``kept`` is false except there.
    * An empty table gives an empty result; other columns are ignored.

    Nodes whose rows beside the main component still exceed ``leaf`` after
    ``depth`` levels are compared in pairs of blocks, so no pair is dropped.
    """
    rows, comps, vertices = _components(docs, width, percent, trees, branches, leaf, depth, room, seed, id_col, text_col)
    placed = vertices.select("set_hash", "vertex", "first_id").join(comps, "vertex", "left")
    first = placed.filter("comp is not null").groupBy("comp").agg(F.min("first_id").alias("comp_id"))
    named = placed.join(first, "comp", "left").select(
        "set_hash", F.when(F.col("comp").isNull(), F.col("first_id")).otherwise(F.col("comp_id")).alias("component"))
    empty = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_hash").join(named, "set_hash") \
        .select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components(docs, width, percent, trees, branches, leaf, depth, room, seed, id_col, text_col):
    """(sketches, comps, vertices): the documents' rows with their sets'
    hashes, the components of vertices that link, and the vertices."""
    trees, branches = forest_size(percent, trees, branches, depth)
    agree = agreeing(percent)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("key"),
                        F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    sketches = stage(docs.select(F.monotonically_increasing_id().alias("row"),
                                 F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                                 F.col(text_col).cast("binary").alias("text"))
                     .mapInArrow(_sketch(width, seed), _SKETCH), "sketches")
    vertices = stage(sketches.filter("n_shingles > 0").groupBy("set_hash").agg(
        F.min("row").alias("vertex"), F.min("doc_id").alias("first_id"),
        F.min_by(F.coalesce("doc_id", F.lit(-1)), "row").alias("key"), F.min_by("text_hash", "row").alias("text_hash"),
        F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens")), "vertices")
    # the low byte of every token serves for comparing
    short = vertices.select("vertex", "n", "tokens").mapInArrow(_low_bytes, "vertex long, n long, short binary")

    def members(children):
        """Rows of nodes with two vertices or more, with the node's size."""
        sizes = children.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        return children.join(sizes, "node")

    def grown(parents):
        return parents.mapInArrow(_children(branches, trees), "node long, vertex long").distinct()

    roots = vertices.select(F.lit(None).cast("long").alias("node"), "vertex", "tokens")
    level = stage(members(grown(roots)), "level")
    chained = stage(level.join(short, "vertex").select("node", "vertex", "n", "short")
                    .repartitionByRange("node", "vertex").sortWithinPartitions("node", "vertex")
                    .mapInArrow(_neighbours(percent, agree), "a long, b long").distinct(), "chained")
    joined = stage(connected_components(chained), "joined")

    found = chained
    for d in range(1, depth + 1):
        known = level.join(joined, "vertex", "left").withColumn("comp", F.coalesce("comp", "vertex"))
        made_of = known.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(
            F.count(F.lit(1)).alias("comps"), F.max_by("comp", "n").alias("main"), F.max("n").alias("main_size"))
        known = stage(known.join(made_of.filter("comps > 1").drop("comps"), "node"), "mixed")
        # rows beside the node's largest component decide: few of them are
        # compared with that component block by block, many branch again
        few = F.col("size") - F.col("main_size") <= leaf
        cells = known if d == depth else known.filter(few)
        found = found.union(stage(_cells(cells, short, leaf).mapInArrow(_leaves(percent, agree), "a long, b long")
                                  .distinct(), "found"))
        large = known.filter(~few)
        if d == depth or large.isEmpty():
            break
        level = stage(members(grown(large.select("node", "vertex").join(vertices, "vertex")
                                    .select("node", "vertex", "tokens"))), "level")
    clusters = connected_components(found.distinct()).withColumnRenamed("comp", "cluster")
    comps = stage(connected_components(_confirmed(clusters, vertices, texts, width, percent, room)), "comps")
    return sketches, comps, vertices


def _cells(known: DataFrame, short: DataFrame, leaf: int) -> DataFrame:
    """Rows dealt into cells that are compared exhaustively.  The rows of a
    node's main component are dealt into blocks and each block is one cell
    with all of the node's other rows.  Other rows beyond ``leaf`` are dealt
    into blocks too, and a cell is then one pair of blocks."""
    main = F.col("comp") == F.col("main")
    blocks = known.withColumn("blocks", F.ceil(F.col("main_size") / leaf).cast("int")) \
        .withColumn("others", F.ceil((F.col("size") - F.col("main_size")) / leaf).cast("int"))
    few, many = blocks.filter("others = 1"), blocks.filter("others > 1")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = few.filter(main).withColumn("block", F.pmod(F.xxhash64("vertex", "node"), F.col("blocks")).cast("int")) \
        .unionByName(few.filter(~main).withColumn("block", every))
    # many others: blocks of main (0, 1, ...) and of others (-1, -2, ...); a
    # cell is a pair of blocks that are not both of the main component
    own = F.when(main, F.pmod(F.xxhash64("vertex", "node"), F.col("blocks"))) \
        .otherwise(-1 - F.pmod(F.xxhash64("vertex", "node"), F.col("others"))).cast("int")
    with_others = F.sequence(-F.col("others"), F.lit(-1))
    partner = F.explode(F.when(F.col("own") >= 0, with_others)
                        .otherwise(F.concat(with_others, F.sequence(F.lit(0), F.col("blocks") - 1))))
    pairs = many.withColumn("own", own).withColumn("partner", partner).withColumn(
        "block", F.xxhash64(F.least("own", "partner"), F.greatest("own", "partner")))
    cell = F.xxhash64("node", "block").alias("node")
    rows = dealt.select(cell, "vertex", "comp").union(pairs.select(cell, "vertex", "comp"))
    return (rows.join(short, "vertex").select("node", "vertex", "n", "short", "comp")
            .repartition("node").sortWithinPartitions("node"))


def _low_bytes(batches):
    for batch in batches:
        low = [t.as_buffer().to_pybytes()[::4] for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low, pa.binary())],
                                         names=["vertex", "n", "short"])


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 75, trees: int = 4, branches: int = 3,
                         leaf: int = 1024, depth: int = 4, room: int = 1 << 20, seed: int = 1,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component (see :func:`near_duplicates`), all
    columns as they are: the row with the smallest id - ids before no id - and
    of several such rows one with the text that is met first.  Which rows go
    is told by id and text, so a clean text under the id of a copy stays.
    Rows without shingles all stay."""
    rows, comps, vertices = _components(docs, width, percent, trees, branches, leaf, depth, room, seed, id_col, text_col)
    of = vertices.select("set_hash", "vertex").join(comps, "vertex", "left") \
        .select("set_hash", F.coalesce("comp", "vertex").alias("comp"))
    rows = stage(rows.filter("n_shingles > 0").select("row", "doc_id", "text_hash", "set_hash").join(of, "set_hash")
                 .select("comp", "row", "doc_id", "text_hash"), "represented")
    best = rows.groupBy("comp").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_hash")).alias("best"))
    judged = rows.join(best, "comp").withColumn(
        "stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    named = judged.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
    named = stage(named.filter("not stays or times > 1"), "judged")
    hashed = docs.withColumn("__hash", F.xxhash64(text_col))
    here = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (hashed["__hash"] == named["__hash"])
    kept = hashed.join(named, here, "left_anti").select(*docs.columns)
    again = named.filter("stays")
    if again.isEmpty():
        return kept
    repeated = hashed.join(again, here, "left_semi").dropDuplicates([id_col, "__hash"]).select(*docs.columns)
    return kept.unionByName(repeated)
