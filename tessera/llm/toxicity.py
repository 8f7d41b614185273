"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their beginnings, hashed into
a fixed space.  The model adds a weight for each term and, for every pair of
terms, the product of their factor vectors, so that a pair such as an insult
and the mention of a group can weigh more than both alone.

Labelled rows are dealt into a fixed number of shards; in a round every shard
runs one pass of adaptive gradient steps over its rows from the common model,
and the models are averaged.  Which shard a row is in, the order of the steps
and the order of the sums follow from hashes of the rows, so that every run
gives the same model, whatever the files, tasks and cores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import join_small

from .common import bucketed

BITS = 18
BEGINNINGS = (4, 5, 6)
_TRIM = b".,;:!?\"'()[]{}<>*#%&$|-_/\\"


class Terms:
    """Term numbers of texts.  The words met first are remembered: by the
    Zipf law those are the ones that come back."""

    REMEMBER = 300_000

    def __init__(self):
        self.known: dict[bytes, tuple[int, ...]] = {}

    def terms(self, word: bytes) -> tuple[int, ...]:
        bare = word.strip(_TRIM).lower()
        if bare.isascii():
            parts = [bare] + [bare[:n] + b"-" for n in BEGINNINGS if len(bare) > n]
        else:
            text = bare.decode("utf-8", "replace").lower()
            parts = [text.encode()] + [(text[:n] + "-").encode() for n in BEGINNINGS if len(text) > n]
        return tuple([xxhash.xxh32_intdigest(p) >> (32 - BITS) for p in parts]) if bare else ()

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct term numbers of a text."""
        words = list(set((text or b"").split()))
        found = set()
        for word, terms in zip(words, map(self.known.get, words)):
            if terms is None:
                terms = self.terms(word)
                if len(self.known) < self.REMEMBER:
                    self.known[word] = terms
            if terms:
                found.update(terms)
        out = np.fromiter(found, np.int32, len(found))
        out.sort()
        return out


@dataclass
class Model:
    """A weight and a row of factors for each of the 2^BITS hashed terms;
    ``scale`` is the value of a term in every document that has it."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    scale: np.ndarray

    def logits(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` documents; ``at[k]`` is a term of document
        ``rows[k]`` (ascending)."""
        return self._forward(rows, at, n)[0]

    def _forward(self, rows, at, n):
        x = self.scale[at]
        # the pairs of a document have a common weight, however many they are
        pairs = x / np.sqrt(np.maximum(np.bincount(rows, x * x, n), 1e-12))[rows]
        v = self.factors[at] * pairs[:, None]
        sums = np.stack([np.bincount(rows, v[:, f], n) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(rows, (v * v).sum(axis=1), n)
        linear = np.bincount(rows, self.weights[at] * x, n)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), v, sums, x, pairs

    def score(self, terms: list[np.ndarray]) -> np.ndarray:
        rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        at = np.concatenate(terms) if terms else np.empty(0, np.int32)
        return 1 / (1 + np.exp(-np.clip(self.logits(rows, at, len(terms)), -40, 40)))


def evidence(positive: np.ndarray, total: np.ndarray, n_positive: int, n: int,
             least: float = 0.05, chance: float = 9.0) -> np.ndarray:
    """Values of the terms, from ``least`` to 1, by the likelihood ratio G of
    their rate of positives against the rate of all rows.  No term is left
    out: one that tells nothing alone (G up to ``chance``) still has the value
    ``least``, and a value depends on the term's own counts only."""
    rate = n_positive / max(n, 1)
    own = positive / np.maximum(total, 1)
    negative = total - positive
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(positive > 0, positive * np.log(own / rate), 0)
                 + np.where(negative > 0, negative * np.log((1 - own) / (1 - rate)), 0))
    return least + (1 - least) * (1 - chance / np.maximum(g, chance))


def one_pass(model: Model, state: list[np.ndarray], seen: np.ndarray, docs: list[np.ndarray], y: np.ndarray,
             rate: float, decay: float, batch: int = 32) -> None:
    """Adaptive gradient steps over ``docs`` (their terms) in the given order;
    changes ``model``, ``state`` (sums of squared gradients) and ``seen`` (the
    documents met of each term)."""
    mark, short = np.zeros(len(model.weights), bool), np.empty(len(model.weights), np.int32)
    for lo in range(0, len(docs), batch):
        part, label = docs[lo:lo + batch], y[lo:lo + batch]
        rows = np.repeat(np.arange(len(part)), [len(p) for p in part])
        at = np.concatenate(part)
        logit, v, sums, x, pairs = model._forward(rows, at, len(part))
        mark[at] = True
        used = np.flatnonzero(mark)
        mark[used] = False
        short[used] = np.arange(len(used))
        at, size = short[at], len(used)
        seen[used] += np.bincount(at, minlength=size)
        error = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label
        state[2] += float((error.sum() / len(part)) ** 2)
        model.bias -= rate * error.sum() / len(part) / float(np.sqrt(state[2][0]) + 1e-6)
        gw = np.bincount(at, error[rows] * x, size) + decay * model.weights[used]
        state[0][used] += gw * gw
        model.weights[used] -= rate * gw / (np.sqrt(state[0][used]) + 1e-6)
        g = error[rows] * pairs
        gv = np.stack([np.bincount(at, g * (sums[rows, f] - v[:, f]), size) for f in range(v.shape[1])], axis=1)
        gv += decay * model.factors[used]
        state[1][used] += gv * gv
        model.factors[used] -= 0.3 * rate * gv / (np.sqrt(state[1][used]) + 1e-6)


def bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the
    empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def _terms(batches):
    terms = Terms()
    for batch in batches:
        found = [terms.of(t.as_py()).astype("<i4").tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())],
                                         names=["deal", "label", "terms"])


#: A count table travels in this many pieces.
SLICES = 16
_COUNTS = "slice int, n long, n_positive long, counts binary"


def _counted(piece, n, n_positive, counts):
    return pa.RecordBatch.from_arrays(
        [pa.array([piece], pa.int32()), pa.array([n], pa.int64()), pa.array([n_positive], pa.int64()),
         pa.array([counts.tobytes()], pa.binary())], names=["slice", "n", "n_positive", "counts"])


def _count(batches):
    """How many documents, and positive ones, hold each term."""
    both, rows = np.zeros((1 << BITS, 2), np.int64), [0, 0]
    for batch in batches:
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = np.frombuffer(t, "<i4")
            both[at, 0] += 1
            rows[0] += 1
            if y:
                both[at, 1] += 1
                rows[1] += 1
    if rows[0]:
        for k, part in enumerate(np.split(both, SLICES)):
            yield _counted(k, *(rows if k == 0 else (0, 0)), part)


def _add(batches):
    """Sums the tables of each slice (sorted rows)."""
    last, total = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if last is not None and r["slice"] != last:
                yield _counted(last, *total)
                total = None
            last = r["slice"]
            own = [r["n"], r["n_positive"], np.frombuffer(r["counts"], np.int64)]
            total = own if total is None else [x + y for x, y in zip(total, own)]
    if total is not None:
        yield _counted(last, *total)


_ROUND = "slice int, shard int, n long, bias double, bias_state double, met binary, model binary"


def _learnt(piece, shard, n, bias, bias_state, met, table):
    return pa.RecordBatch.from_arrays(
        [pa.array([piece], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([bias]),
         pa.array([bias_state]), pa.array([met.astype("<i4").tobytes()]), pa.array([table.astype("<f4").tobytes()])],
        names=["slice", "shard", "n", "bias", "bias_state", "met", "model"])


def _round(shared, index: int, factors: int, rate: float, decay: float):
    """One pass over a shard in an order of the round's own, from the common
    model.  Answers, for each slice of the terms, those met: their documents,
    weights, factors and states."""
    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        # rows of one deal are alike, so this is one order of the rows
        order = np.argsort(rows.column("deal").to_numpy(), kind="stable")
        order = order[np.random.default_rng((index, shard)).permutation(len(order))]
        labels = rows.column("label").to_numpy().astype(float)[order]
        terms = rows.column("terms").to_pylist()
        scale, bias, bias_state, table = shared.value
        table = table.astype(float)
        weights, factor, s0, s1 = (np.ascontiguousarray(x) for x in np.split(table, [1, 1 + factors, 2 + factors], axis=1))
        own, sums = Model(bias, weights[:, 0], factor, scale), [s0[:, 0], s1, np.full(1, bias_state)]
        seen = np.zeros(len(weights), np.int64)
        one_pass(own, sums, seen, [np.frombuffer(terms[o], "<i4") for o in order], labels, rate, decay)
        width, out = len(seen) // SLICES, []
        for k in range(SLICES):
            met = np.flatnonzero(seen[k * width:(k + 1) * width])
            at = met + k * width
            out.append(_learnt(k, shard, len(terms), own.bias, float(sums[2][0]), met,
                               np.column_stack([seen[at], own.weights[at], own.factors[at], sums[0][at], sums[1][at]])))
        return pa.Table.from_batches(out)
    return run


def _means(factors: int):
    """Means over the shards of each slice (sorted rows): a term's by its
    documents in the shard, the bias by the shard's rows."""
    def run(batches):
        last, held = None, None

        def done():
            n, bias, bias_state, table = held
            met = np.flatnonzero(table[:, 0])
            return _learnt(last, 0, n, bias / n, bias_state / n, met, table[met, 1:] / table[met, :1])
        for batch in batches:
            for r in batch.to_pylist():
                if last != r["slice"]:
                    if held is not None:
                        yield done()
                    last, held = r["slice"], [0, 0.0, 0.0, np.zeros(((1 << BITS) // SLICES, 3 + 2 * factors))]
                met = np.frombuffer(r["met"], "<i4")
                own = np.frombuffer(r["model"], "<f4").reshape(len(met), 3 + 2 * factors).astype(float)
                own[:, 1:] *= own[:, :1]
                held[3][met] += own
                held[0] += r["n"]
                held[1] += r["n"] * r["bias"]
                held[2] += r["n"] * r["bias_state"]
        if held is not None:
            yield done()
    return run


#: Shards that rows are dealt into, and buckets that keep them apart on disk.
SHARDS, BUCKETS = 12, 48


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", factors: int = 4,
        rounds: int = 4, steps: int = 200, rate: float = 0.1, decay: float = 1e-4, seed: int = 0,
        max_rows: int = 600_000) -> Model:
    """Fits weights and factors of all 2^BITS terms on the rows of
    ``labelled``; rows without a label are left out.  Without a positive row
    the model scores every text 0.  Terms that no row has stay at 0.

    Beyond ``max_rows`` labelled rows the model is fitted on about so many of
    them, chosen by a hash of text and label, which bounds a shard (a
    twelfth) in its task.  Few rows make fewer shards and more rounds, so
    that every shard makes some ``steps`` steps in all.  A term's mean over
    the shards counts each shard by its documents with that term, so a term
    that one shard alone has keeps all it learnt.  The means are formed slice
    by slice in tasks: the driver sees one count table of 2^BITS terms and
    one model with its state a round (10 MB), whatever the number of rows.
    """
    rows = labelled.filter(F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("int").alias("label"), F.col(text_col).cast("binary").alias("text"))
    found = rows.count()
    rows = rows.select(F.xxhash64("text", "label").alias("deal"), "label", "text")
    if found > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("deal"), F.lit(1 << 30)) < int(max_rows / found * (1 << 30)))
    # dealt once; a round reads the shards where they lie
    rows = bucketed(rows.mapInArrow(_terms, "deal long, label int, terms binary")
                    .withColumn("shard", F.pmod("deal", F.lit(SHARDS)).cast("int")).repartition(BUCKETS, "shard"),
                    "shard", BUCKETS, "terms")
    counts = rows.select("label", "terms").mapInArrow(_count, _COUNTS).repartition(SLICES, "slice").sortWithinPartitions("slice") \
        .mapInArrow(_add, _COUNTS).collect()
    total = np.zeros((1 << BITS, 2), np.int64)
    for c in counts:
        width = (1 << BITS) // SLICES
        total[c["slice"] * width:(c["slice"] + 1) * width] = np.frombuffer(c["counts"], np.int64).reshape(-1, 2)
    total = total.T
    n, n_positive = sum(c["n"] for c in counts), sum(c["n_positive"] for c in counts)
    size = 1 << BITS
    base = float(np.log((n_positive + 0.5) / (n - n_positive + 0.5))) if n_positive else -40.0
    if not n_positive:
        return Model(base, np.zeros(size), np.zeros((size, factors)), np.ones(size))
    # a row of a term: weight, factors and the sums of their squared gradients
    table = np.full((size, 2 + 2 * factors), 1e-2, np.float32)
    table[:, 0] = 0
    table[:, 1:1 + factors] = np.random.default_rng(seed).normal(0, 0.01, (size, factors))
    table[total[0] == 0, 1:1 + factors] = 0
    scale, bias, bias_state = evidence(total[1], total[0], n_positive, n), base, 1e-2
    shards = min(SHARDS, n // 1000 + 1)
    rounds = max(rounds, min(30, -(-steps * 32 * shards // max(n, 1))))
    dealt = rows if shards == SHARDS else rows.withColumn("shard", F.col("shard") % shards)
    for index in range(rounds):
        shared = labelled.sparkSession.sparkContext.broadcast((scale, bias, bias_state, table))
        got = dealt.groupBy("shard").applyInArrow(_round(shared, index, factors, rate, decay), _ROUND) \
            .repartition(SLICES, "slice").sortWithinPartitions("slice", "shard") \
            .mapInArrow(_means(factors), _ROUND).collect()
        shared.destroy()
        bias, bias_state = got[0]["bias"], got[0]["bias_state"]
        for g in got:
            met = np.frombuffer(g["met"], "<i4")
            table[g["slice"] * (size // SLICES) + met] = np.frombuffer(g["model"], "<f4").reshape(len(met), 2 + 2 * factors)
    return Model(bias, table[:, 0].astype(float), table[:, 1:1 + factors].astype(float), scale)


def scores(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple = ("doc_id",),
           name: str = "score") -> DataFrame:
    """The ``keep`` columns of every row and its score as ``name``, in the order of
    the rows' partitions.  Null and empty texts have no terms and get the
    score of the bias.  The model - 2^BITS rows, 13 MB - is broadcast."""
    # plain arrays: a broadcast's classes would have to be installed on workers
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors, model.scale))
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches):
        own = Model(*shared.value)
        terms = Terms()
        for batch in batches:
            out = []
            texts = batch.column(batch.num_columns - 1)
            for lo in range(0, len(texts), 512):
                docs_ = [terms.of(t.as_py()) for t in texts[lo:lo + 512]]
                rows = np.repeat(np.arange(len(docs_)), [len(p) for p in docs_])
                at = np.concatenate(docs_)
                out.append(1 / (1 + np.exp(-np.clip(own.logits(rows, at, len(docs_)), -40, 40))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(out) if out else np.empty(0))],
                names=[f.name for f in schema])
    return docs.select(*keep, F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)


def fit_labels(docs: DataFrame, labels: DataFrame, label: str, train: Column, **kw) -> Model:
    """Fits on the rows of ``docs`` that ``labels`` marks and ``train`` (over
    ``labels``) admits.  A label for an unknown id is ignored."""
    known = labels.filter(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()) \
        .select("doc_id", F.col(label).cast("int").alias("label"))
    return fit(join_small(docs.select("doc_id", "text"), known, "doc_id"), **kw)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2,
             cut: float = 0.3, **kw) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Labels are learnt from rows whose :func:`bucket` is not ``held``; the
    text is the only input of a score.  Null ids are scored like others;
    repeated rows get one score each; an empty table gives an empty result.
    """
    model = fit_labels(docs, labels, label, bucket(F.col("doc_id"), modulus) != held, **kw)
    return scores(docs.select("doc_id", "text"), model).select(
        "doc_id", (bucket(F.col("doc_id"), modulus) == held).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"))
