"""Language-model scores of documents by an n-gram trie over the corpus.

The model is a bigram model with Dirichlet smoothing,

    p(w | v) = (c(v w) + strength * p(w)) / (c(v) + strength),
    p(w) = (c(w) + 1) / (N + V + 1),

over lower-cased words and one end token for each document; a text's first
token follows a start mark.  Counts come from the training documents, all of
them.

Texts are read once, in chunks of whole documents that become rows of packed
numbers and stay where they are written, bucketed by chunk.  A chunk's
distinct words meet those of the others in buckets of their hashes and learn
their counts and their numbers in the vocabulary; its distinct bigrams meet
the others' in the shard of their context, where the shard's trie is built,
kept as a blob, and asked at once for the chunk's bigrams.  Codes come back to
the chunk and are summed up for each document.  A bigram enters a shard once
for a chunk, however often it occurs, and the bigrams of a context that alone
would fill a shard are dealt over all shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, stage
from .packs import batch, distinct, gaps, pack, runs, unpack
from .toxicity import bucket
from .trie import ABSENT, STEP, NgramTrie, code, encode_trie, value
from .words import WordHashes, mix64

CHUNK_TOKENS = 2_000_000
#: Tokens of the corpus for one bucket of words and for one trie.
BUCKET_TOKENS, SHARD_TOKENS = 32_000_000, 3_000_000
#: No word is empty.
END = b""

_CHUNKS = pa.schema([("chunk", pa.int64()), ("n_tokens", pa.int64()), ("n_train", pa.int64()),
                     ("n_docs", pa.int64()), ("docs", pa.binary()), ("words", pa.binary()),
                     ("counts", pa.binary()), ("tokens", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _chunked(chunk_tokens: int):
    """Chunks of whole documents (id, in training?, text)."""
    def run(batches):
        from pyspark import TaskContext
        hashes = WordHashes()
        end = np.array([hashes[END]], np.uint64)
        part, n_chunks = TaskContext.get().partitionId(), 0
        ids, train, tokens, held = [], [], [], 0

        def flush():
            nonlocal n_chunks, ids, train, tokens, held
            lengths = np.array([len(t) for t in tokens], np.uint64)
            words, number = distinct(np.concatenate(tokens))
            learnt = np.repeat(np.array(train, bool), lengths.astype(np.int64))
            counts = np.bincount(number[learnt], minlength=len(words)).astype(np.uint64)
            missing = np.array([i is None for i in ids], np.uint8)
            docs = pack(np.array([i or 0 for i in ids], np.int64).view(np.uint64), missing, lengths,
                        np.array(train, np.uint8))
            row = ((part << 32) + n_chunks, held, int(learnt.sum()), int(np.sum(train)), docs, pack(gaps(words)),
                   pack(counts), pack(number.astype(np.uint32)))
            n_chunks += 1
            ids, train, tokens, held = [], [], [], 0
            return batch([row], _CHUNKS)

        for b in batches:
            for i, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own = np.concatenate((hashes.of((text.as_py() or b"").lower().split()), end))
                ids.append(i)
                train.append(bool(t))
                tokens.append(own)
                held += len(own)
                if held >= chunk_tokens:
                    yield flush()
        if ids:
            yield flush()
    return run


_SENT = pa.schema([("place", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])


def _send_words(buckets: int):
    """A chunk's words and counts, to the bucket of each hash's top bits."""
    def run(batches):
        for b in batches:
            for chunk, words, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                words, counts = np.cumsum(unpack(words.as_py())[0], dtype=np.uint64), unpack(counts.as_py())[0]
                at = (words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                cut = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
                rows = [(k, chunk, pack(gaps(words[cut[k]:cut[k + 1]]), counts[cut[k]:cut[k + 1]]))
                        for k in range(buckets) if cut[k + 1] > cut[k]]
                yield batch(rows, _SENT)
    return run


_TOTALS = pa.schema([("place", pa.int32()), ("chunk", pa.int64()), ("words", pa.int64()), ("known", pa.int64()),
                     ("payload", pa.binary())])


def _total_words(batches):
    """Per bucket: every chunk's words' numbers among the bucket's and their
    counts in all chunks; chunk -1 tells how many words there are, and how
    many occur in training."""
    for place, rows in runs(batches, "place"):
        got = [unpack(r["payload"]) for r in rows]
        words = [np.cumsum(w, dtype=np.uint64) for w, _ in got]
        apart, number = distinct(np.concatenate(words))
        total = np.bincount(number, np.concatenate([c for _, c in got]))  # exact below 2^53
        ends = np.cumsum([len(w) for w in words])
        out = [(place, -1, len(apart), int((total > 0).sum()), None)]
        for r, w, e in zip(rows, words, ends):
            own = number[e - len(w):e]
            out.append((place, r["chunk"], 0, 0, pack(gaps(own.astype(np.uint64)), total[own].astype(np.uint64))))
        yield batch(out, _TOTALS)


class _Chunk:
    """A chunk's documents, its words' numbers and counts, and its bigrams in
    shards.  ``corpus`` tells, beside sizes, the first number of each bucket;
    the start mark has the number after all words."""

    def __init__(self, chunk: pa.Table, answers: list, corpus: dict):
        ids, missing, lengths, train = unpack(chunk.column("docs")[0].as_py())
        self.ids = pa.array(ids.view(np.int64), mask=missing.astype(bool))
        self.lengths, self.train = lengths.astype(np.int64), train.astype(bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.tokens = unpack(chunk.column("tokens")[0].as_py())[0].astype(np.int64)
        words, totals = [], []
        for a in answers:
            if a["kind"] == 1:
                number, total = unpack(a["payload"])
                words.append(np.cumsum(number, dtype=np.uint64) + np.uint64(corpus["first"][a["place"]]))
                totals.append(total)
        self.words = np.append(np.concatenate(words), np.uint64(corpus["all_words"]))
        self.totals = np.append(np.concatenate(totals), np.uint64(corpus["docs"])).astype(np.int64)
        # the bigrams: context and word, and the bigram at each position
        n = len(self.words)
        context = np.empty(len(self.tokens), np.int64)
        context[1:] = self.tokens[:-1]
        context[self.starts] = n - 1
        pairs, self.pair = distinct(context * n + self.tokens)
        self.context, self.word = pairs // n, pairs % n
        by_context = mix64(self.words + np.uint64(1))[self.context]
        both = mix64(by_context + self.words[self.word])
        hot = self.totals[self.context] * corpus["shards"] > corpus["tokens"]
        self.shard = (np.where(hot, both, by_context) >> np.uint64(32)) * np.uint64(corpus["shards"]) >> np.uint64(32)
        self.by_shard = np.argsort(self.shard, kind="stable")


def _probability(counts: np.ndarray, corpus: dict) -> np.ndarray:
    return (counts.astype(np.float64) + 1) / (corpus["tokens"] + corpus["words"] + 1)


def _ordered(answers: pa.Table) -> list:
    return sorted(answers.to_pylist(), key=lambda r: (r["kind"], r["place"]))


def _send_bigrams(corpus: dict):
    """A chunk's bigrams to their shards, with the counts of their words."""
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(chunk, _ordered(answers), corpus)
        learnt = np.repeat(c.train, c.lengths)
        counts = np.bincount(c.pair[learnt], minlength=len(c.word)).astype(np.uint64)
        order, rows = c.shard[c.by_shard], []
        cuts = np.append(np.flatnonzero(np.append(True, order[1:] != order[:-1])), len(order))
        for lo, hi in zip(cuts, cuts[1:]):
            own = c.by_shard[lo:hi]
            used, number = distinct(np.concatenate((c.context[own], c.word[own])))
            payload = pack(gaps(c.words[used]), c.totals[used].astype(np.uint64),
                           gaps(number[:len(own)].astype(np.uint32)), number[len(own):].astype(np.uint32), counts[own])
            rows.append((int(order[lo]), chunk.column("chunk")[0].as_py(), payload))
        return pa.Table.from_batches([batch(rows, _SENT)])
    return run


def build_trie(blocks: list, corpus: dict, strength: float) -> bytes:
    """The trie of a shard's blocks (words, their counts, and of the bigrams
    contexts, words and counts).  Words that training does not have are left
    out; the start mark is a context only."""
    words, totals = (np.concatenate([b[k] for b in blocks]) for k in range(2))
    seen = np.flatnonzero(totals)
    words, number = distinct(words[seen])
    n = len(words)
    total = np.empty(n, np.uint64)
    total[number] = totals[seen]
    p1, backoff = code(_probability(total, corpus)), code(strength / (total + strength))
    keys, counts = [], []
    for b in blocks:
        met = np.flatnonzero(b[4])
        at = np.searchsorted(words, b[0]).astype(np.uint64)
        keys.append(at[b[2][met]] * np.uint64(max(n, 1)) + at[b[3][met]])
        counts.append(b[4][met])
    keys, number = distinct(np.concatenate(keys))
    met = np.bincount(number, np.concatenate(counts), minlength=len(keys))
    context, word = (keys // np.uint64(max(n, 1))).astype(np.int64), (keys % np.uint64(max(n, 1))).astype(np.int64)
    weight = value(backoff)[context]
    p2 = code(np.minimum(met * weight / strength + weight * value(p1)[word], 1.0))
    p1[words == corpus["all_words"]] = ABSENT
    unknown = int(code(_probability(np.zeros(1), corpus))[0])
    return encode_trie(words, p1, backoff, keys, p2, unknown)


def _answer(corpus: dict, strength: float):
    """Per shard: its trie (chunk -1), and for each chunk the codes of the
    bigrams that it sent, asked of the trie."""
    def run(batches):
        for shard, rows in runs(batches, "place"):
            blocks = []
            for r in rows:
                words, totals, context, word, counts = unpack(r.pop("payload"))
                blocks.append((np.cumsum(words, dtype=np.uint64), totals, np.cumsum(context, dtype=np.int64), word, counts))
            blob = build_trie(blocks, corpus, strength)
            yield batch([(shard, -1, blob)], _SENT)
            trie = NgramTrie(blob)
            for r, b in zip(rows, blocks):
                places = trie.places(b[0])
                yield batch([(shard, r["chunk"], pack(trie.codes(places[b[2]], places[b[3]]).astype(np.uint16)))], _SENT)
    return run


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                     ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _sum_up(corpus: dict):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        answers = _ordered(answers)
        c = _Chunk(chunk, answers, corpus)
        codes = np.empty(len(c.word), np.int64)
        codes[c.by_shard] = np.concatenate([unpack(a["payload"])[0] for a in answers if a["kind"] == 2])
        base = np.log10(_probability(c.totals, corpus))[c.tokens]
        known = (c.totals > 0)[c.tokens].astype(np.int64)
        add = lambda x: np.add.reduceat(x, c.starts)
        return pa.Table.from_arrays(
            [c.ids, pa.array(~c.train), pa.array(c.lengths), pa.array(add(known)), pa.array(add(base)),
             pa.array(add(codes[c.pair]) / -STEP)], schema=_SCORES)
    return run


def _with_answers(chunks: DataFrame, parts: int, *answers: DataFrame):
    """Every chunk's row together with the answers to it."""
    rows = [a.filter(F.col("chunk") >= 0).select("chunk", F.lit(k).alias("kind"), "place", "payload")
            for k, a in enumerate(answers, 1)]
    back = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return chunks.select("chunk", "docs", "tokens").groupBy("chunk").cogroup(
        back.repartition(parts, "chunk").groupBy("chunk"))


def score_documents(docs: DataFrame, train: Column, strength: float = 200.0, chunk_tokens: int = CHUNK_TOKENS,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scores and tries: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score`` of every document, and ``place, blob`` of every
    shard's trie (see :class:`NgramTrie`).

    ``train`` tells the rows of ``docs`` to learn from; scores are log10
    probabilities of whole texts.  ``base_score`` is that of ``p(w)`` alone,
    ``score`` sums the trie's codes, steps of 1/2048.

    * A null or empty text is its end token.  Very long texts make chunks of
      their own size.
    * Repeated rows are learnt from and scored each; a null id stays null.
    * Without training rows every probability is 1 and every score 0; an
      empty table gives an empty result; other columns are ignored.
    * Words are told apart by 64-bit hashes: among n different words n^2 / 2^65
      pairs are expected to share one (3 % for one pair at 10^9 words).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"),
                        F.col(text_col).cast("binary").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = bucketed(texts.mapInArrow(_chunked(chunk_tokens), _ddl(_CHUNKS)), "chunk", parts, "lm-chunks")
    size = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_train", "n_docs")]).first()
    buckets, shards = size[0] // BUCKET_TOKENS + 1, size[0] // SHARD_TOKENS + 1
    totals = stage(chunks.select("chunk", "words", "counts").mapInArrow(_send_words(buckets), _ddl(_SENT))
                   .repartition(max(parts, buckets), "place").sortWithinPartitions("place", "chunk")
                   .mapInArrow(_total_words, _ddl(_TOTALS)), "lm-totals")
    told = sorted(totals.filter(F.col("chunk") < 0).select("place", "words", "known").collect())
    first = dict(zip([t.place for t in told], np.cumsum([0] + [t.words for t in told]).tolist()))
    corpus = {"tokens": size[1], "docs": size[2], "words": sum(t.known for t in told),
              "all_words": sum(t.words for t in told), "first": first, "shards": shards}
    answers = stage(_with_answers(chunks, parts, totals).applyInArrow(_send_bigrams(corpus), _ddl(_SENT))
                    .repartition(max(parts, shards), "place").sortWithinPartitions("place", "chunk")
                    .mapInArrow(_answer(corpus, strength), _ddl(_SENT)), "lm-answers")
    scores = _with_answers(chunks, parts, totals, answers).applyInArrow(_sum_up(corpus), _ddl(_SCORES)).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(size[1]).cast("long").alias("train_tokens"),
        "base_score", "score")
    return scores, answers.filter(F.col("chunk") < 0).select("place", F.col("payload").alias("blob"))


def held_out_scores(docs: DataFrame, modulus: int = 7, held: int = 2, **kw) -> DataFrame:
    """:func:`score_documents`, learnt from rows whose id's crc32 does not
    leave ``held``."""
    return score_documents(docs, bucket(F.col("doc_id"), modulus) != held, **kw)[0]
