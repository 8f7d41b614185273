"""Language of web pages by Bayesian evidence fusion.

Four pieces of evidence are combined as log odds: the likelihood of the
page's text under byte 3-gram models, the language the markup declares, the
address suffix, and a prior of the host.  The text models come from labelled
documents.  What declarations and suffixes say about a language is counted
over the pages by their text posterior.  Host priors are smoothed through the
hierarchy host - domain - all pages, from posteriors without the page itself.
"""

from __future__ import annotations

import html as html_
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import join_small

from .common import stage

BITS = 16
SLICES = 16


def grams(text: bytes) -> np.ndarray:
    """Numbers of the byte 3-grams of a text, ASCII letters lower-cased,
    white space runs as one blank, with a blank at both ends."""
    b = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


_BLOCKS = re.compile(r"<!--.*?-->|<(script|style|nav|noscript|template)\b.*?</\1\s*>", re.S | re.I)
_TAGS = re.compile(r"<[^>]*>")


def page_text(html: str | None) -> str:
    """Visible text of a page, without scripts, styles, comments and
    navigation."""
    return html_.unescape(_TAGS.sub(" ", _BLOCKS.sub(" ", html or "")))


@dataclass
class TextModel:
    languages: list[str]
    log_prior: np.ndarray
    log_p: np.ndarray  # language x gram

    def likelihoods(self, text: bytes, weight: float, most: float) -> np.ndarray:
        """Log likelihood for each language relative to the mean of all.
        Neighbouring 3-grams overlap, so each counts ``weight``, and a text
        never counts as more than ``most`` independent grams."""
        g = grams(text)
        if not len(g):
            return np.zeros(len(self.languages))
        at, n = np.unique(g, return_counts=True)
        ll = (self.log_p[:, at] * n).sum(axis=1) / len(g)
        return (ll - ll.mean()) * min(weight * len(g), most)


def _count(languages: list[str]):
    place = {x: k for k, x in enumerate(languages)}

    def run(batches):
        counts = np.zeros((len(languages), 1 << BITS), np.int64)
        rows = np.zeros(len(languages), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                k = place.get(lang)
                if k is not None:
                    rows[k] += 1
                    counts[k] += np.bincount(grams(text.as_py() or b""), minlength=1 << BITS)
        for k in np.flatnonzero(rows):
            for s, part in enumerate(np.split(counts[k], SLICES)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([s], pa.int32()),
                     pa.array([int(rows[k]) if s == 0 else 0], pa.int64()), pa.array([part.tobytes()], pa.binary())],
                    names=["lang", "slice", "rows", "counts"])
    return run


def _add(batches):
    """Sums neighbouring rows of one (language, slice)."""
    key, rows, total = None, 0, None
    for batch in batches:
        for r in batch.to_pylist():
            if key is not None and (r["lang"], r["slice"]) != key:
                yield _counted(key, rows, total)
                total = None
            if total is None:
                key, rows, total = (r["lang"], r["slice"]), 0, 0
            rows += r["rows"]
            total = total + np.frombuffer(r["counts"], np.int64)
    if total is not None:
        yield _counted(key, rows, total)


def _counted(key, rows, total):
    return pa.RecordBatch.from_arrays(
        [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([rows], pa.int64()),
         pa.array([total.tobytes()], pa.binary())], names=["lang", "slice", "rows", "counts"])


def fit_text_model(documents: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   smoothing: float = 0.5) -> TextModel:
    """3-gram models from all rows with a language.  The driver gets the
    languages' names and, for each, ``2^BITS`` counts."""
    rows = documents.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    schema = "lang int, slice int, rows long, counts binary"
    parts = (rows.mapInArrow(_count(languages), schema).repartition("lang", "slice")
             .sortWithinPartitions("lang", "slice").mapInArrow(_add, schema).collect())
    counts, n = np.zeros((len(languages), 1 << BITS)), np.zeros(len(languages))
    for r in parts:
        width = (1 << BITS) // SLICES
        counts[r["lang"], r["slice"] * width:(r["slice"] + 1) * width] += np.frombuffer(r["counts"], np.int64)
        n[r["lang"]] += r["rows"]
    p = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    return TextModel(languages, np.log((n + 1) / (n + 1).sum()), np.log(p))


def text_evidence(df: DataFrame, model: TextModel, text_col: str, keep: tuple, is_html: bool,
                  weight: float = 0.3, most: float = 60.0) -> DataFrame:
    """The ``keep`` columns and ``evidence``: an array with the text's log
    likelihood for each language of the model."""
    # plain values: a broadcast's classes would have to be installed on workers
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.log_prior, model.log_p))
    schema = df.select(*keep).schema.add("evidence", T.ArrayType(T.DoubleType()))

    def run(batches):
        own = TextModel(*shared.value)
        for batch in batches:
            out = []
            for t in batch.column(batch.num_columns - 1):
                text = t.as_py() or ""
                out.append(own.likelihoods((page_text(text) if is_html else text).encode(), weight, most).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))],
                                             names=[f.name for f in schema])
    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of log odds."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def _sums(df: DataFrame, keys: list[str], probs: str, k: int, out: str) -> DataFrame:
    """Element-wise sums of the array ``probs`` for each key (partial sums
    are combined before the shuffle)."""
    sums = [F.sum(F.element_at(probs, i + 1)).alias(f"__{i}") for i in range(k)]
    return df.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"__{i}") for i in range(k)]).alias(out))


def identify(pages: DataFrame, model: TextModel, concentration: float = 8.0, smoothing: float = 0.5) -> DataFrame:
    """One row per page: ``page_id, lang, confidence, text_lang, declared,
    host``.

    * Null or empty html gives no text evidence and no declaration; a null
      url gives no suffix and no host, and the prior of all pages.  Absent
      evidence says nothing; a page without any gets the most common language.
    * Equal scores take the language that comes first in code-point order.
    * Null ids and repeated rows are pages of their own; an empty table, or a
      model without languages, gives an empty result or null languages.
    """
    k = len(model.languages)
    if k == 0:
        return pages.select("page_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"),
            ("host", "string"))])
    lower = F.lower(F.coalesce("html", F.lit("")))
    declared = F.regexp_extract(lower, r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    address = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_replace(F.regexp_extract(address, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1),
                            r"^www\.", "")
    seen = pages.select("page_id", declared.alias("declared"), host.alias("host"), "html")
    seen = seen.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)) \
        .withColumn("domain", F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1))
    seen = stage(text_evidence(seen, model, "html", ("page_id", "declared", "host", "suffix", "domain"), True), "pages")
    prior = F.array(*[F.lit(float(x)) for x in model.log_prior])
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    text = seen.withColumn("logit", add(F.col("evidence"), prior)).withColumn("p", softmax(F.col("logit")))

    def says(column: str) -> DataFrame:
        """log P(value | language) of a column, by the text posteriors; an
        absent value ("") says nothing."""
        sums = stage(_sums(text.filter(F.col(column) != ""), [column], "p", k, "n"), "says")
        totals = sums.agg(F.count(F.lit(1)).alias("values"),
                          *[F.sum(F.element_at("n", i + 1)).alias(f"t{i}") for i in range(k)])
        per = [F.log((F.element_at("n", i + 1) + smoothing) / (F.col(f"t{i}") + smoothing * F.col("values")))
               for i in range(k)]
        return sums.join(F.broadcast(totals)).select(column, F.array(*per).alias(f"says_{column}"))

    nothing = F.array(*[F.lit(0.0)] * k)
    both = join_small(join_small(text, says("declared"), "declared", "left"), says("suffix"), "suffix", "left")
    both = both.withColumn("local", add(add(F.col("evidence"), F.coalesce("says_declared", nothing)),
                                        F.coalesce("says_suffix", nothing)))
    both = stage(both.withColumn("q", softmax(add(F.col("local"), prior)))
                 .select("page_id", "declared", "host", "domain", "evidence", "local", "q"), "fused")
    # hierarchical host prior, each level without the page's own share
    hosts = _sums(both, ["host", "domain"], "q", k, "n_host")
    domains = stage(_sums(both, ["domain"], "q", k, "n_domain"), "domains")
    everything = _sums(domains.withColumn("all", F.lit(1)), ["all"], "n_domain", k, "n_all").drop("all")
    placed = join_small(join_small(both, hosts, ["host", "domain"]), domains, "domain").join(F.broadcast(everything))

    def level(count: str, parent: Column | None) -> Column:
        n = F.zip_with(count, "q", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        total = F.aggregate(n, F.lit(0.0), lambda s, y: s + y)
        if parent is None:
            return F.transform(n, lambda x: (x + 1.0) / (total + float(k)))
        return F.zip_with(n, parent, lambda x, p: (x + concentration * p) / (total + concentration))

    placed = placed.withColumn("g", level("n_all", None)).withColumn("d", level("n_domain", F.col("g"))) \
        .withColumn("h", F.when(F.col("host") == "", F.col("g")).otherwise(level("n_host", F.col("d"))))
    final = placed.withColumn("r", softmax(add(F.col("local"), F.transform("h", lambda x: F.log(x)))))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return final.select("page_id", best(F.col("r")).alias("lang"), F.array_max("r").alias("confidence"),
                        best(F.col("evidence")).alias("text_lang"), "declared", "host")
