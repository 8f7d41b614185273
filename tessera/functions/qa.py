"""QA text functions: tokenizer, uncased words, n-grams, contiguous answer
match, regex answer match, NFD normalisation, entity groups."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the simple tokenizer's pattern (alphanumeric-with-marks runs,
# or any single non-space, non-control character).
TOKEN_PATTERN = r"([\p{L}\p{N}\p{M}]+)|([^\p{Z}\p{C}])"
SENTINEL = "\u0001"


#: Characters of a batch that are Python strings at once, about.
TEXT_BYTES = 1 << 20


def normalized(texts: pa.Array, form: str) -> pa.Array:
    """Unicode normalisation of an Arrow batch (no Spark built-in; a tiny
    per-row C-library call).  Texts become Python strings a few at a time, so
    a task holds the batch and its result, whatever the texts' lengths."""
    done, lo = [], 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while lo < len(texts):
        start = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, start + TEXT_BYTES, side="right")))
        part = texts.slice(lo, hi - lo)
        if not pc.all(pc.string_is_ascii(part)).as_py() and part.null_count < len(part):
            part = pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in part.to_pylist()],
                            texts.type)
        done.append(part)
        lo = hi
    return pa.concat_arrays(done) if done else texts


@F.arrow_udf(T.StringType())
def nfd(texts: pa.Array) -> pa.Array:
    """Unicode canonical decomposition."""
    return normalized(texts, "NFD")


def tokens(text: Column) -> Column:
    """Token strings in order (F31)."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def words(text: Column, uncased: bool = True) -> Column:
    """Tokens, each lower-cased on its own when ``uncased`` (F32): case
    mapping can depend on what follows in the text (a Greek sigma at a
    word's end), and a token ends where the pattern ends it."""
    return F.transform(tokens(text), lambda t: F.lower(t)) if uncased else tokens(text)


def token_spans(text: Column) -> Column:
    """``[start, end)`` character offsets of each token (F32 offsets):
    tokens are found left to right, so each starts at the first occurrence
    at or after the previous token's end."""
    toks = tokens(text)
    return F.aggregate(
        toks,
        F.struct(F.lit(0).alias("pos"),
                 F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, tok: F.struct(
            (F.call_function("locate", tok, text, acc["pos"] + 1) - 1 + F.length(tok)).alias("pos"),
            F.array_append(acc["spans"], F.struct(
                (F.call_function("locate", tok, text, acc["pos"] + 1) - 1).alias("start"),
                (F.call_function("locate", tok, text, acc["pos"] + 1) - 1 + F.length(tok)).alias("end"))).alias("spans")),
    )["spans"]


def untokenize(text: Column, spans: Column, first: int = 0, last: int | None = None) -> Column:
    """The original text of tokens ``first`` to ``last``-1 with the white
    space between them, trimmed (F32); ``spans`` are the text's
    :func:`token_spans`, null or no tokens give the empty text."""
    end = F.size(spans) if last is None else F.least(F.size(spans), F.lit(last))
    start = F.element_at(spans, first + 1)["start"]
    stop = F.element_at(spans, end)["end"]
    return F.when(end > first, F.substring(text, start + 1, stop - start)).otherwise(F.lit(""))


def ngrams(w: Column, n: int, skip=None) -> Column:
    """All n-grams of length 1..n, start-major order, space-joined (F33).
    ``skip`` (a function of the gram's token array) drops grams for which it
    is true.  Pass a column reference for ``w``: an expression used inside
    the lambdas would be re-evaluated for every n-gram."""
    size = F.size(w)
    grams = F.flatten(F.transform(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
        lambda s: F.transform(
            F.sequence(s, F.least(s + n, size) - 1),
            lambda e: F.slice(w, s + 1, e - s + 1))))
    if skip is not None:
        grams = F.filter(grams, lambda g: ~skip(g))
    return F.when(size > 0, F.transform(grams, lambda g: F.array_join(g, " "))) \
        .otherwise(F.array().cast("array<string>"))


def sentinel_join(w: Column) -> Column:
    return F.concat(F.lit(SENTINEL), F.array_join(w, SENTINEL), F.lit(SENTINEL))


def contains_tokens(passage_words: Column, answer_words: Column) -> Column:
    """Answer tokens appear contiguously in the passage tokens; an answer
    with no tokens always matches (F34)."""
    return F.when(F.size(answer_words) == 0, F.lit(True)).otherwise(
        F.instr(sentinel_join(passage_words), sentinel_join(answer_words)) > 0)


def answer_words(answers: Column) -> Column:
    """Uncased tokens of each answer of an array-of-strings column."""
    return F.transform(answers, lambda a: words(a))


def has_answers(passage_words: Column, answers_words: Column) -> Column:
    """Any answer's tokens appear contiguously in the passage tokens (F34).
    Inputs are token arrays (NFD-normalise the texts first with
    :func:`nfd` / :func:`normalize_answers`)."""
    return F.exists(answers_words, lambda a: contains_tokens(passage_words, a))


def normalize_answers(df: DataFrame, col: str = "answers") -> DataFrame:
    """NFD-normalise an array-of-strings column (exploded, normalised and
    re-collected in order per row id ``_rid``)."""
    rid = df.withColumn("_rid", F.monotonically_increasing_id())
    ex = rid.select("_rid", F.posexplode_outer(col).alias("_p", "_a"))
    ex = ex.withColumn("_a", nfd(F.col("_a")))
    back = (ex.groupBy("_rid").agg(F.array_sort(F.collect_list(
        F.when(F.col("_a").isNotNull(), F.struct("_p", "_a")))).alias("_s"))
        .select("_rid", F.transform("_s", lambda s: s["_a"]).alias(col)))
    return rid.drop(col).join(back, "_rid").drop("_rid")


@F.pandas_udf(T.BooleanType())
def regex_match(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    """Case-insensitive, multi-line search of a Python-dialect pattern; a
    pattern that does not compile is no match (F35)."""
    out = []
    for t, p in zip(texts, patterns):
        if t is None or p is None:
            out.append(False)
            continue
        try:
            rx = re.compile(unicodedata.normalize("NFD", p), re.IGNORECASE | re.UNICODE | re.MULTILINE)
        except re.error:
            out.append(False)
            continue
        out.append(rx.search(unicodedata.normalize("NFD", t)) is not None)
    return pd.Series(out)


def entity_groups(tags: DataFrame, doc: str = "doc_id", pos: str = "pos", tag: str = "tag",
                  token: str = "token", non_entity: str = "O") -> DataFrame:
    """Runs of consecutive equal entity tags (F36), gaps-and-islands:
    ``doc, start, tag, text`` (tokens joined by a space)."""
    w = Window.partitionBy(doc).orderBy(pos)
    isl = (tags.withColumn("_new", (F.lag(tag).over(w).isNull()
                                    | (F.lag(tag).over(w) != F.col(tag))).cast("int"))
           .withColumn("_grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return (isl.where(F.col(tag) != non_entity)
            .groupBy(doc, "_grp", tag)
            .agg(F.min(pos).alias("start"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, token))),
                                          lambda s: s[token]), " ").alias("text"))
            .drop("_grp"))
