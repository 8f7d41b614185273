"""Quality by a sparse ensemble of rules over text statistics.

Statistics of every text come from one pass.  Small regression-free trees on
samples of features give paths, each path's conjunction of cuts is a rule, a
lasso logistic fit over rules and plain statistics keeps few of them, and
what is left is compiled into one Spark column expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import join_small

from .common import stage
from .toxicity import bucket

STATISTICS = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "newline", "comma_stop",
              "bang_question", "symbol", "bar", "bracket", "quote", "non_ascii", "lower", "distinct_words",
              "distinct_lines", "line_words", "short_words", "long_words", "top_word", "byte_entropy",
              "capital_words", "symbol_words", "end_mark_lines")

_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t", "newline": b"\n\r", "comma_stop": b",.;:", "bang_question": b"!?",
    "symbol": b"#$%&*+=@^~_\\/", "bar": b"|", "bracket": b"()[]{}<>", "quote": b"\"'`",
    "non_ascii": bytes(range(128, 256)),
}
_CLASS = np.zeros(256, np.int64)
for _k, (_name, _chars) in enumerate(_SETS.items()):
    _CLASS[list(_chars)] = _k + 1


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one whole text; an empty or null text gives zeros."""
    text = text or b""
    out = dict.fromkeys(STATISTICS, 0.0)
    words = text.split()
    if not words:
        return list(out.values())
    size = len(text)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=histogram, minlength=len(_SETS) + 1) / size
    out.update(zip(_SETS, share[1:].tolist()))
    p = histogram[histogram > 0] / size
    n = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    out["log_bytes"], out["log_words"] = float(np.log1p(size)), float(np.log1p(n))
    out["word_bytes"] = float(lengths.mean())
    out["byte_entropy"] = float(-(p * np.log2(p)).sum())
    out["distinct_words"] = len(counts) / n
    out["top_word"] = max(counts.values()) / n
    out["distinct_lines"] = len(set(lines)) / len(lines)
    out["line_words"] = float(np.log1p(n / len(lines)))
    out["short_words"] = float((lengths <= 2).mean())
    out["long_words"] = float((lengths >= 15).mean())
    out["capital_words"] = sum(c for w, c in counts.items() if 65 <= w[0] <= 90) / n
    out["symbol_words"] = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128
                              and w[-1:] not in b".,;:!?") / n
    out["end_mark_lines"] = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
    return list(out.values())


def with_statistics(docs: DataFrame, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and one double column for each statistic."""
    schema = docs.select(*keep).schema
    for name in STATISTICS:
        schema = schema.add(name, "double")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            values = np.array([statistics(t.as_py()) for t in texts], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in values.T)],
                names=[f.name for f in schema])
    return docs.select(*keep, F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)


#: A rule is a tuple of (statistic, "<=" or ">", cut).
Rule = tuple[tuple[str, str, float], ...]


def path_rules(forest) -> list[Rule]:
    """Every path from a root to an inner node or leaf, as a conjunction in
    which each statistic keeps its tightest cuts; each rule once."""
    rules: dict[Rule, None] = {}

    def add(path):
        tight: dict[tuple[str, str], float] = {}
        for name, op, cut in path:
            old = tight.get((name, op), cut)
            tight[name, op] = min(old, cut) if op == "<=" else max(old, cut)
        rules.setdefault(tuple(sorted((n, o, c) for (n, o), c in tight.items())))

    line = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)")
    for tree in forest.trees:
        path: list[tuple[int, tuple]] = []
        for text in tree.toDebugString.splitlines():
            m = line.match(text)
            if m:
                depth = len(m[1])
                path = [x for x in path if x[0] < depth]
                path.append((depth, (STATISTICS[int(m[3])], m[4], float(m[5]))))
                add([x[1] for x in path])
    return list(rules)


def rule_column(rule: Rule) -> Column:
    """A rule as a Spark condition, 1.0 or 0.0."""
    cond = F.lit(True)
    for name, op, cut in rule:
        cond = cond & (F.col(name) <= cut if op == "<=" else F.col(name) > cut)
    return cond.cast("double")


@dataclass
class RuleModel:
    """Intercept and the terms that the lasso kept."""

    intercept: float
    rules: list[tuple[Rule, float]]
    linear: list[tuple[str, float, float, float]]  # statistic, low, high, weight

    def column(self) -> Column:
        """The probability of label 1 as one column expression over the
        statistics."""
        logit = F.lit(self.intercept)
        for rule, weight in self.rules:
            logit = logit + rule_column(rule) * weight
        for name, low, high, weight in self.linear:
            logit = logit + F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high)) * weight
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def fit(rows: DataFrame, label_col: str = "label", trees: int = 24, depth: int = 3, penalty: float = 2e-3,
        seed: int = 7) -> RuleModel:
    """Fits the ensemble on all ``rows`` (statistics and a 0/1 label).  With
    one class only, or none, the model scores that class (no row: 0.5)."""
    counts = {r["label"]: r["count"] for r in rows.groupBy(F.col(label_col).alias("label")).count().collect()}
    if len(counts) < 2:
        return RuleModel(0.0 if not counts else 40.0 * (1 if 1 in counts else -1), [], [])
    rows = rows.withColumn("label", F.col(label_col).cast("double"))
    vector = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird",
                                    subsamplingRate=0.5, maxBins=64, seed=seed).fit(vector)
    rules = path_rules(forest)
    low_high = dict(zip(STATISTICS, rows.approxQuantile(list(STATISTICS), [0.025, 0.975], 0.005)))
    linear = [(s, *low_high[s]) for s in STATISTICS if low_high[s][0] < low_high[s][1]]
    terms = [rule_column(r) for r in rules] \
        + [F.least(F.greatest(F.col(s), F.lit(lo)), F.lit(hi)) for s, lo, hi in linear]
    table = stage(rows.select("label", array_to_vector(F.array(*terms)).alias("features")), "rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, aggregationDepth=2).fit(table)
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept),
                     [(r, float(w)) for r, w in zip(rules, weights) if w != 0],
                     [(s, lo, hi, float(w)) for (s, lo, hi), w in zip(linear, weights[len(rules):]) if w != 0])


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0,
             cut: float = 0.3, **kw) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Labels are learnt from rows whose crc32 bucket is not ``held``; the
    text's statistics are the only input of a score.  Null and empty texts
    have all statistics 0 and get the score the rules give that; null ids and
    repeated rows are scored like others; a label for an unknown id is
    ignored; an empty table gives an empty result.
    """
    stats = stage(with_statistics(docs.select("doc_id", "text")), "statistics")
    known = labels.filter((bucket(F.col("doc_id"), modulus) != held) & F.col(label).isNotNull()
                          & F.col("doc_id").isNotNull()) \
        .select("doc_id", F.col(label).cast("int").alias("label"))
    model = fit(stage(join_small(stats, known, "doc_id"), "labelled"), **kw)
    return stats.select("doc_id", (bucket(F.col("doc_id"), modulus) == held).alias("held_out"),
                        model.column().alias("score")) \
        .withColumn("predicted", (F.col("score") >= cut).cast("int"))
