"""Training-group sampling: one positive and ``n - 1`` negatives per group,
prompts, and flattening into passage rows.  All choices are seeded md5
hashes of the group key, so a group's sample is the same on every engine
and every retry; everything is a per-row array expression (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX


def _pick(arr: Column, idx: Column) -> Column:
    return F.element_at(arr, (idx + 1).cast("int"))


def sample_positive(pos: Column, key: Column, seed: int, shuffle: bool = True) -> Column:
    """First positive, or a seeded uniform one (M2)."""
    if not shuffle:
        return pos[0]
    return _pick(pos, F.pmod(TX.hash_long(seed, key, F.lit("pos")), F.size(pos)))


def sample_negatives(negs: Column, key: Column, n_passages: int, seed: int,
                     shuffle: bool = True) -> Column:
    """``n_passages - 1`` negatives (M3): with replacement when too few,
    none when ``n_passages == 1``, the prefix without shuffle, else a seeded
    sample without replacement."""
    need = n_passages - 1
    if need <= 0:
        return F.slice(negs, 1, 0)
    with_repl = F.transform(
        F.sequence(F.lit(0), F.lit(need - 1)),
        lambda i: _pick(negs, F.pmod(TX.hash_long(seed, key, F.lit("neg"), i), F.size(negs))))
    if shuffle:
        keyed = F.transform(negs, lambda x, i: F.struct(
            TX.hash_long(seed, key, F.lit("perm"), i).alias("h"), i.alias("i"), x.alias("p")))
        without = F.transform(F.slice(F.array_sort(keyed), 1, need), lambda s: s["p"])
    else:
        without = F.slice(negs, 1, need)
    return (F.when(F.size(negs) == 0, F.slice(negs, 1, 0))
            .when(F.size(negs) < need, with_repl)
            .otherwise(without))


def epoch_positive(pos: Column, row_idx: Column, seed: int, epoch: int) -> Column:
    """Epoch-aware positive (M4): index ``(row + seed + epoch) mod size``."""
    return _pick(pos, F.pmod(row_idx + seed + epoch, F.size(pos)))


def epoch_negatives(negs: Column, key: Column, n_passages: int, seed: int, epoch: int) -> Column:
    """Epoch-aware negatives (M5): a fixed per-group permutation, doubled,
    window of ``n - 1`` at offset ``epoch * (n - 1) mod size``; too few
    negatives fall back to sampling with replacement."""
    need = n_passages - 1
    if need <= 0:
        return F.slice(negs, 1, 0)
    keyed = F.transform(negs, lambda x, i: F.struct(
        TX.hash_long(seed, key, F.lit("perm"), i).alias("h"), i.alias("i"), x.alias("p")))
    perm = F.transform(F.array_sort(keyed), lambda s: s["p"])
    off = F.pmod(F.lit(epoch * need), F.size(negs))
    window = F.slice(F.concat(perm, perm), (off + 1).cast("int"), need)
    return F.when(F.size(negs) < need, sample_negatives(negs, key, n_passages, seed)).otherwise(window)


def sample_groups(groups: DataFrame, n_passages: int, seed: int = 42, pos_shuffle: bool = True,
                  neg_shuffle: bool = True, key: str = "query_id") -> DataFrame:
    """Groups -> groups with exactly one positive and ``n - 1`` negatives."""
    k = F.col(key)
    return (groups.withColumn("positive_passages",
                              F.array(sample_positive(F.col("positive_passages"), k, seed, pos_shuffle)))
            .withColumn("negative_passages",
                        sample_negatives(F.col("negative_passages"), k, n_passages, seed, neg_shuffle)))


def add_prompts(groups: DataFrame, instructions: DataFrame, seed: int, add_prompt_prob: float,
                prompt_type: str = "e5", task: str = "domain_name", key: str = "query_id") -> DataFrame:
    """``query_prompt`` (and ``passage_prompt`` for symmetric tasks) kept
    with probability ``add_prompt_prob`` (F10-F12).  The instruction
    dictionary is a small fixed dimension table (broadcast)."""
    g = groups.join(F.broadcast(instructions.withColumnRenamed("task", task)), task, "left")
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"),
                                             F.lit("prompt"))), 1, 13), 16, 10).cast("double") \
        / float(1 << 52)
    prompt = TX.train_prompt(F.col(task), F.col("instructions"),
                             TX.hash_long(seed, F.col(key), F.lit("inst")), prompt_type)
    keep = TX.prompt_kept(add_prompt_prob, u)
    return (g.withColumn("query_prompt", F.when(keep, prompt))
            .withColumn("passage_prompt", F.when(keep & TX.is_symmetric(F.col(task)), prompt))
            .drop("instructions"))


def flatten(groups: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per passage (M11): positive first (position 0), then the
    negatives; exactly one positive is required.  Passage text is
    ``title + ' ' + text`` with the passage prompt; the query carries its
    prompt."""
    checked = groups.withColumn("_one", F.when(
        F.size("positive_passages") != 1,
        F.raise_error(F.lit("contrastive learning needs exactly one positive"))))
    cols = set(groups.columns)
    qp = F.col("query_prompt") if "query_prompt" in cols else F.lit(None).cast("string")
    pp = F.col("passage_prompt") if "passage_prompt" in cols else F.lit(None).cast("string")
    rows = checked.select(
        key, TX.with_prompt(qp, F.col("query")).alias("query_text"), pp.alias("_pp"),
        F.coalesce(F.col("_one").cast("string"), F.lit("")).alias("_chk"),
        F.posexplode(F.concat("positive_passages", "negative_passages")).alias("position", "psg"))
    return rows.select(
        key, "position", F.col("psg.docid").alias("docid"), "query_text",
        F.concat(F.col("_chk"), TX.with_prompt(F.col("_pp"), TX.passage_text(
            F.col("psg.title"), F.col("psg.text")))).alias("passage_text"))
