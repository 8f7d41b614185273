"""Near-duplicate detection with SimHash fingerprints.

Everything is keyed on *distinct* fingerprints first: exact copies collapse
into one row (map-side partial aggregation), so a group of copies holding a
third of all rows costs one row in the block join, never a quadratic pair
set.  The Hamming-range join is rewritten as an equi join on block keys
(pigeonhole), verified with ``bit_count(a ^ b) <= k``; each pair is kept only
from its first shared key, so no distinct/shuffle is needed after the join.
The fan-out per distinct fingerprint is bounded by the radius-k ball
(at most 1 + 64 + 2016 fingerprints for k = 2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, fits_broadcast, join_small, spread
from ..functions.simhash import (block_keys, clean_query, first_shared_combo,
                                 hamming, simhash64)


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fp",
                clean: bool = True) -> DataFrame:
    """Add a SimHash column (narrow, partition-local)."""
    text = clean_query(F.col(text_col)) if clean else F.col(text_col)
    return spread(df).withColumn(out, simhash64(text))


def near_fingerprint_pairs(left: DataFrame, right: DataFrame, k: int = 2,
                           n_blocks: int | None = None,
                           include_self: bool = True) -> DataFrame:
    """All pairs (fp_l, fp_r) with Hamming distance <= k.

    ``left``/``right`` hold one column ``fp`` of distinct fingerprints.
    Returns ``fp_l, fp_r, distance``.  With ``include_self`` a fingerprint
    present on both sides pairs with itself (distance 0).

    A fingerprint has a row for each block combination, which a plan's size
    estimate leaves out: the keys of ``right`` are broadcast only after
    measuring them, and never when both sides are one table.
    """
    lk = left.select(F.col("fp").alias("fp_l"),
                     F.explode(block_keys(F.col("fp"), k, n_blocks)).alias("bk"))
    rk = right.select(F.col("fp").alias("fp_r"),
                      F.explode(block_keys(F.col("fp"), k, n_blocks)).alias("bk"))
    small = left is not right and fits_broadcast(rk)
    pairs = (
        lk.join(F.broadcast(rk) if small else rk.hint("merge"), "bk")
        .where(hamming(F.col("fp_l"), F.col("fp_r")) <= k)
        # keep a pair only from the first block combination both share
        .where(F.col("bk.combo") == first_shared_combo(F.col("fp_l"), F.col("fp_r"), k, n_blocks))
        .select("fp_l", "fp_r", hamming(F.col("fp_l"), F.col("fp_r")).alias("distance"))
    )
    if not include_self:
        pairs = pairs.where(F.col("fp_l") != F.col("fp_r"))
    return pairs


def near_duplicate_stats(df: DataFrame, id_col: str, text_col: str = "text",
                         k: int = 2, n_blocks: int | None = None) -> DataFrame:
    """Per row: its fingerprint, how many *other* rows lie within ``k`` bits
    (``n_dups``) and the smallest id within ``k`` bits, itself included
    (``rep_id``).  ``rep_id == id`` marks the row a dedup pass keeps.

    Both joins are by tables that grow with the rows but are written so small
    that they would pass for broadcast: they join by merge, past the driver."""
    rows = cut_lineage(fingerprint(df.select(id_col, text_col), text_col)
                       .select(id_col, "fp"), "fingerprints")
    # one row per distinct fingerprint (partial aggregation collapses copies);
    # it feeds both join sides and the neighbourhood join, so write it once
    per_fp = cut_lineage(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"),
                                                F.min(id_col).alias("min_id")), "fingerprint_counts")
    fps = per_fp.select("fp")
    pairs = near_fingerprint_pairs(fps, fps, k, n_blocks, include_self=True)
    hood = (
        pairs.join(per_fp.withColumnRenamed("fp", "fp_r").hint("merge"), "fp_r")
        .groupBy(F.col("fp_l").alias("fp"))
        .agg(F.sum("n").alias("n_hood"), F.min("min_id").alias("rep_id"))
    )
    return (
        rows.join(hood.hint("merge"), "fp")
        .select(F.col(id_col), F.col("fp").alias("fingerprint"),
                (F.col("n_hood") - 1).alias("n_dups"), F.col("rep_id"))
    )


def dedup_keep(df: DataFrame, id_col: str, text_col: str = "text", k: int = 2) -> DataFrame:
    """Rows whose near-duplicate neighbourhood has no smaller id.  Most ids
    are kept, so they join by merge and are never broadcast."""
    stats = near_duplicate_stats(df, id_col, text_col, k)
    keep = stats.where(F.col("rep_id") == F.col(id_col)).select(id_col)
    return df.join(keep.hint("merge"), id_col, "left_semi")


def split_lines(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row per non-blank line: ``id, line_no (1-based), line``."""
    return (
        df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
        .where(F.trim(F.col("line")) != "")
        .select(id_col, (F.col("pos") + 1).alias("line_no"), "line")
    )


def test_fingerprints(test: DataFrame, test_keys: list[str], test_text: str = "query") -> DataFrame:
    """Fingerprints of the test queries (``test_keys + fp``), written once;
    items whose cleaned text is empty are skipped (they are not test
    queries).  Reusable across calls, e.g. for every streaming micro-batch."""
    return cut_lineage(
        spread(test.select(*test_keys, clean_query(F.col(test_text)).alias("_q")))
        .where(F.col("_q") != "")
        .withColumn("fp", simhash64(F.col("_q")))
        .select(*test_keys, "fp"), "test_fingerprints")


def _matched(train: DataFrame, test: DataFrame, train_keys: list[str], test_keys: list[str],
             train_text: str, test_text: str, k: int, n_blocks: int | None,
             test_fps: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(train rows with their fingerprint, test items within ``k`` bits of
    each *distinct* train fingerprint ``fp_l``).  Rows that share a
    fingerprint - a hot line, all lines of punctuation - are one row of the
    match, so copies on both sides never multiply."""
    tr = cut_lineage(fingerprint(train.select(*train_keys, train_text), train_text)
                     .select(*train_keys, "fp"), "train_fingerprints")
    te = test_fps if test_fps is not None else test_fingerprints(test, test_keys, test_text)
    pairs = near_fingerprint_pairs(tr.select("fp").distinct(), te.select("fp").distinct(), k, n_blocks)
    hits = te.withColumnRenamed("fp", "fp_r").join(pairs, "fp_r").select("fp_l", *test_keys, "distance")
    return tr.withColumnRenamed("fp", "fp_l"), cut_lineage(hits, "contamination_matches")


def contamination_matches(train: DataFrame, test: DataFrame, train_keys: list[str],
                          test_keys: list[str], train_text: str = "query",
                          test_text: str = "query", k: int = 2,
                          n_blocks: int | None = None,
                          test_fps: DataFrame | None = None) -> DataFrame:
    """Flat (train row, test item) pairs whose cleaned texts are within ``k``
    bits: the expansion of the fingerprint-level match, for callers that want
    every pair.  Returns ``train_keys + test_keys + distance``.  ``test_fps``
    (from :func:`test_fingerprints`) skips re-fingerprinting the test side."""
    tr, hits = _matched(train, test, train_keys, test_keys, train_text, test_text, k, n_blocks, test_fps)
    return tr.join(hits, "fp_l").select(*train_keys, *test_keys, "distance")


def decontaminate(train: DataFrame, test: DataFrame, train_keys: list[str],
                  test_keys: list[str], train_text: str = "query",
                  test_text: str = "query", k: int = 2,
                  test_payload: list[str] | None = None,
                  test_fps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split ``train`` into (clean rows, duplicates report).

    Clean rows are returned whole and unchanged.  The report has one row per
    contaminated train row with ``test_dups``: the matched test items (as
    structs of ``test_keys + test_payload``), ordered by test key.  The lists
    are gathered once for each distinct fingerprint.
    """
    tr, hits = _matched(train, test, train_keys, test_keys, train_text, test_text, k, None, test_fps)
    flagged = cut_lineage(tr.join(hits.select("fp_l").distinct(), "fp_l", "left_semi"), "flagged")
    # contaminated rows are few: a size-checked broadcast keeps the (large)
    # training side from shuffling; beyond the bound a shuffled anti join
    clean = join_small(train, flagged.select(*train_keys).distinct(), train_keys, "left_anti")
    payload = [c for c in (test_payload or [test_text]) if c not in test_keys]
    lists = (hits.join(test.select(*test_keys, *payload), test_keys).groupBy("fp_l")
             .agg(F.array_sort(F.collect_list(F.struct(*test_keys, *payload))).alias("test_dups")))
    report = join_small(train.select(*train_keys, train_text), flagged, train_keys).join(lists, "fp_l")
    return clean, report.select(*train_keys, train_text, "test_dups")
