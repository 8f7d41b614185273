import random

from pyspark.sql import functions as F

from tessera.functions.simhash import block_bounds, fingerprint_text
from tessera.operators import dedup


def test_fingerprint_edges():
    # empty text hashes the single empty shingle; underscores/punctuation are dropped
    assert fingerprint_text("") == fingerprint_text("!!! ...")
    assert fingerprint_text("ab") == fingerprint_text("A b")
    assert fingerprint_text(None) is None
    # Chinese text: separators do not change the fingerprint
    assert fingerprint_text("我爱北京天安门") == fingerprint_text("我 爱 北京 天安门")


def test_block_bounds_cover_64():
    for n in (3, 6, 7):
        b = block_bounds(n)
        assert sum(w for _, w in b) == 64 and b[0][0] == 0


def test_block_join_equals_brute_force(spark):
    # random fingerprints plus planted 0/1/2/3-bit neighbours
    rnd = random.Random(7)
    fps = [rnd.getrandbits(64) for _ in range(300)]
    planted = []
    for f in fps[:100]:
        for nbits in (0, 1, 2, 3):
            g = f
            for b in rnd.sample(range(64), nbits):
                g ^= 1 << b
            planted.append(g)
    allfp = sorted({(x - (1 << 64)) if x >= (1 << 63) else x for x in fps + planted})
    df = spark.createDataFrame([(x,) for x in allfp], "fp long")
    for nb in (3, 6):
        got = {(r.fp_l, r.fp_r) for r in
               dedup.near_fingerprint_pairs(df, df, k=2, n_blocks=nb).collect()}
        want = {(a, b) for a in allfp for b in allfp if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2}
        assert got == want


def test_near_dup_stats_and_decontaminate(spark):
    rows = [(1, "the quick brown fox jumps"), (2, "the quick brown fox jumps"),
            (3, "the_quick brown fox jumps!"), (4, "something else entirely here"),
            (5, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    st = {r.id: r for r in dedup.near_duplicate_stats(df, "id").collect()}
    assert st[1].n_dups == 2 and st[1].rep_id == 1 and st[3].rep_id == 1
    assert st[4].n_dups == 0 and st[4].rep_id == 4
    test = spark.createDataFrame([(10, "The quick brown fox jumps"), (11, "___")],
                                 "item_id long, text string")
    clean, report = dedup.decontaminate(df, test, ["id"], ["item_id"], "text", "text")
    assert sorted(r.id for r in clean.collect()) == [4, 5]
    rep = {r.id: [d.item_id for d in r.test_dups] for r in report.collect()}
    assert rep == {1: [10], 2: [10], 3: [10]}


def test_block_keys_of_one_table_are_never_broadcast(spark):
    """Fifteen keys a fingerprint, which the plan's size estimate leaves out."""
    fps = spark.range(1000).select((F.col("id") * 7).alias("fp"))
    plan = dedup.near_fingerprint_pairs(fps, fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    few = spark.range(3).select(F.col("id").alias("fp"))
    assert "BroadcastHashJoin" in dedup.near_fingerprint_pairs(fps, few)._jdf.queryExecution().executedPlan().toString()


def test_kept_rows_join_block_keys_without_a_broadcast(spark, monkeypatch):
    seen = []
    pairs = dedup.near_fingerprint_pairs
    monkeypatch.setattr(dedup, "near_fingerprint_pairs", lambda *a, **kw: seen.append(pairs(*a, **kw)) or seen[-1])
    df = spark.createDataFrame([(3, "the quick brown fox jumps"), (1, "the_quick brown fox jumps!"),
                                (2, "something else entirely here"), (4, None)], "id long, text string")
    assert sorted(r.id for r in dedup.dedup_keep(df, "id").collect()) == [1, 2]
    assert "BroadcastHashJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_rows_fingerprints_and_kept_ids_are_never_broadcast(spark):
    """These tables grow with the rows, however few bytes their files take."""
    df = spark.createDataFrame([(3, "the quick brown fox jumps"), (1, "the_quick brown fox jumps!"),
                                (2, "something else entirely here"), (2, "something else entirely here"),
                                (4, None), (None, "a third text of its own")], "id long, text string")
    stats, kept = dedup.near_duplicate_stats(df, "id").select("id", "n_dups", "rep_id"), dedup.dedup_keep(df, "id")
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in stats.collect()), key=key) == sorted(
        [(1, 1, 1), (3, 1, 1), (2, 1, 2), (2, 1, 2), (None, 0, None)], key=key)
    assert sorted(r.id for r in kept.collect()) == [1, 2, 2]
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (stats, kept)):
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
