import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import mixing


def _simple(ids, order, seed, size):
    """The buffer, row by row."""
    random = np.random.default_rng((seed, order & (2**64 - 1)))
    held, out = [], []
    for i in ids:
        if len(held) < size:
            held.append(i)
            continue
        slot = int(random.random() * size)
        out.append(held[slot])
        held[slot] = i
    return out + [held[i] for i in random.permutation(len(held))]


@pytest.mark.parametrize("parts", [1, 7])
def test_buffered_shuffle_equals_the_row_by_row_buffer(spark, parts):
    """One shard a domain, so the order is the buffer's alone; a domain with
    most rows, one row, and without a name."""
    rows = spark.range(25_000).select("id", F.when(F.col("id") == 9, "lone").when(F.col("id") % 5 > 0, "hot")
                                      .when(F.col("id") % 10 == 0, "b").alias("domain")).repartition(parts)
    got = mixing.buffered_shuffle(rows, 7, n_shards=1, buffer_size=100).collect()
    orders = {r.domain: r.o for r in rows.select("domain").distinct().select("domain", F.xxhash64(
        F.lit(7), F.coalesce("domain", F.lit("")), F.col("domain").isNull(), F.lit(0)).alias("o")).collect()}
    assert len(got) == 25_000 and set(orders) == {"hot", "b", "lone", None}
    for domain, order in orders.items():
        mine = sorted((r for r in got if r.domain == domain), key=lambda r: r.idx)
        ids = sorted(r.id for r in mine)
        assert [r.idx for r in mine] == list(range(len(ids)))
        assert [r.id for r in mine] == _simple(ids, order, 7, 100)
        place = {i: p for p, i in enumerate(ids)}
        assert all(r.moved == r.idx - place[r.id] and r.moved > -100 for r in mine)
        assert sum(r.moved == 0 for r in mine) < len(mine) / 20 + 2


def test_buffered_shuffle_is_the_same_on_every_partitioning(spark):
    rows = spark.range(6000).select(F.floor(F.col("id") / 2).alias("id"), (F.col("id") % 3).cast("string").alias("domain"),
                                    F.concat(F.lit("text "), F.col("id")).alias("text"))
    a, b = (sorted(map(tuple, mixing.buffered_shuffle(rows.repartition(n), 3, n_shards=16, buffer_size=50).collect()))
            for n in (2, 9))
    assert a == b and len(a) == 6000
    assert sorted(r[2] for r in a) == sorted(f"text {i}" for i in range(6000))
    for d in "012":
        assert sorted(r[3] for r in a if r[1] == d) == list(range(2000))
    other = mixing.buffered_shuffle(rows, 4, n_shards=16, buffer_size=50).collect()
    assert sorted(map(tuple, other)) != a


def test_buffered_shuffle_of_nothing_and_clashing_names(spark):
    rows = spark.createDataFrame([], "id long, domain string")
    assert mixing.buffered_shuffle(rows, 1).collect() == []
    with pytest.raises(ValueError):
        mixing.buffered_shuffle(rows.withColumn("idx", F.lit(1)), 1)


def test_interleave_over_the_buffered_shuffle(spark):
    """All rows come out, slots by weight as before, another order."""
    rows = spark.range(400).select("id", F.when(F.col("id") < 300, "a").otherwise("b").alias("domain"))
    plain, buffered = ({r.slot: (r.domain, r.idx, r.id) for r in mixing.interleave(
        rows, {"a": 1.0, "b": 1.0}, 5, "all_exhausted", shuffle=s).collect()} for s in (True, "buffered"))
    assert {s: x[:2] for s, x in plain.items()} == {s: x[:2] for s, x in buffered.items()}
    assert {x[2] for x in buffered.values()} == set(range(400)) and plain != buffered
