"""Weighted, seeded domain mixing as a slot table.

The reference streams examples from per-domain iterators; here the stream
is a table of *slots* (``spark.range``) and everything is computed with
joins and windows:

* every domain row gets a dense, seeded position ``idx`` (a shuffle of the
  domain by ``md5(seed|domain|id)``);
* every slot draws a domain from a hash-uniform number against the
  cumulative weights (per example, or per batch for homogeneous batches);
* the k-th slot of a domain takes row ``k mod size`` (wrap-around when a
  domain is re-used), joined on ``(domain, idx)`` — unique keys, no skew;
* the stopping rule cuts the slot table where the first / every domain has
  emitted its last row.

Dense ranks inside a hot group (one domain may hold a third of all rows or
slots) are computed bucket-wise: a local row number inside
(group, bucket) plus the running count of the earlier buckets, so no task
ever sorts a whole hot group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, join_small, number_rows

#: Domains are configuration; their sizes are held by the driver.
MAX_DOMAINS = 100_000
U_BITS = 52  # hash-uniforms use 13 hex digits of md5 (exact in a double)


def hash_uniform(seed: int | str, *cols: Column) -> Column:
    """Deterministic uniform in [0, 1) from ``md5(seed|c1|...)``."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit("|"), c.cast("string")]
    h = F.substring(F.md5(F.concat(*parts)), 1, 13)
    return F.conv(h, 16, 10).cast("double") / float(1 << U_BITS)


def dense_index(df: DataFrame, group: str, order: Column, bucket: Column,
                out: str = "idx") -> DataFrame:
    """0-based position of each row inside ``group`` by ``(bucket, order)``.
    ``bucket`` must be monotone with ``order`` (e.g. a prefix of the order
    key); hot groups are spread over their buckets."""
    d = df.withColumn("_b", bucket).withColumn("_o", order)
    local = d.withColumn("_l", F.row_number().over(
        Window.partitionBy(group, "_b").orderBy("_o")) - 1)
    counts = d.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.sum("_n").over(
        Window.partitionBy(group).orderBy("_b")
        .rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_off"])
    return (join_small(local, offs.select(group, "_b", "_off"), [group, "_b"])
            .withColumn(out, (F.col("_off") + F.col("_l")).cast("long"))
            .drop("_b", "_o", "_l", "_off"))


def shuffle_domains(rows: DataFrame, seed: int, domain: str = "domain",
                    id_col: str = "id", hex_buckets: int = 3) -> DataFrame:
    """Seeded per-domain shuffle: ``idx`` = position in ``md5(seed|domain|id)``
    order (M10).  Returns rows plus ``idx``."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(domain), F.col(id_col).cast("string")))
    return dense_index(rows, domain, key, F.substring(key, 1, hex_buckets))


def buffered_shuffle(rows: DataFrame, seed: int, domain: str = "domain", id_col: str = "id",
                     n_shards: int = 1024, buffer_size: int = 1000) -> DataFrame:
    """Seeded shuffle without a global sort (M10): every domain is dealt into
    ``n_shards`` shards by a hash, a shard is streamed in order of its ids
    through a buffer of ``buffer_size`` rows - a row that comes takes a random
    place, whose row goes out - and shards follow each other in a seeded
    order.  Returns the rows (null domains are a domain) plus

    * ``idx``, the dense position in the domain,
    * ``moved``, the places the buffer moved the row inside its shard
      (``1 - buffer_size`` at the least: a row can only come out early by what
      the buffer holds).

    The same rows and seed give the same order whatever the partitions, also
    for repeated ids.  A task holds the buffer and one Arrow batch; a shard is
    one task's stream, so ``n_shards`` bounds how far a domain spreads."""
    names = rows.columns
    taken = {"_shard", "_order", "_tie", "_pos", "_start", "idx", "moved"} & set(names)
    if taken or buffer_size < 1 or n_shards < 1:
        raise ValueError(f"columns taken: {sorted(taken)}" if taken else "buffer_size and n_shards start at 1")
    key = [F.lit(seed), F.coalesce(F.col(domain).cast("string"), F.lit("")), F.col(domain).isNull()]
    shard = F.pmod(F.xxhash64(*key, F.col(id_col)), F.lit(n_shards)).cast("int")
    plain = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    dealt = (rows.withColumn("_shard", shard).withColumn("_order", F.xxhash64(*key, "_shard"))
             .withColumn("_tie", F.xxhash64(*plain))
             .repartition(domain, "_shard").sortWithinPartitions(domain, "_shard", id_col, "_tie"))

    def run(batches):
        stream = None
        for batch in batches:
            at = batch.schema.get_field_index("_order")
            # a shard's order key tells it from its neighbour in the sort
            orders = batch.column(at).to_numpy()
            change = np.flatnonzero(orders[1:] != orders[:-1]) + 1
            for lo, hi in zip(np.append(0, change), np.append(change, len(orders))):
                if lo == hi:
                    continue
                if stream is None or stream.order != orders[lo]:
                    if stream is not None:
                        yield from stream.rest()
                    stream = _Buffer(int(orders[lo]), seed, buffer_size)
                yield from stream.add(batch.slice(lo, hi - lo))
        if stream is not None:
            yield from stream.rest()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    out = cut_lineage(dealt.mapInArrow(run, f"{kinds}, _pos long, moved long"), "buffered_shuffle")
    sizes = out.groupBy(domain, "_shard", "_order").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(domain).orderBy("_order", "_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(domain).alias("_domain"), F.col("_shard").alias("_s"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col(domain).eqNullSafe(F.col("_domain")) & (F.col("_shard") == F.col("_s"))
    return join_small(out, starts, same).withColumn("idx", F.col("_start") + F.col("_pos")).select(*names, "idx", "moved")


class _Buffer:
    """A shard's rows through a buffer of ``size`` rows."""

    def __init__(self, order: int, seed: int, size: int):
        self.order, self.size, self.held, self.out = order, size, None, 0
        self.random = np.random.default_rng((seed & (2**64 - 1), order & (2**64 - 1)))
        self.came = 0

    def _emit(self, rows: pa.Table, at: np.ndarray, places: np.ndarray):
        if not len(at):
            return
        pos = np.arange(self.out, self.out + len(at))
        self.out += len(at)
        yield from rows.take(pa.array(at)).append_column("_pos", pa.array(pos)) \
            .append_column("moved", pa.array(pos - places[at])).combine_chunks().to_batches()

    def add(self, batch: pa.RecordBatch):
        rows = pa.Table.from_batches([batch])
        places = np.arange(self.came, self.came + batch.num_rows)
        self.came += batch.num_rows
        if self.held is not None:
            rows, places = pa.concat_tables([self.held, rows]), np.append(self.places, places)
        slots = list(range(min(self.size, rows.num_rows)))
        # one draw a row that comes to a full buffer, so batches do not matter
        draws = (self.random.random(rows.num_rows - len(slots)) * self.size).astype(np.int64)
        gone = []
        for new, slot in enumerate(draws.tolist(), len(slots)):
            gone.append(slots[slot])
            slots[slot] = new
        yield from self._emit(rows, np.array(gone, np.int64), places)
        slots = np.array(slots, np.int64)
        self.held, self.places = rows.take(pa.array(slots)).combine_chunks(), places[slots]

    def rest(self):
        yield from self._emit(self.held, self.random.permutation(self.held.num_rows), self.places)


def cumulative(weights: dict[str, float]) -> list[tuple[str, float]]:
    """Normalised cumulative weights in domain-name order (last forced to 1);
    domains of weight 0 are never drawn and left out."""
    names = sorted(d for d in weights if weights[d] > 0)
    if not names or min(weights.values()) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    tot = sum(weights[d] for d in sorted(weights))
    acc, out = 0.0, []
    for d in names:
        acc += weights[d] / tot
        out.append((d, acc))
    out[-1] = (out[-1][0], 1.0)
    return out


def draw_domain(u: Column, weights: dict[str, float]) -> Column:
    """First domain whose cumulative weight exceeds ``u``."""
    cum = cumulative(weights)
    expr = F.lit(cum[-1][0])
    for d, c in reversed(cum[:-1]):
        expr = F.when(u < F.lit(c), F.lit(d)).otherwise(expr)
    return expr


def _slots(spark: SparkSession, n_slots: int, weights: dict[str, float], seed: int,
           batch_size: int, homogeneous: bool) -> DataFrame:
    s = spark.range(n_slots).withColumnRenamed("id", "slot")
    s = s.withColumn("batch_id", F.floor(F.col("slot") / batch_size).cast("long"))
    draw_key = F.col("batch_id") if homogeneous else F.col("slot")
    return s.withColumn("domain", draw_domain(hash_uniform(seed, draw_key), weights))


def _cut(slots: DataFrame, sizes: DataFrame, stopping: str, n_dom: int) -> DataFrame:
    """Slots up to and including the stopping slot, or ``None`` when the
    generated range is too short to decide."""
    ex = (join_small(slots, sizes, "domain").where(F.col("k") == F.col("size") - 1)
          .groupBy("domain").agg(F.min("slot").alias("s")))
    stats = ex.agg(F.min("s").alias("first"), F.max("s").alias("last"),
                   F.count(F.lit(1)).alias("n")).collect()[0]
    if stopping == "first_exhausted":
        return None if stats["first"] is None else slots.where(F.col("slot") <= stats["first"])
    if stats["n"] < n_dom:
        return None
    return slots.where(F.col("slot") <= stats["last"])


def interleave(rows: DataFrame, weights: dict[str, float] | None, seed: int = 42,
               stopping: str = "first_exhausted", batch_size: int = 1,
               homogeneous: bool = False, domain: str = "domain", id_col: str = "id",
               shuffle: bool | str = True, max_rounds: int = 12) -> DataFrame:
    """Mix per-domain rows into one seeded stream.

    ``weights=None`` is the unweighted round robin (slot ``k`` -> domain
    ``k mod n``, row ``k div n``).  Otherwise slots draw a domain by weight,
    per example or, with ``homogeneous``, per batch of ``batch_size``.
    ``stopping``: ``first_exhausted`` stops after the row that exhausts the
    first domain; ``all_exhausted`` after every domain with a positive
    weight was exhausted once (exhausted domains wrap around).  A domain of
    weight 0 is never drawn; a domain that ``weights`` does not name, and a
    name without rows, are errors.  Without ``shuffle`` rows keep the order
    of their ids; with ``shuffle="buffered"`` they go through
    :func:`buffered_shuffle`.  Returns ``slot, batch_id, domain, idx`` plus the row
    columns.
    """
    if stopping not in ("first_exhausted", "all_exhausted"):
        raise ValueError(f"unknown stopping strategy {stopping}")
    spark = rows.sparkSession
    full = rows.withColumnRenamed(domain, "domain")
    # positions are computed on (domain, id) only: the shuffle moves ids,
    # never whole rows
    keys = full.select("domain", id_col)
    if shuffle == "buffered":
        base = buffered_shuffle(keys, seed, "domain", id_col).drop("moved")
    elif shuffle:
        base = shuffle_domains(keys, seed, "domain", id_col)
    else:
        # one range sort of all ids: no task holds a whole domain
        placed = number_rows(keys, ["domain", id_col], "_place")
        starts = placed.groupBy("domain").agg(F.min("_place").alias("_start"))
        base = join_small(placed, starts, "domain").withColumn("idx", F.col("_place") - F.col("_start")) \
            .drop("_place", "_start")
    base = cut_lineage(base, "domain_positions")
    sizes = cut_lineage(base.groupBy("domain").agg(F.count(F.lit(1)).alias("size")), "domain_sizes")
    if sizes.count() > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    size_map = {r["domain"]: r["size"] for r in sizes.collect()}
    names = sorted(size_map)
    if weights is None:
        n = len(names)
        idx_of = F.create_map(*[x for i, d in enumerate(names) for x in (F.lit(i), F.lit(d))])
        slots = (spark.range(max(size_map.values()) * n).withColumnRenamed("id", "slot")
                 .withColumn("batch_id", F.floor(F.col("slot") / batch_size).cast("long"))
                 .withColumn("domain", idx_of[F.pmod(F.col("slot"), F.lit(n))])
                 .withColumn("k", F.floor(F.col("slot") / n).cast("long")))
        chosen = _cut(slots, sizes, stopping, n)
    else:
        if set(weights) != set(names):
            raise ValueError(f"weights and domains differ: {sorted(set(weights) ^ set(names))}")
        w = {d: float(weights[d]) for d in names}
        drawn = len(cumulative(w))
        total = sum(w.values())
        need = max(size_map[d] * total / w[d] for d in names if w[d] > 0)
        n_slots = int(math.ceil(need * 1.5)) + 10 * batch_size
        chosen = None
        for _ in range(max_rounds):
            slots = _slots(spark, n_slots, w, seed, batch_size, homogeneous)
            chunk = max(1024, n_slots // 4096)
            slots = dense_index(slots, "domain", F.col("slot"),
                                F.floor(F.col("slot") / chunk), out="k")
            chosen = _cut(cut_lineage(slots, "slots"), sizes, stopping, drawn)
            if chosen is not None:
                break
            n_slots *= 2
        if chosen is None:
            raise RuntimeError("stopping point not reached; raise max_rounds")
    picked = (join_small(chosen, sizes, "domain")
              .withColumn("idx", F.pmod(F.col("k"), F.col("size")))
              .select("slot", "batch_id", "domain", "idx"))
    # the slot table is bounded by the training length, the row table is
    # not: resolve slot -> id on the id table, then fetch the rows by a
    # size-checked broadcast of the (slot, id) pairs, so rows never shuffle
    slot_ids = picked.join(base, ["domain", "idx"])
    out = join_small(full, slot_ids, ["domain", id_col])
    return out.withColumnRenamed("domain", domain)


def drop_partial_batches(stream: DataFrame, batch_size: int) -> DataFrame:
    """Drop the last incomplete batch (M12)."""
    full = (stream.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == batch_size).select("batch_id"))
    return stream.join(full, "batch_id", "left_semi")


def split_devices(stream: DataFrame, batch_size: int, world_size: int) -> DataFrame:
    """Contiguous sharding of each batch over ``world_size`` ranks (M13):
    ``pos_in_batch``, ``device`` and ``pos_on_device``."""
    per = max(1, batch_size // world_size)
    pos = F.col("slot") - F.col("batch_id") * batch_size
    return (stream.withColumn("pos_in_batch", pos)
            .withColumn("device", F.floor(pos / per).cast("long"))
            .withColumn("pos_on_device", F.pmod(pos, F.lit(per))))


def domain_report(rows: DataFrame, weights: dict[str, float], domain: str = "domain") -> DataFrame:
    """Per domain: size and normalised weight (A5, A6); null where
    ``weights`` does not name the domain."""
    tot = sum(weights.values())
    wmap = F.create_map(*[x for d, v in weights.items() for x in (F.lit(d), F.lit(v / tot))])
    return (rows.groupBy(domain).agg(F.count(F.lit(1)).alias("size"))
            .withColumn("weight", wmap[F.col(domain)]))
