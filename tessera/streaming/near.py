"""Near-duplicates inside a stream: arriving rows against those that arrived
before them.

Fingerprints within ``k`` bits share one of the block keys of
:func:`tessera.functions.simhash.block_keys`.  The stream is keyed by a hash
of the block key (``buckets`` of them, since a call of the state function
costs more than the few rows of one key); the state holds, for each block key,
the distinct fingerprints seen under it, with the first row of each and the
latest event time.  A micro-batch rewrites the buckets it touches, so
``buckets`` should grow with the fingerprints of the horizon.  A new fingerprint is
compared with that list only, and a pair is reported by the first key that
both share, so every pair comes out once and no second stateful step is
needed.

Copies never reach a hot key one by one: rows of an Arrow batch that share a
fingerprint are linked to the batch's first one where they are read, and that
row alone goes on.  The state grows with the distinct fingerprints of the
horizon (15 entries each at the default of six blocks), not with the rows;
with a long horizon use the RocksDB state store, which keeps it on disk.
"""

from __future__ import annotations

import re
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.simhash import block_bounds, block_keys, clean_query, simhash64
from .jobs import event_time

# Keys over which finished links are spread on their way past the state.
LINK_KEYS = 4096

# Groups of block keys that share a state; fixed for the life of a checkpoint.
BUCKETS = 1 << 14

_SEEN = "combos array<int>, keys array<long>, fps array<long>, ids array<{id}>, last array<long>"
_LINKS = "id {id}, earlier_id {id}, fp long, earlier_fp long, distance int"


def _first_combo(k: int, n_blocks: int):
    """Function of two fingerprints within ``k`` bits: number of the first
    block combination on which they agree.  Combinations are numbered in
    lexicographic order, so it is the one of the first equal blocks."""
    number = {c: i for i, c in enumerate(combinations(range(n_blocks), n_blocks - k))}
    masks = [((1 << w) - 1) << s for s, w in block_bounds(n_blocks)]

    def first(a: int, b: int) -> int:
        return number[tuple([i for i, m in enumerate(masks) if not (a ^ b) & m][:n_blocks - k])]
    return first


def near_duplicates_stream(stream: DataFrame, id_col: str = "id", text_col: str = "text", ts: str = "ts",
                           watermark: str = "1 hour", horizon: float = 7 * 86_400.0, k: int = 2,
                           n_blocks: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Links between the rows of a stream whose texts' SimHashes are at most
    ``k`` bits apart: ``id, earlier_id, fp, earlier_fp, distance``.

    * Rows of one fingerprint: each but the first gets one link with distance
      0 to an earlier row of it.
    * Two different fingerprints within ``k`` bits: one link, from the first
      row of the one that came later to the first row of the other.

    The links of a stream say what :func:`tessera.operators.dedup.near_duplicate_stats`
    says of the same rows at once.  Of rows in one micro-batch the one with
    the smaller (``ts``, id) is earlier.  Rows whose event times lie within
    ``horizon`` seconds always meet; a fingerprint that was not seen for
    ``horizon`` seconds before the watermark is forgotten, and a bucket
    without fingerprints leaves the state.  Rows later than the watermark are
    dropped by Spark.  Null texts count as empty, and all empty texts are
    copies of each other; rows without an id or an event time link with
    nothing.  Columns other than the three named are not read.

    The result is a streaming DataFrame in append mode; a replayed micro-batch
    gives the same links from the state of the batch before it."""
    n_blocks = n_blocks or k + 4
    horizon_ms = int(horizon * 1000)
    kind = re.sub(r"\s", "", stream.schema[id_col].dataType.simpleString())
    if not isinstance(stream.schema[id_col].dataType, (T.LongType, T.IntegerType, T.StringType)):
        raise ValueError(f"ids of type {kind} cannot be ordered")
    columns = ["id", "earlier_id", "fp", "earlier_fp", "distance"]

    def collapse(frames):
        """The first row of each fingerprint, and the links of the others."""
        for rows in frames:
            rows = rows.sort_values(["at", "id"], kind="stable")
            firsts = rows.drop_duplicates("fp")
            rest = rows[~rows.index.isin(firsts.index)]
            to = rest["fp"].map(firsts.set_index("fp")["id"])
            # a copy that came later keeps its fingerprint in the state
            last = firsts["fp"].map(rows.groupby("fp")["at"].max())
            yield pd.concat([firsts.assign(earlier=firsts["id"], until=last, copy=False),
                             rest.assign(earlier=to, until=rest["at"], copy=True)])[
                ["id", "fp", "at", "until", "ts", "earlier", "copy"]]

    first_combo = _first_combo(k, n_blocks)

    def meet(key, frames, state):
        if key[0] < 0:  # links found where the rows were read
            for f in frames:
                yield pd.DataFrame({"id": f["id"], "earlier_id": f["earlier"], "fp": f["fp"],
                                    "earlier_fp": f["fp"], "distance": 0})[columns]
            return
        seen: dict[tuple, dict[int, list]] = {}
        if state.exists:
            for combo, block, f, i, last in zip(*state.get):
                seen.setdefault((combo, block), {})[f] = [i, last]
        out = []
        if not state.hasTimedOut:
            rows = [r for f in frames for r in zip(*(f[c].tolist() for c in ("at", "id", "fp", "until", "combo", "key")))]
            for at, i, f, until, combo, block in sorted(rows):
                have = seen.setdefault((combo, block), {})
                known = have.get(f)
                if known is not None:
                    known[1] = max(known[1], until)
                    if combo == 0:  # copies agree on the first combination
                        out.append((i, known[0], f, f, 0))
                    continue
                for g, (j, _) in have.items():
                    apart = ((f ^ g) & (2**64 - 1)).bit_count()
                    if apart <= k and first_combo(f, g) == combo:
                        out.append((i, j, f, g, apart))
                have[f] = [i, until]
        now = state.getCurrentWatermarkMs()
        keep = [(*at, f, i, last) for at, have in seen.items() for f, (i, last) in have.items() if last + horizon_ms >= now]
        if keep:
            state.update(tuple(list(x) for x in zip(*keep)))
            state.setTimeoutTimestamp(max(now, min(x[4] for x in keep) + horizon_ms) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=columns)

    rows = stream.select(F.col(id_col).alias("id"), F.col(ts).cast("timestamp").alias("ts"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .where(F.col("id").isNotNull() & F.col("ts").isNotNull())
    marked = rows.select("id", simhash64(clean_query(F.col("text"))).alias("fp"),
                         F.unix_millis("ts").alias("at"), "ts")
    collapsed = event_time(marked.mapInPandas(
        collapse, f"id {kind}, fp long, at long, until long, ts timestamp, earlier {kind}, copy boolean"), "ts", watermark)
    apart = F.array(F.struct(F.lit(-1).alias("combo"), F.xxhash64("id").alias("key")))
    keyed = collapsed.withColumn("bk", F.explode(
        F.when(F.col("copy"), apart).otherwise(block_keys(F.col("fp"), k, n_blocks))))
    bucket = F.when(F.col("copy"), -1 - F.pmod("bk.key", F.lit(LINK_KEYS))).otherwise(F.pmod(F.xxhash64("bk"), F.lit(buckets)))
    return (keyed.select("id", "fp", "at", "until", "ts", "earlier", F.col("bk.combo").alias("combo"),
                         F.col("bk.key").alias("key"), bucket.alias("bucket"))
            .groupBy("bucket")
            .applyInPandasWithState(meet, _LINKS.format(id=kind), _SEEN.format(id=kind), "append",
                                    GroupStateTimeout.EventTimeTimeout))
