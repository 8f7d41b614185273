"""Domain mixing over the driver's ``documents`` table: ``source`` is the
domain, ``doc_id`` the row id; weights are uniform over the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixing
from ..session import table
from .registry import register

SEED = 42
BATCH = 8
WORLD = 2


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("domain"),
                                                    F.col("doc_id").alias("id"))


def _uniform(spark, sf_dir):
    names = [r[0] for r in _rows(spark, sf_dir).select("domain").distinct().collect()]
    return {d: 1.0 for d in names}


def _out(df):
    return df.select("slot", "batch_id", "domain", "idx", F.col("id").alias("doc_id"))


_BASE_SQL = f"""
d AS (SELECT source AS domain, doc_id,
             row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}|' || source || '|' || doc_id::VARCHAR)) - 1 AS idx
      FROM documents),
sizes AS (SELECT domain, count(*) AS size FROM d GROUP BY domain),
names AS (SELECT domain, row_number() OVER (ORDER BY domain) AS i, count(*) OVER () AS n FROM sizes),
-- slots to generate: enough for every domain to be exhausted (the cut does
-- not depend on this bound once it is reached)
bound AS (SELECT (max(size) + {BATCH}) * (SELECT count(*) FROM sizes) * 16 AS nslots FROM sizes)"""


def _weighted_sql(draw_key: str, stopping_agg: str) -> str:
    return f"""
WITH {_BASE_SQL},
s AS (SELECT range AS slot, range // {BATCH} AS batch_id FROM range((SELECT nslots FROM bound))),
u AS (SELECT slot, batch_id,
             ('0x' || substr(md5('{SEED}|' || {draw_key}::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM s),
pick AS (SELECT u.slot, u.batch_id,
                (SELECT domain FROM names WHERE names.i = least(floor(u.u * names.n)::BIGINT + 1, names.n)) AS domain
         FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY slot) - 1 AS k FROM pick),
cut AS (SELECT {stopping_agg}(k.slot) AS last FROM k JOIN sizes USING (domain) WHERE k.k = sizes.size - 1)
SELECT k.slot, k.batch_id, k.domain, k.k % sizes.size AS idx, d.doc_id
FROM k JOIN sizes USING (domain) JOIN d ON d.domain = k.domain AND d.idx = k.k % sizes.size
WHERE k.slot <= (SELECT last FROM cut)
"""


@register("interleave_examples", ops=("M6", "M9", "M10", "A5", "A6"),
          oracle=_weighted_sql("slot", "min"))
def interleave_examples(spark, sf_dir):
    return _out(mixing.interleave(_rows(spark, sf_dir), _uniform(spark, sf_dir), SEED,
                                  "first_exhausted", BATCH, homogeneous=False))


@register("interleave_batches", ops=("M7", "M9", "M10"),
          oracle=_weighted_sql("batch_id", "max"))
def interleave_batches(spark, sf_dir):
    return _out(mixing.interleave(_rows(spark, sf_dir), _uniform(spark, sf_dir), SEED,
                                  "all_exhausted", BATCH, homogeneous=True))


def _skewed(spark, sf_dir):
    """Weights 0, 16, 8, 4, 2, 1, 16, ... by domain name: one domain is never
    drawn, a few take most slots."""
    names = sorted(r[0] for r in _rows(spark, sf_dir).select("domain").distinct().collect())
    return {d: float(0 if i == 0 else 1 << (4 - (i - 1) % 5)) for i, d in enumerate(names)}


def _skewed_sql(stopping_agg: str) -> str:
    return _weighted_sql("slot", stopping_agg).replace(
        "(SELECT domain FROM names WHERE names.i = least(floor(u.u * names.n)::BIGINT + 1, names.n))",
        "(SELECT min(domain) FROM cum WHERE cum.hi > u.u AND cum.lo <= u.u)").replace(
        "* 16 AS nslots FROM sizes)", """* 64 AS nslots FROM sizes),
weights AS (SELECT domain, CASE WHEN i = 1 THEN 0 ELSE 1 << (4 - (i - 2) % 5)::INT END AS w FROM names),
cum AS (SELECT domain, (sum(w) OVER (ORDER BY domain) - w)::DOUBLE / sum(w) OVER () AS lo,
               sum(w) OVER (ORDER BY domain)::DOUBLE / sum(w) OVER () AS hi FROM weights)""")


@register("interleave_skewed", ops=("M6", "M9"), oracle=_skewed_sql("min"))
def interleave_skewed(spark, sf_dir):
    return _out(mixing.interleave(_rows(spark, sf_dir), _skewed(spark, sf_dir), SEED, "first_exhausted", BATCH))


@register("interleave_skewed_all", ops=("M6", "M9"), oracle=_skewed_sql("max"))
def interleave_skewed_all(spark, sf_dir):
    return _out(mixing.interleave(_rows(spark, sf_dir), _skewed(spark, sf_dir), SEED, "all_exhausted", BATCH))


@register("round_robin", ops=("M8", "M9"), oracle=f"""
WITH {_BASE_SQL},
s AS (SELECT range AS slot, range // {BATCH} AS batch_id,
             range % (SELECT count(*) FROM sizes) + 1 AS i, range // (SELECT count(*) FROM sizes) AS k
      FROM range((SELECT max(size) * (SELECT count(*) FROM sizes) FROM sizes))),
k AS (SELECT s.slot, s.batch_id, names.domain, s.k FROM s JOIN names USING (i)),
cut AS (SELECT min(k.slot) AS last FROM k JOIN sizes USING (domain) WHERE k.k = sizes.size - 1)
SELECT k.slot, k.batch_id, k.domain, k.k % sizes.size AS idx, d.doc_id
FROM k JOIN sizes USING (domain) JOIN d ON d.domain = k.domain AND d.idx = k.k % sizes.size
WHERE k.slot <= (SELECT last FROM cut)
""")
def round_robin(spark, sf_dir):
    return _out(mixing.interleave(_rows(spark, sf_dir), None, SEED, "first_exhausted", BATCH))


@register("device_batches", ops=("M12", "M13"), oracle=_weighted_sql("batch_id", "max").replace(
    "SELECT k.slot, k.batch_id, k.domain, k.k % sizes.size AS idx, d.doc_id",
    f"""SELECT k.slot, k.batch_id, k.domain, d.doc_id, k.slot - k.batch_id * {BATCH} AS pos_in_batch,
       (k.slot - k.batch_id * {BATCH}) // {BATCH // WORLD} AS device""").replace(
    "WHERE k.slot <= (SELECT last FROM cut)",
    f"""WHERE k.slot <= (SELECT last FROM cut)
  AND k.batch_id IN (SELECT batch_id FROM k WHERE slot <= (SELECT last FROM cut)
                     GROUP BY batch_id HAVING count(*) = {BATCH})"""))
def device_batches(spark, sf_dir):
    stream = mixing.interleave(_rows(spark, sf_dir), _uniform(spark, sf_dir), SEED,
                               "all_exhausted", BATCH, homogeneous=True)
    full = mixing.split_devices(mixing.drop_partial_batches(stream, BATCH), BATCH, WORLD)
    return full.select("slot", "batch_id", "domain", F.col("id").alias("doc_id"),
                       "pos_in_batch", "device")


@register("buffered_shuffle", ops=("M10",))
def buffered_shuffle(spark, sf_dir):
    """Every document's place after the buffered shuffle of its domain."""
    return mixing.buffered_shuffle(_rows(spark, sf_dir), SEED).select("domain", F.col("id").alias("doc_id"), "idx", "moved")


@register("domain_report", ops=("A5", "A6", "T5"), oracle="""
SELECT source AS domain, count(*) AS size, 1.0 / (SELECT count(DISTINCT source) FROM documents) AS weight
FROM documents GROUP BY source
""")
def domain_report(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return mixing.domain_report(rows, _uniform(spark, sf_dir)).select("domain", "size", "weight")
