"""Group-DRO reweighting over the driver's ``events`` table read as a loss
log: ``event_type`` is the domain, the day (from 2024-01-01) the optimiser
step, the hour block of the day the accumulation micro-batch (4 per step),
``user_id % 3`` the run, ``value / 100`` the example loss and the ``k``
field of ``props`` / 100 the reference-model loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dro
from ..session import table
from .registry import register

ACCUM = 4
ETA = 0.02
MAX_NORM = 1.0
BETA = 0.1
PERCENTS = (20, 40, 60, 80)


def loss_rows(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ts = F.col("ts")
    return ev.select(
        F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run_id"),
        (F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")) + 1).cast("long").alias("step"),
        F.floor(F.hour(ts) / 6).cast("long").alias("micro"),
        F.col("event_id").alias("example_id"),
        F.col("event_type").alias("domain"),
        (F.col("value") / 100).alias("loss"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("ref_loss"))


def domains_of(spark, sf_dir) -> list[str]:
    """The domain list is configuration (bounded by the number of domains)."""
    rows = table(spark, sf_dir, "events").select("event_type").distinct().collect()
    return sorted(r[0] for r in rows)


def _init(domains):
    return {d: 1.0 / len(domains) for d in domains}


_LOSS_SQL = """
rows AS (
  SELECT 'run' || (user_id % 3)::VARCHAR AS run_id,
         date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS step,
         hour(ts) // 6 AS micro, event_id AS example_id, event_type AS domain,
         value / 100 AS loss, json_extract(props, '$.k')::DOUBLE / 100 AS ref_loss
  FROM events)"""

_GRAD_SQL = f"""
WITH {_LOSS_SQL},
prox AS (
  SELECT *, greatest((loss - ref_loss) / CASE WHEN rn < 1e-4 THEN 1.0 ELSE rn END, 0.0) AS proxy
  FROM (SELECT *, ref_loss / greatest(sum(abs(ref_loss)) OVER (PARTITION BY run_id, step, micro), 1e-12) AS rn
        FROM rows)),
pm AS (SELECT run_id, step, micro, domain, avg(proxy) AS gl FROM prox GROUP BY ALL),
ps AS (SELECT run_id, step, domain, sum(gl) / {ACCUM} AS grad FROM pm GROUP BY ALL),
grid AS (SELECT s.run_id, s.step, d.domain
         FROM (SELECT DISTINCT run_id, step FROM rows) s,
              (SELECT DISTINCT domain FROM rows) d),
g0 AS (SELECT grid.*, coalesce(ps.grad, 0.0) AS grad FROM grid LEFT JOIN ps USING (run_id, step, domain)),
g AS (SELECT run_id, step, domain,
             grad * least(1.0, {MAX_NORM} / (sqrt(sum(grad * grad) OVER (PARTITION BY run_id, step)) + 1e-6)) AS grad
      FROM g0)"""

_ALPHA_SQL = _GRAD_SQL + f""",
nd AS (SELECT count(DISTINCT domain) AS n FROM rows),
la AS (SELECT *, ln(1.0 / (SELECT n FROM nd)) + sum({ETA} * grad) OVER (
         PARTITION BY run_id, domain ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS log_alpha
       FROM g),
al AS (SELECT *, exp(log_alpha - max(log_alpha) OVER (PARTITION BY run_id, step)) AS e FROM la),
a AS (SELECT run_id, step, domain, grad, log_alpha,
             e / sum(e) OVER (PARTITION BY run_id, step) AS alpha FROM al),
am AS (SELECT *, avg(alpha) OVER (PARTITION BY run_id, domain ORDER BY step
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alpha_mean FROM a)"""


def _alpha(spark, sf_dir):
    rows = dro.proxy_loss(loss_rows(spark, sf_dir), minus_ref=True, normalize_with_ref=True)
    domains = domains_of(spark, sf_dir)
    g = dro.clip_gradient(dro.group_gradient(rows, domains, ACCUM), MAX_NORM)
    return dro.sgd_weights(dro.with_lr(g, ETA), _init(domains)), domains


def _r(c, n=9):
    return F.round(c, n).alias(c)


@register("group_loss", ops=("L5", "A7", "A8", "W3"), oracle=_GRAD_SQL + """
SELECT run_id, step, domain, round(grad, 9) AS grad FROM g
""")
def group_loss(spark, sf_dir):
    rows = dro.proxy_loss(loss_rows(spark, sf_dir), minus_ref=True, normalize_with_ref=True)
    g = dro.clip_gradient(dro.group_gradient(rows, domains_of(spark, sf_dir), ACCUM), MAX_NORM)
    return g.select("run_id", "step", "domain", _r("grad"))


@register("alpha_sgd", ops=("W4", "W6", "A9", "F25"), oracle=_ALPHA_SQL + """
SELECT run_id, step, domain, round(log_alpha, 9) AS log_alpha, round(alpha, 9) AS alpha,
       round(alpha_mean, 9) AS alpha_mean FROM am
""")
def alpha_sgd(spark, sf_dir):
    a, _ = _alpha(spark, sf_dir)
    return a.select("run_id", "step", "domain", _r("log_alpha"), _r("alpha"), _r("alpha_mean"))


@register("alpha_ema", ops=("A10",), oracle=_ALPHA_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ai AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY step) AS idx FROM am),
rec AS (
  SELECT run_id, domain, 0::BIGINT AS idx, 0::BIGINT AS step, 1.0 / (SELECT n FROM nd) AS ema
  FROM (SELECT DISTINCT run_id, domain FROM am)
  UNION ALL
  SELECT r.run_id, r.domain, ai.idx, ai.step, r.ema * (1 - {BETA}) + ai.alpha * {BETA}
  FROM rec r JOIN ai ON ai.run_id = r.run_id AND ai.domain = r.domain AND ai.idx = r.idx + 1)
SELECT run_id, step, domain, round(ema, 9) AS alpha_ema FROM rec WHERE idx > 0
""")
def alpha_ema(spark, sf_dir):
    a, domains = _alpha(spark, sf_dir)
    return dro.ema_weights(a, _init(domains), BETA).select("run_id", "step", "domain",
                                                           _r("alpha_ema"))


_SIZES_SQL = "sizes AS (SELECT domain, count(*) AS size FROM rows GROUP BY domain)"


@register("domain_epochs", ops=("F29",), oracle=_ALPHA_SQL + f""",
{_SIZES_SQL},
fin AS (SELECT am.* FROM am JOIN (SELECT run_id, max(step) AS step FROM am GROUP BY run_id) l USING (run_id, step)),
w AS (SELECT run_id, 'curr' AS kind, domain, alpha AS weight FROM fin
      UNION ALL SELECT run_id, 'mean', domain, alpha_mean FROM fin)
SELECT run_id, kind, domain, round(weight, 9) AS weight, size,
       round(weight * sum(size) OVER (PARTITION BY run_id, kind) / size, 9) AS epoch
FROM w JOIN sizes USING (domain)
""")
def domain_epochs(spark, sf_dir):
    a, _ = _alpha(spark, sf_dir)
    sizes = loss_rows(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("size"))
    w = dro.final_weights(a, {"curr": "alpha", "mean": "alpha_mean"})
    return dro.with_epochs(w, sizes).select("run_id", "kind", "domain", _r("weight"), "size",
                                            _r("epoch"))


@register("top_percent_domains", ops=("W7", "F29", "T5"), oracle=_ALPHA_SQL + f""",
{_SIZES_SQL},
ids AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS domain_id FROM (SELECT DISTINCT domain FROM rows)),
fin AS (SELECT am.* FROM am JOIN (SELECT run_id, max(step) AS step FROM am GROUP BY run_id) l USING (run_id, step)),
rk AS (SELECT fin.run_id, fin.domain, row_number() OVER (PARTITION BY fin.run_id ORDER BY fin.alpha DESC, ids.domain_id) AS pos,
              count(*) OVER (PARTITION BY fin.run_id) AS n_groups
       FROM fin JOIN ids USING (domain)),
pc AS (SELECT unnest([{', '.join(map(str, PERCENTS))}]) AS percent),
sel AS (SELECT run_id, percent, domain, pos - 1 AS new_id, 1.0 / floor(n_groups * percent / 100) AS weight
        FROM rk, pc WHERE pos <= floor(n_groups * percent / 100))
SELECT run_id, percent, domain, new_id, round(weight, 9) AS weight, size,
       round(weight * sum(size) OVER (PARTITION BY run_id, percent) / size, 9) AS epoch
FROM sel JOIN sizes USING (domain)
""")
def top_percent_domains(spark, sf_dir):
    a, domains = _alpha(spark, sf_dir)
    sizes = loss_rows(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("size"))
    ids = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(i))])
    last = a.groupBy("run_id").agg(F.max("step").alias("step"))
    fin = a.join(last, ["run_id", "step"]).select(
        "run_id", "domain", ids[F.col("domain")].alias("domain_id"), F.col("alpha").alias("weight"))
    t = dro.top_percent(fin, sizes, PERCENTS)
    return t.select("run_id", "percent", "domain", F.col("new_id").cast("long").alias("new_id"),
                    _r("weight"), "size", _r("epoch"))


@register("robust_loss", ops=("L6", "J9"), oracle=_ALPHA_SQL + """
SELECT r.run_id, r.step, r.micro,
       round(sum(r.loss * am.alpha) / sum(am.alpha), 9) AS robust_loss
FROM rows r JOIN am USING (run_id, step, domain)
GROUP BY r.run_id, r.step, r.micro
""")
def robust_loss(spark, sf_dir):
    a, _ = _alpha(spark, sf_dir)
    return dro.robust_loss(loss_rows(spark, sf_dir), a).select(
        "run_id", "step", "micro", _r("robust_loss"))


_LR = "({ETA} * CASE WHEN t - 1 < 3 THEN (t - 1) / 3.0 WHEN t - 1 > 30 THEN 0 ELSE greatest(0.0, (31 - t) / 27.0) END)" \
    .replace("{ETA}", str(ETA))


@register("alpha_adamw", ops=("W5", "W6"), oracle=_GRAD_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
gi AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY step) AS t FROM g),
nd AS (SELECT count(DISTINCT domain) AS n FROM rows),
rec AS (
  SELECT run_id, domain, 0::BIGINT AS t, 0::BIGINT AS step, ln(1.0 / (SELECT n FROM nd)) AS th,
         0.0::DOUBLE AS m, 0.0::DOUBLE AS v
  FROM (SELECT DISTINCT run_id, domain FROM g)
  UNION ALL
  SELECT run_id, domain, t, step,
         th - {_LR.replace('t - 1', 'step - 1').replace('31 - t', '31 - step')}
              * (m / (1 - pow(0.9, t))) / (sqrt(v / (1 - pow(0.999, t))) + 1e-8), m, v
  FROM (SELECT r.run_id, r.domain, gi.t, gi.step, r.th, 0.9 * r.m - 0.1 * gi.grad AS m,
               0.999 * r.v + 0.001 * gi.grad * gi.grad AS v
        FROM rec r JOIN gi ON gi.run_id = r.run_id AND gi.domain = r.domain AND gi.t = r.t + 1))
SELECT run_id, step, domain, round(th, 6) AS log_alpha,
       round(exp(th) / sum(exp(th)) OVER (PARTITION BY run_id, step), 6) AS alpha
FROM rec WHERE t > 0
""")
def alpha_adamw(spark, sf_dir):
    rows = dro.proxy_loss(loss_rows(spark, sf_dir), minus_ref=True, normalize_with_ref=True)
    domains = domains_of(spark, sf_dir)
    g = dro.with_lr(dro.clip_gradient(dro.group_gradient(rows, domains, ACCUM), MAX_NORM), ETA,
                    "linear", warmup=3, total=30)
    return dro.stateful_weights(g, _init(domains), "adamw").select(
        "run_id", "step", "domain", _r("log_alpha", 6), _r("alpha", 6))


@register("lr_schedule", ops=("F25", "W6", "W8"), oracle="""
WITH s AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE) AS t FROM events),
p AS (SELECT 3 AS w, (SELECT count(*) FROM s) AS n, 0.1 AS fl)
SELECT t + 1 AS step,
  round(CASE WHEN t < w THEN t / greatest(1, w)
             WHEN t > n THEN fl
             ELSE greatest(0.0, (n - t) / greatest(1, n - w)) * (1 - fl) + fl END, 9) AS linear,
  round(CASE WHEN t < w THEN t / greatest(1, w)
             WHEN t > n THEN fl
             ELSE greatest(0.0, 0.5 * (1 + cos(pi() * 0.5 * 2.0 * (t - w) / greatest(1, n - w)))) * (1 - fl) + fl END, 9) AS cosine
FROM s, p
""")
def lr_schedule(spark, sf_dir):
    from ..functions.schedule import lr_factor, total_steps
    ev = table(spark, sf_dir, "events")
    steps = ev.select(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t")).distinct()
    n = total_steps(steps.count() * ACCUM, ACCUM)  # micro-batches to optimiser steps (W8)
    return steps.select(
        (F.col("t") + 1).cast("long").alias("step"),
        F.round(lr_factor(F.col("t"), "linear", 3, n, 0.1), 9).alias("linear"),
        F.round(lr_factor(F.col("t"), "cosine", 3, n, 0.1), 9).alias("cosine"))
