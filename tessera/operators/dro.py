"""Group-DRO domain weights from per-example losses.

Input rows: ``run_id, step, micro, domain, loss[, ref_loss]`` (one row per
training example; ``step`` is the optimiser step, ``micro`` the
accumulation micro-batch).  Only after the per-step group gradient (A7/A8)
does the data shrink to steps x domains; every later operator works on that
small table, and the SGD ascent itself needs no loop: with plain SGD the
log-weights are a running sum of ``lr * grad`` (window), and the weights a
per-step softmax (window).  Stateful optimisers (momentum, AdamW, Adagrad,
RMSprop) fold per run in ``applyInPandas`` over that small table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schedule import lr_factor
from ..session import cut_lineage, join_small

RUN_STEP = ["run_id", "step"]


def proxy_loss(rows: DataFrame, minus_ref: bool = False, normalize_with_ref: bool = False,
               p_norm: float = 1.0) -> DataFrame:
    """Per-example (excess) loss ``proxy``: optional ``loss - ref``; optional
    division by the reference loss p-normalised over the micro-batch
    (values below 1e-4 replaced by 1); clamped at 0."""
    proxy = F.col("loss")
    if minus_ref:
        proxy = proxy - F.col("ref_loss")
    if normalize_with_ref:
        ref = F.col("ref_loss")
        if p_norm > 0:
            # one row per micro-batch, from partial sums; a batch of any size
            # is never gathered
            batch = ["run_id", "step", "micro"]
            norms = rows.groupBy(*batch).agg(F.sum(F.pow(F.abs(ref), p_norm)).alias("_norm"))
            rows = join_small(rows, cut_lineage(norms, "batch_norms"), batch)
            ref = ref / F.greatest(F.pow(F.col("_norm"), 1.0 / p_norm), F.lit(1e-12))
        proxy = proxy / F.when(ref < 1e-4, F.lit(1.0)).otherwise(ref)
    return rows.withColumn("proxy", F.greatest(proxy, F.lit(0.0))).drop("_norm")


def group_gradient(rows: DataFrame, domains: list[str], accum_steps: int) -> DataFrame:
    """``run_id, step, domain, grad``: the mean proxy per (micro-batch,
    domain), summed over micro-batches and divided by ``accum_steps``.  Every
    step gets every domain (absent domains: 0), densified by exploding the
    configured domain list — never a join of all pairs."""
    per_micro = (rows.groupBy("run_id", "step", "micro", "domain")
                 .agg(F.avg("proxy").alias("group_loss")))
    per_step = (per_micro.groupBy("run_id", "step", "domain")
                .agg((F.sum("group_loss") / accum_steps).alias("grad")))
    per_step = cut_lineage(per_step, "step_gradients")
    grid = (per_step.select(*RUN_STEP).distinct()
            .withColumn("domain", F.explode(F.array(*[F.lit(d) for d in domains]))))
    return (grid.join(per_step, RUN_STEP + ["domain"], "left")
            .withColumn("grad", F.coalesce("grad", F.lit(0.0))))


def clip_gradient(g: DataFrame, max_norm: float, mode: str = "norm") -> DataFrame:
    """Norm clip ``g * min(1, max / (||g|| + 1e-6))`` over the domains of a
    step, or value clip to ``[-max, max]``."""
    if mode == "value":
        return g.withColumn("grad", F.greatest(F.least("grad", F.lit(max_norm)), F.lit(-max_norm)))
    if mode != "norm":
        return g
    w = Window.partitionBy(*RUN_STEP)
    norm = F.sqrt(F.sum(F.col("grad") * F.col("grad")).over(w))
    coef = F.least(F.lit(1.0), F.lit(max_norm) / (norm + 1e-6))
    return g.withColumn("grad", F.col("grad") * coef)


def with_lr(g: DataFrame, lr: float, schedule: str = "constant", warmup: int = 0,
            total: int = 1, min_lr_ratio: float = 0.0) -> DataFrame:
    """Rate used at optimiser step ``t`` (1-based) is ``lr * f(t - 1)``."""
    return g.withColumn("lr", F.lit(lr) * lr_factor(F.col("step") - 1, schedule, warmup,
                                                    total, min_lr_ratio))


def sgd_weights(g: DataFrame, init: dict[str, float]) -> DataFrame:
    """Plain SGD ascent on log-weights, closed form:
    ``log_alpha_t = log alpha_0 + sum_{s<=t} lr_s g_s``, ``alpha_t =
    softmax_d(log_alpha_t)``, running mean of alpha (initial weights
    excluded).  Input needs ``lr``; returns ``run_id, step, domain, grad,
    log_alpha, alpha, alpha_mean``."""
    init_col = F.create_map(*[x for d, w in init.items() for x in (F.lit(d), F.lit(math.log(w)))])
    by_dom = (Window.partitionBy("run_id", "domain").orderBy("step")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by_step = Window.partitionBy(*RUN_STEP)
    la = g.withColumn("log_alpha", init_col[F.col("domain")]
                      + F.sum(F.col("lr") * F.col("grad")).over(by_dom))
    shifted = F.exp(F.col("log_alpha") - F.max("log_alpha").over(by_step))
    a = la.withColumn("alpha", shifted / F.sum(shifted).over(by_step))
    return a.withColumn("alpha_mean", F.avg("alpha").over(by_dom))


def ema_weights(a: DataFrame, init: dict[str, float], beta: float = 0.1) -> DataFrame:
    """EMA ``e_t = e_{t-1} (1 - beta) + alpha_t beta`` from ``e_0 = alpha_0``,
    as an ordered fold over each (run, domain) step list — the list holds
    one entry per optimiser step, so it is small and bounded by the run
    length."""
    init_col = F.create_map(*[x for d, w in init.items() for x in (F.lit(d), F.lit(float(w)))])
    folded = (a.groupBy("run_id", "domain")
              .agg(F.array_sort(F.collect_list(F.struct("step", "alpha"))).alias("hist"))
              .withColumn("e0", init_col[F.col("domain")])
              .select("run_id", "domain", F.aggregate(
                  "hist",
                  F.struct(F.col("e0").alias("e"),
                           F.array().cast("array<struct<step:long,e:double>>").alias("out")),
                  lambda acc, x: F.struct(
                      (acc["e"] * (1 - beta) + x["alpha"] * beta).alias("e"),
                      F.array_append(acc["out"], F.struct(
                          x["step"].cast("long").alias("step"),
                          (acc["e"] * (1 - beta) + x["alpha"] * beta).alias("e"))).alias("out"))
              )["out"].alias("out")))
    ema = folded.select("run_id", "domain", F.inline("out")).withColumnRenamed("e", "alpha_ema")
    return a.join(ema.withColumn("step", F.col("step").cast(a.schema["step"].dataType)),
                  ["run_id", "domain", "step"])


OPTIMIZERS = ("sgd", "adamw", "adagrad", "rmsprop", "adafactor")
_OPT_SCHEMA = ("run_id string, step long, domain string, grad double, lr double, "
               "log_alpha double, alpha double")


def stateful_weights(g: DataFrame, init: dict[str, float], optimizer: str,
                     beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8,
                     weight_decay: float = 0.0, momentum: float = 0.0,
                     dampening: float = 0.0, rms_alpha: float = 0.99,
                     clip_threshold: float = 1.0, decay_rate: float = -0.8,
                     relog: bool = False) -> DataFrame:
    """Ascent with a stateful optimiser, folded per run over the small
    (step x domain) gradient table with ``applyInPandas``.  Update rules are
    the documented ones of the common deep-learning optimisers with
    ``maximize=True`` (Adafactor: its unfactored form for vectors, without
    parameter scaling or relative steps); unknown names are an error.
    ``relog`` sets the log-weights to the logarithm of the weights after
    every update, which matters under weight decay."""
    if optimizer not in OPTIMIZERS:
        raise ValueError(f"unsupported optimizer {optimizer}")
    domains = list(init)
    log0 = np.log(np.array([init[d] for d in domains], dtype=np.float64))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index="step", columns="domain", values="grad", aggfunc="first")
        grid = grid.reindex(columns=domains).fillna(0.0).sort_index()
        lrs = pdf.groupby("step")["lr"].first().reindex(grid.index).to_numpy()
        theta = log0.copy()
        buf = m = v = acc = sq = None
        out = []
        for t, (step, row) in enumerate(grid.iterrows(), start=1):
            grad = -row.to_numpy(dtype=np.float64)  # maximise: descend on -g
            lr = lrs[t - 1]
            if optimizer == "sgd":
                if weight_decay:
                    grad = grad + weight_decay * theta
                if momentum:
                    buf = grad.copy() if buf is None else momentum * buf + (1 - dampening) * grad
                    grad = buf
                theta = theta - lr * grad
            elif optimizer == "adamw":
                theta = theta * (1 - lr * weight_decay)
                m = np.zeros_like(theta) if m is None else m
                v = np.zeros_like(theta) if v is None else v
                m = beta1 * m + (1 - beta1) * grad
                v = beta2 * v + (1 - beta2) * grad * grad
                mh, vh = m / (1 - beta1 ** t), v / (1 - beta2 ** t)
                theta = theta - lr * mh / (np.sqrt(vh) + eps)
            elif optimizer == "adagrad":
                if weight_decay:
                    grad = grad + weight_decay * theta
                acc = np.zeros_like(theta) if acc is None else acc
                acc = acc + grad * grad
                theta = theta - lr * grad / (np.sqrt(acc) + 1e-10)
            elif optimizer == "adafactor":
                keep = 1 - t ** decay_rate
                sq = np.zeros_like(theta) if sq is None else sq
                sq = keep * sq + (1 - keep) * (grad * grad + 1e-30)
                change = grad / np.sqrt(sq)
                theta = theta - lr * change / max(1.0, float(np.sqrt((change ** 2).mean())) / clip_threshold)
            else:  # rmsprop
                if weight_decay:
                    grad = grad + weight_decay * theta
                sq = np.zeros_like(theta) if sq is None else sq
                sq = rms_alpha * sq + (1 - rms_alpha) * grad * grad
                theta = theta - lr * grad / (np.sqrt(sq) + eps)
            e = np.exp(theta - theta.max())
            alpha = e / e.sum()
            if relog:
                theta = np.log(alpha)
            for i, d in enumerate(domains):
                out.append((pdf["run_id"].iloc[0], int(step), d, float(row.iloc[i]), float(lr),
                            float(theta[i]), float(alpha[i])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _OPT_SCHEMA.split(", ")])

    return (g.select("run_id", F.col("step").cast("long"), "domain", "grad", "lr")
            .groupBy("run_id").applyInPandas(fold, _OPT_SCHEMA))


def robust_loss(rows: DataFrame, alpha: DataFrame) -> DataFrame:
    """Per micro-batch robust loss: each example weighted by its domain's
    current alpha (this step's update), weights normalised over the batch:
    ``sum(loss * alpha) / sum(alpha)`` of partial sums."""
    weights = cut_lineage(alpha.select("run_id", "step", "domain", "alpha"), "alpha")
    j = join_small(rows, weights, ["run_id", "step", "domain"])
    return j.groupBy("run_id", "step", "micro").agg(
        (F.sum(F.col("loss") * F.col("alpha")) / F.sum("alpha")).alias("robust_loss"))


def final_weights(a: DataFrame, kind_cols: dict[str, str]) -> DataFrame:
    """Weights at the last step of each run, long form
    ``run_id, kind, domain, weight``."""
    last = a.groupBy("run_id").agg(F.max("step").alias("step"))
    fin = a.join(last, RUN_STEP)
    pairs = ", ".join(f"'{k}', `{c}`" for k, c in kind_cols.items())
    return fin.selectExpr("run_id", "domain",
                          f"stack({len(kind_cols)}, {pairs}) AS (kind, weight)")


def with_epochs(w: DataFrame, sizes: DataFrame, keys=("run_id", "kind")) -> DataFrame:
    """``epoch = weight * total_size / size`` (total over the same table)."""
    j = w.join(sizes, "domain")
    tot = F.sum("size").over(Window.partitionBy(*keys))
    return j.withColumn("epoch", F.col("weight") * tot / F.col("size"))


def top_percent(w: DataFrame, sizes: DataFrame, percents=(20, 30, 40, 50, 60, 70, 80, 90),
                n_groups: int | None = None) -> DataFrame:
    """Top-X% selection per run: ``n = n_groups * pct // 100`` highest
    weights (ties: earlier domain id), weight ``1/n``, ids renumbered in rank
    order, epochs over the selected sizes.  ``w`` holds ``run_id, domain,
    domain_id, weight``."""
    n_col = F.lit(n_groups) if n_groups else F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    ranked = (w.withColumn("n_groups", n_col)
              .withColumn("pos", F.row_number().over(
                  Window.partitionBy("run_id").orderBy(F.col("weight").desc(), "domain_id")))
              .withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents]))))
    n = F.floor(F.col("n_groups") * F.col("percent") / 100)
    sel = ranked.where(F.col("pos") <= n).select(
        "run_id", "percent", "domain", (F.col("pos") - 1).alias("new_id"),
        (F.lit(1.0) / n).alias("weight"))
    return with_epochs(sel, sizes, keys=("run_id", "percent"))
