"""Learning-rate schedules and metric-key helpers as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_factor(step: Column, kind: str, warmup: int, total: int,
              min_lr_ratio: float = 0.0, num_cycles: float = 0.5) -> Column:
    """Multiplier of the base rate at (0-based) ``step``.

    * warm-up: ``step / max(1, warmup)`` while ``step < warmup``
    * past ``total``: ``min_lr_ratio``
    * linear: ``max(0, (total - step) / max(1, total - warmup))``,
      cosine: ``max(0, 0.5 (1 + cos(pi * cycles * 2 * progress)))``,
      both rescaled to ``[min_lr_ratio, 1]``
    * constant: 1 (warm-up ignored).
    """
    s = step.cast("double")
    if kind == "constant":
        return F.lit(1.0)
    if kind == "constant_with_warmup":
        return F.when(s < warmup, s / max(1, warmup)).otherwise(F.lit(1.0))
    if kind == "linear":
        decay = F.greatest(F.lit(0.0), (F.lit(float(total)) - s) / max(1, total - warmup))
    elif kind == "cosine":
        progress = (s - warmup) / max(1, total - warmup)
        decay = F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(math.pi * num_cycles * 2.0 * progress)))
    else:
        raise ValueError(f"unknown schedule {kind}")
    return (F.when(s < warmup, s / max(1, warmup))
            .when(s > total, F.lit(float(min_lr_ratio)))
            .otherwise(decay * (1 - min_lr_ratio) + min_lr_ratio))


def warmup_steps(total: int, warmup_steps_: int = 0, warmup_ratio: float = 0.0) -> int:
    """Explicit warm-up steps win; else ``ceil(total * ratio)``."""
    return warmup_steps_ if warmup_steps_ > 0 else math.ceil(total * warmup_ratio)


def total_steps(n_batches: int | None, accum: int, max_steps: int = -1) -> int:
    """``max_steps`` when set, else ``max(1, n_batches // accum)``; an
    unsized source without ``max_steps`` is an error."""
    if max_steps > 0:
        return max_steps
    if n_batches is None:
        raise ValueError("an unsized source needs max_steps")
    return max(1, n_batches // accum)


def rename_metric_key(key: Column) -> Column:
    """``eval_x -> eval/x``, ``test_x -> test/x``; keys holding the alpha
    sign, ``loss_per_group`` or ``channel`` unchanged; else ``train/x``."""
    return (F.when(key.startswith("eval_"), F.concat(F.lit("eval/"), F.substring(key, 6, 1 << 20)))
            .when(key.startswith("test_"), F.concat(F.lit("test/"), F.substring(key, 6, 1 << 20)))
            .when(key.contains("α") | key.contains("loss_per_group") | key.contains("channel"), key)
            .otherwise(F.concat(F.lit("train/"), key)))


def rename_accuracy_key(key: Column) -> Column:
    """``P@k -> precision_at_k``, ``@ -> _at_``, lower-cased."""
    return F.lower(F.replace(F.replace(key, F.lit("P@"), F.lit("precision_at_")),
                             F.lit("@"), F.lit("_at_")))
