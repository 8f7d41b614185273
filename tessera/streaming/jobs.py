"""Structured Streaming jobs.

* ST1 ``decontaminate_stream``: arriving JSON-lines training files are
  fingerprinted and probed against a static test-set block index; each
  micro-batch writes clean rows and the duplicates report (``foreachBatch``).
* ST2 ``loss_rollup_stream``: per-domain loss means over event-time windows
  with a watermark for late rows (the batch form is :func:`loss_rollup`).
* ST3 ``online_weights_stream``: group weights updated per optimiser step
  with ``applyInPandasWithState`` keyed by run; the state is the small
  per-run vector of log-weights, running mean and EMA; event-time timers
  close steps that stay incomplete and end runs.
* ST1 among arriving rows: :mod:`tessera.streaming.near`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.schedule import rename_metric_key
from ..operators import dedup
from ..session import stage_scope


def event_time(stream: DataFrame, ts: str, watermark: str) -> DataFrame:
    """``stream`` with a watermark on ``ts``.  Event-time watermarks need an
    instant type; wall-clock values are read in the session time zone."""
    if dict(stream.dtypes)[ts] == "timestamp_ntz":
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, watermark)


# ------------------------------------------------------------------ ST1

def decontaminate_stream(stream: DataFrame, test: DataFrame, clean_path: str, report_path: str,
                         checkpoint: str, train_keys: list[str], test_keys: list[str],
                         train_text: str = "query", test_text: str = "query", k: int = 2,
                         trigger_once: bool = False):
    """Start the incremental decontamination query.  ``test`` is static (the
    test queries); each micro-batch is split with the batch operator and
    written to its own ``_epoch=N`` folder of the two Parquet sinks.  A replay
    of a micro-batch replaces what the interrupted try left, and the batch's
    intermediate tables are dropped.  Returns the StreamingQuery."""

    # the static side is fingerprinted once, not per micro-batch
    test_fps = dedup.test_fingerprints(test, test_keys, test_text)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        with stage_scope(batch.sparkSession):
            clean, report = dedup.decontaminate(batch, test, train_keys, test_keys,
                                                train_text, test_text, k, test_fps=test_fps)
            clean.write.mode("overwrite").parquet(f"{clean_path}/_epoch={epoch_id}")
            report.write.mode("overwrite").parquet(f"{report_path}/_epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


# ------------------------------------------------------------------ ST2

def loss_rollup(rows: DataFrame, window: str = "1 day", ts: str = "ts",
                domain: str = "domain", value: str = "loss") -> DataFrame:
    """Per (window, domain): mean loss and count over all rows, the metric
    key renamed to its logging name and rounded to 6 digits unless the key
    holds ``lr`` (A11, F26, F28)."""
    key = rename_metric_key(F.concat(F.col(domain), F.lit("_loss")))
    g = (rows.groupBy(F.window(ts, window).alias("w"), F.col(domain))
         .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")))
    return g.select(F.col("w.start").alias("window_start"), F.col(domain).alias("domain"),
                    key.alias("key"),
                    F.when(key.contains("lr"), F.col("mean")).otherwise(F.round("mean", 6)).alias("value"),
                    "n")


def loss_rollup_stream(stream: DataFrame, window: str = "1 day", watermark: str = "1 day",
                       ts: str = "ts", domain: str = "domain", value: str = "loss") -> DataFrame:
    """Streaming form of :func:`loss_rollup`: rows later than the watermark
    are dropped; a window is emitted once the watermark passes it."""
    return loss_rollup(event_time(stream, ts, watermark), window, ts, domain, value)


# ------------------------------------------------------------------ ST3

WEIGHT_STATE = ("log_alpha array<double>, mean array<double>, ema array<double>, count long, last_step long, "
                "open_steps array<long>, open_domains array<string>, open_grads array<double>, "
                "open_times array<long>, seen long")
WEIGHT_OUT = ("run_id string, step long, domain string, log_alpha double, alpha double, "
              "alpha_mean double, alpha_ema double")


def online_weights_stream(grads: DataFrame, domains: list[str], lr: float, beta: float = 0.1,
                          ts: str | None = None, watermark: str = "10 minutes",
                          patience: float = 600.0, idle: float = 86_400.0) -> DataFrame:
    """Per-run online SGD ascent of the group weights over a stream of
    per-step group gradients ``run_id, step, domain, grad`` (one row per
    step and domain, e.g. from :func:`tessera.operators.dro.group_gradient`
    run per micro-batch).

    A step is applied once all its domains have arrived, in whichever
    micro-batches they come; until then its rows wait in the state, and so
    do later steps, because a run's steps are applied in order.  A row that
    repeats a domain of a waiting step, or belongs to an applied step, is a
    replay and is ignored.  Rows without a run, a step or a domain, and
    domains not in ``domains``, are ignored; a null gradient is 0.

    With ``ts`` (an event-time column) nothing waits for ever.  When the
    watermark, which follows the event times by ``watermark``, is
    ``patience`` seconds past a waiting step's first row, the step is closed:
    a domain that has not reported had no example in it, so its gradient is
    0.  Rows that come for it later are ignored as those of any applied step;
    rows older than the watermark are dropped before they get here.  A run
    without rows for ``idle`` seconds of event time is over: what waits is
    applied and its state is removed; a run that reports again after that
    starts anew.  A run's state holds at most the rows of ``patience`` plus
    the watermark's delay, whatever domains are missing.  Without ``ts`` an
    incomplete step waits until it is complete."""
    n = len(domains)
    pos = {d: i for i, d in enumerate(domains)}
    init = math.log(1.0 / n)
    wait_ms, idle_ms = int(patience * 1000), int(idle * 1000)

    def update(key, pdfs, state):
        run_id = key[0]
        waiting: dict[int, dict[str, tuple[float, int]]] = {}
        if state.exists:
            la, mean, ema, count, last, steps, names, values, times, seen = state.get
            la, mean, ema = np.array(la), np.array(mean), np.array(ema)
            for s, d, v, t in zip(steps, names, values, times):
                waiting.setdefault(s, {})[d] = (v, t)
        else:
            la = np.full(n, init)
            mean = np.full(n, 1.0 / n)
            ema = np.full(n, 1.0 / n)
            count, last, seen = 0, -1, 0
        if not state.hasTimedOut:
            for pdf in pdfs:
                for s, d, v, t in zip(pdf["step"].tolist(), pdf["domain"].tolist(), pdf["grad"].tolist(),
                                      pdf["_ms"].tolist()):
                    seen = max(seen, t)
                    if s > last:
                        waiting.setdefault(s, {}).setdefault(d, (v, t))
        now = state.getCurrentWatermarkMs() if ts else 0

        def due(s: int) -> int:
            return min(t for _, t in waiting[s].values()) + wait_ms

        over = bool(ts) and now >= seen + idle_ms
        out = []
        for s in sorted(waiting):
            if len(waiting[s]) < n and not (ts and (over or now >= due(s))):
                break
            got = waiting.pop(s)
            grad = np.zeros(n)
            for d, (v, _) in got.items():
                grad[pos[d]] = v
            la = la + lr * grad
            e = np.exp(la - la.max())
            alpha = e / e.sum()
            mean = (mean * count + alpha) / (count + 1)
            ema = ema * (1 - beta) + alpha * beta
            count += 1
            last = int(s)
            for d, i in pos.items():
                out.append((run_id, last, d, la[i], alpha[i], mean[i], ema[i]))
        if over:
            state.remove()
        else:
            held = [(s, d, *waiting[s][d]) for s in sorted(waiting) for d in waiting[s]]
            state.update((la.tolist(), mean.tolist(), ema.tolist(), count, last, [h[0] for h in held],
                          [h[1] for h in held], [h[2] for h in held], [h[3] for h in held], seen))
            if ts:
                state.setTimeoutTimestamp(max(now + 1, min([seen + idle_ms] + [due(s) for s in sorted(waiting)[:1]])))
        yield pd.DataFrame(out, columns=["run_id", "step", "domain", "log_alpha", "alpha",
                                         "alpha_mean", "alpha_ema"])

    rows = grads.where(F.col("run_id").isNotNull() & F.col("step").isNotNull() & F.col("domain").isin(domains)) \
        .withColumn("grad", F.coalesce("grad", F.lit(0.0)))
    if ts is None:
        rows = rows.withColumn("_ms", F.lit(0).cast("long"))
    else:
        # rows without an event time could never be closed
        rows = event_time(rows.where(F.col(ts).isNotNull()), ts, watermark) \
            .withColumn("_ms", F.unix_millis(F.col(ts)))
    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return rows.groupBy("run_id").applyInPandasWithState(update, WEIGHT_OUT, WEIGHT_STATE, "append", timeout)
