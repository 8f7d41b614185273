"""Metric-log rollup over ``events`` read as a loss log (``event_type`` =
domain, ``value / 100`` = loss): per day and domain, the mean of all values,
under its logging key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming.jobs import loss_rollup
from .registry import register


@register("log_rollup", ops=("A11", "F26", "F28"), oracle="""
SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       event_type AS domain, 'train/' || event_type || '_loss' AS key,
       round(avg(value / 100), 6) AS value, count(*) AS n
FROM events
GROUP BY ALL
""")
def log_rollup(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("domain"), (F.col("value") / 100).alias("loss"))
    out = loss_rollup(ev, "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "domain", "key", "value", "n")
