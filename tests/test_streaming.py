import datetime
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.functions.simhash import fingerprint_text
from tessera.operators import dro
from tessera.plans import reweighting
from tessera.streaming import jobs, near

from conftest import SF001


def _tmp():
    return tempfile.mkdtemp(prefix="tessera-stream-", dir="/tmp")


def test_loss_rollup_stream_matches_batch(spark):
    d = _tmp()
    ev = spark.read.parquet(f"{SF001}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("domain"),
        (F.col("value") / 100).alias("loss"))
    # three files in event-time order, one per micro-batch: no row is late
    for lo, hi in (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-03-01")):
        part = ev.where((F.col("ts") >= F.lit(lo).cast("timestamp")) & (F.col("ts") < F.lit(hi).cast("timestamp")))
        part.coalesce(1).write.mode("append").parquet(os.path.join(d, "in"))
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(d, "in")))
    q = (jobs.loss_rollup_stream(stream, "1 day", "1 hour").writeStream
         .outputMode("append").format("memory").queryName("rollup_t")
         .option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start, r.domain): (r.value, r.n) for r in spark.table("rollup_t").collect()}
    want = {(r.window_start, r.domain): (r.value, r.n) for r in jobs.loss_rollup(ev).collect()}
    # append mode emits the windows the watermark has closed, each once
    assert len(got) >= len(want) - 2 * 5 and len(got) == spark.table("rollup_t").count()
    assert all(got[k] == want[k] for k in got)


def test_online_weights_match_closed_form(spark):
    d = _tmp()
    rows = dro.proxy_loss(reweighting.loss_rows(spark, SF001), True, True)
    domains = reweighting.domains_of(spark, SF001)
    g = dro.group_gradient(rows, domains, reweighting.ACCUM)
    g.write.parquet(os.path.join(d, "grads"))
    stream = spark.readStream.schema(g.schema).parquet(os.path.join(d, "grads"))
    q = (jobs.online_weights_stream(stream, domains, lr=0.02).writeStream
         .outputMode("append").format("memory").queryName("weights_t")
         .option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.run_id, r.step, r.domain): (r.alpha, r.alpha_mean, r.alpha_ema)
           for r in spark.table("weights_t").collect()}
    init = {x: 1.0 / len(domains) for x in domains}
    a = dro.ema_weights(dro.sgd_weights(dro.with_lr(g, 0.02), init), init, 0.1)
    want = {(r.run_id, r.step, r.domain): (r.alpha, r.alpha_mean, r.alpha_ema) for r in a.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12)


def test_decontaminate_stream(spark):
    d = _tmp()
    os.makedirs(os.path.join(d, "in"))
    rows = [{"query_id": "a", "query": "the quick brown fox jumps over"},
            {"query_id": "b", "query": "completely unrelated training text"}]
    with open(os.path.join(d, "in", "part1.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    test = spark.createDataFrame([("t1", "The quick brown fox jumps over!")], "test_id string, query string")
    stream = spark.readStream.schema("query_id string, query string").json(os.path.join(d, "in"))
    q = jobs.decontaminate_stream(stream, test, os.path.join(d, "clean"), os.path.join(d, "report"),
                                  os.path.join(d, "ck"), ["query_id"], ["test_id"], trigger_once=True)
    q.awaitTermination(120)
    assert [r.query_id for r in spark.read.parquet(os.path.join(d, "clean")).collect()] == ["b"]
    rep = spark.read.parquet(os.path.join(d, "report")).collect()
    assert [(r.query_id, [x.test_id for x in r.test_dups]) for r in rep] == [("a", ["t1"])]


def test_decontaminate_stream_replay_leaves_one_copy(spark):
    """A micro-batch run again after an interrupted write replaces its rows,
    and no intermediate table stays."""
    from tessera import session
    d = _tmp()
    os.makedirs(os.path.join(d, "in"))
    with open(os.path.join(d, "in", "part1.jsonl"), "w") as f:
        f.write(json.dumps({"query_id": "b", "query": "unrelated training text"}) + "\n")
    test = spark.createDataFrame([("t1", "the quick brown fox jumps")], "test_id string, query string")
    for attempt in ("ck1", "ck2"):  # a lost checkpoint replays epoch 0
        stream = spark.readStream.schema("query_id string, query string").json(os.path.join(d, "in"))
        before = len(session._STAGE_TABLES)
        q = jobs.decontaminate_stream(stream, test, os.path.join(d, "clean"), os.path.join(d, "report"),
                                      os.path.join(d, attempt), ["query_id"], ["test_id"], trigger_once=True)
        q.awaitTermination(120)
        assert len(session._STAGE_TABLES) == before + 1  # the static side's fingerprints
    assert [r.query_id for r in spark.read.parquet(os.path.join(d, "clean")).collect()] == ["b"]


def test_online_weights_wait_for_the_whole_step(spark):
    """A step split over micro-batches is applied once, when it is complete."""
    d = _tmp()
    schema = "run_id string, step long, domain string, grad double"
    parts = [[("r", 0, "a", 0.5)], [("r", 1, "a", 0.1), ("r", 1, "b", 0.2)],
             [("r", 0, "b", -0.5), ("r", 0, "a", 9.0)], [("r", 1, "b", 7.0), ("r", 2, "a", 1.0)], [("r", 2, "b", 1.0)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "in"))
    q = (jobs.online_weights_stream(stream, ["a", "b"], lr=0.5).writeStream
         .outputMode("append").format("memory").queryName("weights_split")
         .option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.step, r.domain): r.log_alpha for r in spark.table("weights_split").collect()}
    init = {x: 0.5 for x in "ab"}
    whole = spark.createDataFrame([("r", 0, "a", 0.5), ("r", 0, "b", -0.5), ("r", 1, "a", 0.1), ("r", 1, "b", 0.2),
                                   ("r", 2, "a", 1.0), ("r", 2, "b", 1.0)], schema)
    want = {(r.step, r.domain): r.log_alpha
            for r in dro.sgd_weights(dro.with_lr(whole, 0.5), init).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_loss_rollup_counts_every_row(spark):
    """More than 5,000 rows of one domain in one window all count."""
    rows = spark.range(12_000).select(F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
                                      F.lit("a").alias("domain"), F.col("id").cast("double").alias("loss"))
    r = jobs.loss_rollup(rows).first()
    assert r.n == 12_000 and r.value == pytest.approx(5999.5)


def _run(spark, stream_of, name, schema, parts, one_by_one=True):
    """Rows that a stream over ``parts`` (a file each) emits."""
    d = _tmp()
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1 if one_by_one else 1000) \
        .parquet(os.path.join(d, "in"))
    q = (stream_of(stream).writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    progress = [p for p in q.recentProgress if p.stateOperators]
    q.stop()
    return spark.table(name).collect(), progress


def _at(minutes):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=minutes)


def test_steps_with_a_missing_domain_are_closed(spark):
    """Domain b stops reporting after step 0: the timers close its steps with
    gradient 0, and the state does not grow with the steps."""
    schema = "run_id string, step long, domain string, grad double, ts timestamp"
    parts = [[("r", 0, "a", 0.5, _at(0)), ("r", 0, "b", None, _at(0)), ("r", 0, "zz", 9.0, _at(0)),
              (None, 0, "a", 1.0, _at(0))]]
    parts += [[("r", s, "a", 0.1 * s, _at(30 * s)), ("r", s, "a", 77.0, _at(30 * s))] for s in range(1, 6)]
    # b's row of step 1 comes after step 1 was closed; another run moves the watermark
    parts += [[("r", 1, "b", 5.0, _at(170)), ("x", 0, "a", 1.0, _at(400)), ("x", 0, "b", 1.0, _at(400))]]
    got, progress = _run(spark, lambda s: jobs.online_weights_stream(
        s, ["a", "b"], lr=1.0, ts="ts", watermark="10 minutes", patience=900, idle=7200),
        "weights_missing", schema, parts)
    r = {(g.step, g.domain): g.log_alpha for g in got if g.run_id == "r"}
    assert sorted(r) == [(s, d) for s in range(6) for d in "ab"] and len(got) == 12 + 2
    whole = [("r", s, d, (0.5 if s == 0 else 0.1 * s) if d == "a" else 0.0) for s in range(6) for d in "ab"]
    whole = spark.createDataFrame(whole, "run_id string, step long, domain string, grad double")
    want = dro.sgd_weights(dro.with_lr(whole, 1.0), {"a": 0.5, "b": 0.5}).collect()
    for w in want:
        assert r[w.step, w.domain] == pytest.approx(w.log_alpha)
    # run r has been idle for two hours of event time: only run x is kept
    assert progress[-1].stateOperators[0].numRowsTotal == 1


def _near_rows(n=60):
    base = ["the quick brown fox jumps over the lazy dog near the river bank",
            "shards of a table are read by many tasks and written once more",
            "", "an entirely different sentence about weather, wind and rain"]
    rows = []
    for i in range(n):
        text = base[i % 4] if i % 3 else base[i % 4] + "s" * (i % 2)
        rows.append((i, None if i == 14 else text, _at(i)))
    return rows


def _fp_links(rows):
    """Pairs of different fingerprints, and the number of copies of each."""
    import collections
    near = sorted(tuple(sorted((r.fp, r.earlier_fp))) for r in rows if r.distance > 0)
    return near, collections.Counter(r.fp for r in rows if r.distance == 0)


@pytest.mark.parametrize("cuts", [1, 4])
def test_near_duplicates_inside_a_stream_equal_the_batch(spark, cuts):
    schema = "id long, text string, ts timestamp"
    rows = _near_rows()
    parts = [rows[i::cuts] if cuts == 1 else rows[i * 15:(i + 1) * 15] for i in range(cuts)]
    got, _ = _run(spark, near.near_duplicates_stream, f"near_{cuts}", schema, parts)
    fps = {i: fingerprint_text((t or "").replace("_", "")) for i, t, _ in rows}
    distinct = sorted(set(fps.values()))
    want = sorted((a, b) for k, a in enumerate(distinct) for b in distinct[k + 1:] if (a ^ b).bit_count() <= 2)
    pairs, copies = _fp_links(got)
    assert len(distinct) > 4 and pairs == want
    assert all(copies[f] == sum(g == f for g in fps.values()) - 1 for f in distinct)
    # every link leads from the later row to an earlier one of the stated fingerprints
    assert all(r.earlier_id < r.id and fps[r.id] == r.fp and fps[r.earlier_id] == r.earlier_fp for r in got)
    # each row but the first of its fingerprint is linked to an earlier copy once
    assert sorted(r.id for r in got if r.distance == 0) == sorted(
        i for i, f in fps.items() if f in [fps[j] for j in range(i)])


def test_near_duplicates_are_forgotten_after_the_horizon(spark):
    schema = "id string, text string, ts timestamp"
    parts = [[("a", "same words in here", _at(0))], [("b", "same words in here", _at(50))],
             [("c", "other things altogether, nothing alike", _at(1000))],
             [("d", "yet another sentence to move on", _at(1001))],
             [("e", "same words in here", _at(1002)), (None, "same words in here", _at(1002))],
             [("f", "same words in here", _at(3))]]  # late
    got, progress = _run(spark, lambda s: near.near_duplicates_stream(s, watermark="10 minutes", horizon=3600),
                         "near_horizon", schema, parts)
    assert [(r.id, r.earlier_id, r.distance) for r in got] == [("b", "a", 0)]
    # the first sentence's 15 keys went; c, d and e hold 15 buckets each at most
    assert progress[-1].stateOperators[0].numRowsTotal <= 45
    assert progress[-1].stateOperators[0].numRowsDroppedByWatermark > 0
