import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import qa, schedule
from tessera.functions import text as TX
from tessera.operators import groups as G
from tessera.operators import metrics as M
from tessera.operators import mixing, dro


def test_metrics_hand_computed(spark):
    run = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3), (2, 20, 0.5, 1)],
                                "query_id long, doc_id long, score double, rank int")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 13, 1), (2, 99, 1), (3, 5, 1)],
                                  "query_id long, doc_id long, rel int")
    j = M.judge(run, qrels)
    base = M.query_base_from_qrels(qrels, [1, 3])
    got = {(r.metric, r.k): r.value for r in M.evaluate(j, base, [1, 3]).collect()}
    # q1: hit at rank 2 of 2 relevant; q2: no hit; q3: judged, not retrieved
    assert got[("mrr", 3)] == pytest.approx(round(0.5 / 3, 6))
    assert got[("recall", 3)] == pytest.approx(round(0.5 / 3, 6))
    assert got[("precision", 3)] == pytest.approx(round((1 / 3) / 3, 6))
    assert got[("accuracy", 1)] == 0.0
    ndcg_q1 = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert got[("ndcg", 3)] == pytest.approx(round(ndcg_q1 / 3, 6))
    with pytest.raises(ValueError):
        M.parse_metric("foo@3")
    assert M.parse_metric("ndcg") == ("ndcg", 5)


def test_interleave_frequencies_and_exhaustion(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2100, "a").when(F.col("id") < 2700, "b").otherwise("c").alias("domain"),
        F.col("id"))
    out = mixing.interleave(rows, {"a": 0.7, "b": 0.2, "c": 0.1}, 7, "first_exhausted")
    counts = {r.domain: r["count"] for r in out.groupBy("domain").count().collect()}
    n = sum(counts.values())
    assert abs(counts["a"] / n - 0.7) < 0.05 and abs(counts["c"] / n - 0.1) < 0.05
    # no row is emitted twice before its domain is exhausted
    assert out.groupBy("domain", "idx").count().where("count > 1").count() == 0
    allx = mixing.interleave(rows, {"a": 0.7, "b": 0.2, "c": 0.1}, 7, "all_exhausted")
    seen = {r.domain: r.n for r in allx.groupBy("domain").agg(F.countDistinct("idx").alias("n")).collect()}
    assert seen == {"a": 2100, "b": 600, "c": 300}


def test_homogeneous_batches_have_one_domain(spark):
    rows = spark.range(400).select((F.col("id") % 4).cast("string").alias("domain"), "id")
    out = mixing.interleave(rows, {"0": 1, "1": 1, "2": 1, "3": 1}, 3, "all_exhausted", 8, True)
    assert out.groupBy("batch_id").agg(F.countDistinct("domain").alias("d")).where("d > 1").count() == 0
    full = mixing.drop_partial_batches(out, 8)
    assert full.groupBy("batch_id").count().where("count <> 8").count() == 0


def test_dense_index_is_a_permutation(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("domain"), "id")
    idx = mixing.shuffle_domains(rows, 1, "domain", "id", hex_buckets=2)
    got = sorted(r.idx for r in idx.collect())
    assert got == list(range(5000))


def test_group_sampling_edges(spark):
    psg = "struct<docid:string,title:string,text:string>"
    df = spark.createDataFrame(
        [(1, "q", [("p", None, "P")], []), (2, "q", [("p", "", "P")], [("n1", None, "N1")]),
         (3, "q", [("p", "T", "P")], [(f"n{i}", None, f"N{i}") for i in range(3)]),
         (4, "q", [("p", None, "P")], [(f"n{i}", None, f"N{i}") for i in range(9)])],
        f"query_id long, query string, positive_passages array<{psg}>, negative_passages array<{psg}>")
    s = {r.query_id: r for r in G.sample_groups(df, 4, 42).collect()}
    assert len(s[1].negative_passages) == 0
    assert [p.docid for p in s[2].negative_passages] == ["n1"] * 3      # with replacement
    assert sorted(p.docid for p in s[3].negative_passages) == ["n0", "n1", "n2"]
    assert len({p.docid for p in s[4].negative_passages}) == 3          # without replacement
    flat = {(r.query_id, r.position): r.passage_text for r in G.flatten(G.sample_groups(df, 2, 1)).collect()}
    assert flat[(2, 0)] == " P" and flat[(3, 0)] == "T P" and flat[(1, 0)] == "P"
    bad = df.withColumn("positive_passages", F.concat("positive_passages", "positive_passages"))
    with pytest.raises(Exception):
        G.flatten(bad).collect()


def test_prompts(spark):
    df = spark.createDataFrame([("AllNLI",), ("msmarco",)], "t string")
    inst = F.create_map(*[x for k, v in TX.E5_INSTRUCTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    r = {x.t: x for x in df.select("t", TX.train_prompt(F.col("t"), inst[F.col("t")], F.lit(0)).alias("p"),
                                   TX.train_prompt(F.col("t"), inst[F.col("t")], F.lit(0), "bge").alias("b"),
                                   TX.is_symmetric(F.col("t")).alias("sym")).collect()}
    assert r["msmarco"].p.startswith("Instruct: Given a web search query") and r["msmarco"].p.endswith("\nQuery: ")
    assert r["AllNLI"].b == "" and r["msmarco"].b == TX.BGE_QUERY_PROMPT and r["AllNLI"].sym
    with pytest.raises(Exception):
        df.select(TX.train_prompt(F.lit("nope"), inst[F.lit("nope")], F.lit(0))).collect()


def test_qa_tokens_and_answers(spark):
    df = spark.createDataFrame([("Héllo, wörld!! 12 ab",)], "t string")
    r = df.select(qa.words(F.col("t")).alias("w"), qa.ngrams(qa.words(F.col("t")), 2).alias("g"),
                  qa.token_spans(F.col("t")).alias("sp")).collect()[0]
    assert r.w == ["héllo", ",", "wörld", "!", "!", "12", "ab"]
    assert r.g[:3] == ["héllo", "héllo ,", ","]
    assert (r.sp[0].start, r.sp[0].end, r.sp[2].start) == (0, 5, 7)
    ans = spark.createDataFrame([(["wörld !"], ), ([""],), (["nope"],)], "a array<string>")
    got = [x.h for x in ans.select(qa.has_answers(F.array(*[F.lit(w) for w in r.w]),
                                                  qa.answer_words(F.col("a"))).alias("h")).collect()]
    assert got == [True, True, False]
    rx = spark.createDataFrame([("Hello World", "world$"), ("abc", "(")], "t string, p string")
    assert [x.m for x in rx.select(qa.regex_match("t", "p").alias("m")).collect()] == [True, False]


def test_entity_groups(spark):
    tags = spark.createDataFrame([(1, 0, "A", "PER"), (1, 1, "B", "PER"), (1, 2, "c", "O"), (1, 3, "D", "LOC")],
                                 "doc_id long, pos int, token string, tag string")
    got = sorted((r.start, r.tag, r.text) for r in qa.entity_groups(tags).collect())
    assert got == [(0, "PER", "A B"), (3, "LOC", "D")]


def test_schedules_and_keys(spark):
    df = spark.range(0, 12).select(F.col("id").alias("s"))
    lin = [r.f for r in df.select(schedule.lr_factor(F.col("s"), "linear", 2, 10, 0.1).alias("f")).collect()]
    assert lin[0] == 0 and lin[1] == 0.5 and lin[2] == pytest.approx(1.0) and lin[11] == pytest.approx(0.1)
    assert lin[10] == pytest.approx(0.1)
    keys = spark.createDataFrame([("eval_loss",), ("test_acc",), ("α.val/x",), ("loss",)], "k string")
    assert [r.r for r in keys.select(schedule.rename_metric_key(F.col("k")).alias("r")).collect()] == [
        "eval/loss", "test/acc", "α.val/x", "train/loss"]
    acc = spark.createDataFrame([("P@10",), ("Recall@5",)], "k string")
    assert [r.r for r in acc.select(schedule.rename_accuracy_key(F.col("k")).alias("r")).collect()] == [
        "precision_at_10", "recall_at_5"]
    assert schedule.total_steps(100, 4) == 25 and schedule.total_steps(None, 4, 7) == 7
    with pytest.raises(ValueError):
        schedule.total_steps(None, 4)


def test_sgd_window_equals_sequential_fold(spark):
    g = spark.createDataFrame([("r", s, d, float((s * 7 + i) % 5) / 3)
                               for s in range(1, 8) for i, d in enumerate("abc")],
                              "run_id string, step long, domain string, grad double")
    init = {"a": 0.5, "b": 0.3, "c": 0.2}
    a = dro.sgd_weights(dro.with_lr(g, 0.1), init).orderBy("step", "domain").collect()
    la = {d: math.log(w) for d, w in init.items()}
    for s in range(1, 8):
        for i, d in enumerate("abc"):
            la[d] += 0.1 * float((s * 7 + i) % 5) / 3
        z = sum(math.exp(v) for v in la.values())
        for r in (x for x in a if x.step == s):
            assert r.alpha == pytest.approx(math.exp(la[r.domain]) / z, rel=1e-12)
    st = dro.stateful_weights(dro.with_lr(g, 0.1), init, "sgd").orderBy("step", "domain").collect()
    for x, y in zip(a, st):
        assert x.alpha == pytest.approx(y.alpha, rel=1e-9)


def _ascend(name, grads, lrs, theta, wd=0.0, relog=False):
    """Scalar loops after the optimisers' published update rules."""
    th, n, out = list(theta), len(theta), []
    m, v, acc, sq, buf = ([0.0] * n for _ in range(5))
    for t, (g, lr) in enumerate(zip(grads, lrs), 1):
        g = [-x for x in g]
        if name == "adafactor":
            keep = 1 - t ** -0.8
            sq = [keep * s + (1 - keep) * (x * x + 1e-30) for s, x in zip(sq, g)]
            u = [x / math.sqrt(s) for x, s in zip(g, sq)]
            rms = math.sqrt(sum(x * x for x in u) / n)
            th = [a - lr * x / max(1.0, rms) for a, x in zip(th, u)]
        else:
            for i in range(n):
                x = g[i]
                if name == "adamw":
                    th[i] *= 1 - lr * wd
                    m[i], v[i] = 0.9 * m[i] + 0.1 * x, 0.999 * v[i] + 0.001 * x * x
                    th[i] -= lr * (m[i] / (1 - 0.9 ** t)) / (math.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
                    continue
                x += wd * th[i]
                if name == "momentum":
                    buf[i] = x if t == 1 else 0.9 * buf[i] + 0.5 * x
                    th[i] -= lr * buf[i]
                elif name == "sgd":
                    th[i] -= lr * x
                elif name == "adagrad":
                    acc[i] += x * x
                    th[i] -= lr * x / (math.sqrt(acc[i]) + 1e-10)
                elif name == "rmsprop":
                    sq[i] = 0.99 * sq[i] + 0.01 * x * x
                    th[i] -= lr * x / (math.sqrt(sq[i]) + 1e-8)
        z = sum(math.exp(a) for a in th)
        alpha = [math.exp(a) / z for a in th]
        if relog:
            th = [math.log(a) for a in alpha]
        out.append(alpha)
    return out


@pytest.mark.parametrize("name,wd,relog", [("sgd", 0.1, False), ("sgd", 0.1, True), ("momentum", 0.0, False),
                                           ("adamw", 0.05, False), ("adamw", 0.05, True), ("adagrad", 0.1, False),
                                           ("rmsprop", 0.1, False), ("adafactor", 0.0, False)])
def test_every_optimizer_follows_its_rule(spark, name, wd, relog):
    grads = [[float((s * 7 + i * 3) % 5) / 3 - 0.4 for i in range(3)] for s in range(1, 9)]
    g = spark.createDataFrame([("r", s + 1, d, row[i]) for s, row in enumerate(grads) for i, d in enumerate("abc")],
                              "run_id string, step long, domain string, grad double")
    init = {"a": 0.5, "b": 0.3, "c": 0.2}
    kw = {"momentum": 0.9, "dampening": 0.5} if name == "momentum" else {}
    got = dro.stateful_weights(dro.with_lr(g, 0.1, "linear", 2, 9), init, "sgd" if name == "momentum" else name,
                               weight_decay=wd, relog=relog, **kw).orderBy("step", "domain").collect()
    lrs = [r.lr for r in got[::3]]
    want = _ascend(name, grads, lrs, [math.log(x) for x in init.values()], wd, relog)
    assert [r.alpha for r in got] == pytest.approx([a for row in want for a in row], rel=1e-9)
    with pytest.raises(ValueError):
        dro.stateful_weights(g, init, "lion")


def test_batch_norm_and_robust_loss_from_partial_sums(spark):
    rows = [("r", 1, 0, "a", 2.0, 1.0), ("r", 1, 0, "b", 4.0, 3.0), ("r", 1, 1, "a", 1.0, 0.0), ("r", 2, 0, "b", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "run_id string, step long, micro long, domain string, loss double, ref_loss double")
    got = {(r.step, r.micro, r.domain): r.proxy for r in dro.proxy_loss(df, True, True, 2.0).collect()}
    n = math.sqrt(10)
    assert got == pytest.approx({(1, 0, "a"): 1 / (1 / n), (1, 0, "b"): 1 / (3 / n), (1, 1, "a"): 1.0, (2, 0, "b"): 0.0})
    alpha = spark.createDataFrame([("r", 1, "a", 0.25), ("r", 1, "b", 0.75), ("r", 2, "b", 1.0)],
                                  "run_id string, step long, domain string, alpha double")
    out = {(r.step, r.micro): r.robust_loss for r in dro.robust_loss(df, alpha).collect()}
    assert out == pytest.approx({(1, 0): 0.25 * 2 + 0.75 * 4, (1, 1): 1.0, (2, 0): 1.0})


def test_group_metrics_by_name(spark):
    rows = spark.createDataFrame([(1, 0, 0.5, 1), (1, 1, 0.9, 0), (1, 2, 0.1, 0), (2, 0, 0.2, 0), (2, 1, 0.2, 0)],
                                 "group_id long, pos int, score double, label int")
    get = lambda n, **k: {r.group_id: r.value for r in M.group_metric(rows, n, **k).collect()}
    assert get("recall@1") == {1: 0.0, 2: 0.0} and get("recall@2") == {1: 1.0, 2: 0.0}
    assert get("mrr@2") == {1: 0.5, 2: 0.0} and get("mrr@1") == {1: 0.0, 2: 0.0}
    assert get("ctr@2") == {1: 0.5, 2: 0.0} and get("ctr") == pytest.approx({1: 1 / 3, 2: 0.0})
    assert get("dcg@2") == pytest.approx({1: 1 / math.log2(3), 2: 0.0})
    assert get("ndcg@2") == pytest.approx({1: 1 / math.log2(3), 2: 0.0})
    # published variants: ascending order is pos 2, 0, 1
    assert get("mrr@1", compat=True) == {1: 0.5, 2: 0.0} and get("mrr@2", compat=True) == {1: 0.0, 2: 0.0}
    assert get("recall@1", compat=True) == {1: 0.0, 2: 0.0} and get("recall@3", compat=True) == {1: 1.0, 2: 0.0}
    with pytest.raises(ValueError):
        M.group_metric(rows, "map@3")


def test_words_lower_case_each_token_and_untokenize(spark):
    df = spark.createDataFrame([("ΟΔΟΣ.ΑΒΓ",), ("  Héllo,  wörld !",), ("",)], "t string")
    r = df.select(qa.words(F.col("t")).alias("w"), qa.token_spans(F.col("t")).alias("s"), "t")
    got = r.select("w", qa.untokenize(F.col("t"), F.col("s")).alias("all"),
                   qa.untokenize(F.col("t"), F.col("s"), 1, 3).alias("mid")).collect()
    assert got[0].w == ["οδος", ".", "αβγ"]
    assert got[1]["all"] == "Héllo,  wörld !" and got[1].mid == ",  wörld" and got[2]["all"] == ""
    skipped = r.select(qa.ngrams(F.col("w"), 2, skip=lambda g: F.array_contains(g, ".")).alias("g")).first().g
    assert skipped == ["οδος", "αβγ"]
    from tessera.operators.answers import contained_answers
    p = spark.createDataFrame([(1, "ΟΔΟΣ.ΑΒΓ"), (2, "x y")], "doc_id long, text string")
    a = spark.createDataFrame([(7, "ΟΔΟΣ"), (8, " \t"), (9, "y x"), (10, None)], "item_id long, text string")
    assert sorted(map(str, contained_answers(p, a).collect())) == sorted(
        ["Row(doc_id=1, item_id=7, all_passages=False)", "Row(doc_id=None, item_id=8, all_passages=True)"])


def test_judgements_are_counted_by_grade_and_met_by_the_run_before_a_shuffle(spark):
    from tessera.operators import metrics as M
    rows = [(q, d, d % 4) for q in (1, 2) for d in range(40)] + [(2, 7, 3), (None, 5, 1), (3, 1, None), (4, 1, 0)]
    qrels = spark.createDataFrame(rows, "query_id long, doc_id long, rel long")
    ks = [1, 3, 12, 100]
    base = M.query_base_from_qrels(qrels, ks)
    plan = base._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan.split("Aggregate", 2)[2].split("\n")[0] and "row_number" not in plan
    got = {r.query_id: r for r in base.collect()}
    assert set(got) == {1, 2}
    for q in (1, 2):
        grades = sorted((r for a, _, r in rows if a == q and r), reverse=True)
        assert got[q].n_rel == len(grades)
        for k in ks:
            want = sum((2 ** g - 1) / math.log2(i + 2) for i, g in enumerate(grades[:k]))
            assert abs(got[q][f"idcg_{k}"] - want) < 1e-9
    run = spark.createDataFrame([(1, 3, 1), (2, 7, 1), (2, 99, 2), (9, 1, 1)], "query_id long, doc_id long, rank long")
    judged = M.judge(run, qrels)
    assert "LeftSemi" in judged._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.query_id, r.doc_id, r.rel) for r in judged.collect()) == [
        (1, 3, 3), (2, 7, 3), (2, 7, 3), (2, 99, 0), (9, 1, 0)]
