import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, sinks


def _tmp():
    return tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")


def test_read_corpus_renames_and_casts(spark):
    d = _tmp()
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write(json.dumps({"docid": 7, "question": "q?"}) + "\n")
    with open(os.path.join(d, "skip.txt"), "w") as f:
        f.write("not json\n")
    df = readers.read_corpus(spark, d)
    assert dict(df.dtypes)["_id"] == "string"
    assert [(r["_id"], r["text"]) for r in df.collect()] == [("7", "q?")]


def test_read_beir_last_duplicate_wins_and_title_default(spark):
    d = _tmp()
    p = os.path.join(d, "corpus.jsonl")
    with open(p, "w") as f:
        for row in [{"_id": "1", "text": "old"}, {"_id": "2", "text": "b", "title": None},
                    {"_id": "1", "text": "new", "title": "T"}]:
            f.write(json.dumps(row) + "\n")
    got = {r["_id"]: (r["title"], r["text"]) for r in readers.read_beir_jsonl(spark, p).collect()}
    assert got == {"1": ("T", "new"), "2": ("", "b")}


def test_read_train_pairs_shapes(spark):
    d = _tmp()
    p = os.path.join(d, "pairs.jsonl.gz")
    lines = [json.dumps(["q0", "p0"]), json.dumps({"query": "q1", "pos": [" ", "p1 "]}),
             json.dumps({"set": ["only"]}), json.dumps({"set": ["q3", "a", "b"]}),
             json.dumps({"query": "", "pos": ["x"]}), json.dumps({"query": "q5", "pos": ["  "]})]
    with gzip.open(p, "wt") as f:
        f.write("\n".join(lines) + "\n")
    got = {r["_id"]: (r["text"], r["pos"]) for r in readers.read_train_pairs(spark, p).collect()}
    assert got == {"train-0": ("q0", ["p0"]), "train-1": ("q1", ["p1 "]),
                   "train-3": ("q3", ["a", "b"])}


@pytest.mark.parametrize("bad", [["a", "b", "c"], {"query": "q", "pos": ["p"], "neg": ["n"]}, {"query": "q"}, {}])
def test_read_train_pairs_bad_shape_is_error(spark, bad):
    d = _tmp()
    p = os.path.join(d, "bad.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps(bad) + "\n")
    with pytest.raises(Exception):
        readers.read_train_pairs(spark, p).collect()


def test_blank_positives(spark):
    """Dropped from query and set lines whatever the white space, kept in pairs."""
    d = _tmp()
    p = os.path.join(d, "pairs.jsonl")
    lines = [{"query": "q0", "pos": ["\t", "\n", "\u00a0", " x"]}, ["q1", " \t"], {"set": ["q2", "\t", "y"]},
             {"query": "q3", "pos": ["\t"]}, {"set": []}, {"set": ["q5", "z"], "neg": 1}]
    with open(p, "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    got = {r["text"]: r["pos"] for r in readers.read_train_pairs(spark, p).collect()}
    assert got == {"q0": [" x"], "q1": [" \t"], "q2": ["y"], "q5": ["z"]}


def test_line_numbers_follow_names_and_splits(spark):
    d = _tmp()
    want = []
    for name, n in (("a", 5), ("b", 4000), ("c", 1)):
        with open(os.path.join(d, f"{name}.txt"), "w") as f:
            for i in range(n):
                f.write(f"{name}{i}\n")
                want.append(f"{name}{i}")
    from tessera.sources.files import with_line_numbers
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    try:
        df = with_line_numbers(spark.read.text(d))
        assert spark.read.text(d).rdd.getNumPartitions() > 3
        assert [r.value for r in df.orderBy("idx").collect()] == want
        per = with_line_numbers(spark.read.text(d), per=F.col("_file"))
        assert all(int(r.value[1:]) == r.idx for r in per.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_last_duplicate_wins_by_file_name_not_size(spark):
    d = _tmp()
    for name, pad, text in (("a", 1, "FIRST"), ("b", 5000, "LAST")):
        with open(os.path.join(d, f"{name}.jsonl"), "w") as f:
            f.write(json.dumps({"_id": "1", "title": "", "text": text}) + "\n")
            f.write(json.dumps({"_id": f"{name}x", "title": "", "text": "p" * pad}) + "\n")
    for names in ("ab", "ba"):
        if names == "ba":  # the larger file first now
            with open(os.path.join(d, "a.jsonl"), "a") as f:
                f.write(json.dumps({"_id": "y", "title": "", "text": "p" * 20_000}) + "\n")
        got = {r["_id"]: r["text"] for r in readers.read_beir_jsonl(spark, d).collect()}
        assert got["1"] == "LAST"


def test_group_passages_by_json_type(spark):
    d = _tmp()
    p = os.path.join(d, "groups.jsonl")
    rows = [{"query": "q", "positive_passages": ["{code: 1}", '{"docid": "x"}', "plain"],
             "negative_passages": [{"docid": 7, "title": "T", "text": "n", "ce_score": 0.5}, {"text": "{y}"}]},
            {"query_id": "own", "query": "r", "positive_passages": []}]
    with open(p, "w") as f:
        f.write("\n".join(json.dumps(x) for x in rows))
    a, b = sorted(readers.read_training_groups(spark, p).collect(), key=lambda r: r.query)
    assert [tuple(x) for x in a.positive_passages] == [
        ("", "", t, None) for t in ("{code: 1}", '{"docid": "x"}', "plain")]
    assert [tuple(x) for x in a.negative_passages] == [("7", "T", "n", 0.5), (None, None, "{y}", None)]
    assert (a.query_id, b.query_id, b.positive_passages, b.negative_passages) == ("train-0", "own", [], None)


def test_id_map_round_trip(spark):
    ids = ["b", "a", 'tab\there', 'quote"d', "é", "10", "9"]
    corpus = spark.createDataFrame([(i,) for i in ids + ["a"]], "_id string")
    made = readers.build_id_map(corpus)
    assert {r.doc_id: r.row_id for r in made.collect()} == {x: k for k, x in enumerate(sorted(ids))}
    path = os.path.join(_tmp(), "map")
    readers.write_id_map(made, path)
    assert sorted(readers.read_id_map(spark, path).collect()) == sorted(made.select("doc_id", "row_id").collect())


def test_multilingual_corpus_id_rule(spark):
    d = _tmp()
    p = os.path.join(d, "c.jsonl")
    with open(p, "w") as f:
        for row in ({"_id": "a", "text": "1"}, {"docid": 7, "text": "2"}, {"_id": "a", "docid": "z", "text": "3"}):
            f.write(json.dumps(row) + "\n")
    assert {r["_id"]: r["text"] for r in readers.read_multilingual_corpus(spark, p).collect()} == {"a": "3", "7": "2"}
    with open(p, "w") as f:
        f.write(json.dumps({"id": "a", "text": "1"}) + "\n")
    with pytest.raises(KeyError):
        readers.read_multilingual_corpus(spark, p)


def test_scores_overwrite_replaces_and_cache_is_built_once(spark):
    out = os.path.join(_tmp(), "scores")
    first = spark.createDataFrame([("t", "en", 0.5), ("t", "fr", 0.1)], "task string, lang string, acc double")
    sinks.append_scores(spark, first, out)
    again = spark.createDataFrame([("t", "en", 0.7)], "task string, lang string, acc double")
    assert sinks.append_scores(spark, again, out, overwrite=True).count() == 1
    assert sorted((r.lang, r.acc) for r in spark.read.parquet(out).collect()) == [("en", 0.7), ("fr", 0.1)]
    path, built = os.path.join(_tmp(), "cache"), []

    def build():
        built.append(1)
        return spark.range(3)
    assert sinks.cached(spark, path, build).count() == sinks.cached(spark, path, build).count() == 3
    assert len(built) == 1
    with pytest.raises(ZeroDivisionError):
        sinks.cached(spark, os.path.join(_tmp(), "other"), lambda: 1 / 0)


def test_weight_tables_are_files(spark):
    w = spark.createDataFrame([("r", "curr", "a", 0, 0.25, 3, 1.0), ("r", "curr", "b", 1, 0.75, 1, 2.0)],
                              "run_id string, kind string, domain string, domain_id int, weight double, size long, epoch double")
    path = os.path.join(_tmp(), "w")
    sinks.write_weight_tables(w, ["run_id", "kind"], path)
    doc = json.loads(spark.read.text(f"{path}/run_id=r/kind=curr").first().value)
    assert doc["domain_weights"] == {"a": 0.25, "b": 0.75} and doc["size"] == {"a": 3, "b": 1}


def test_checkpoint_folder_of_the_user_wins(spark):
    """A local session without the setting works; a set folder is kept."""
    from tessera.session import ensure_checkpoint_dir
    have = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert ensure_checkpoint_dir(spark) == have == ensure_checkpoint_dir(spark)


def test_qrels_topics_run(spark):
    d = _tmp()
    q = os.path.join(d, "qrels.tsv")
    with open(q, "w") as f:
        f.write("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td1\t2\nq2\td3\t0\n")
    got = sorted(tuple(r) for r in readers.read_qrels_tsv(spark, q).collect())
    assert got == [("q1", "d1", 2), ("q2", "d3", 0)]
    t = os.path.join(d, "trec.tsv")
    with open(t, "w") as f:
        f.write("q1\tQ0\td1\t1\nq1\tQ0\td2\t0\nq2\tQ0\td9\t3\n")
    assert sorted(tuple(r) for r in readers.read_trec_qrels(spark, t).collect()) == [
        ("q1", "d1", 1), ("q2", "d9", 1)]
    r = os.path.join(d, "run.tsv")
    with open(r, "w") as f:
        f.write("q1\td1\t0.5\nq1\td2\t0.9\nq1\t d3 \t0.9\nq2\tx\td7\t1.0\nq 3\td 1\t0.5\n")
    run = [(x.query_id, x.doc_id, x.rank) for x in readers.read_run_tsv(spark, r, depth=2)
           .orderBy("query_id", "rank").collect()]
    assert run == [("q 3", "d 1", 1), ("q1", "d2", 1), ("q1", "d3", 2), ("q2", "d7", 1)]
    with open(r, "w") as f:
        f.write("q1 d1 0.5\n")
    with pytest.raises(Exception):
        readers.read_run_tsv(spark, r).collect()


def test_domain_files_and_config(spark):
    d = _tmp()
    for name, n in (("b", 2), ("A", 3)):
        with open(os.path.join(d, f"{name}.jsonl"), "w") as f:
            for i in range(n):
                f.write(json.dumps({"query": f"{name}{i}"}) + "\n")
    df = readers.read_domain_files(spark, d, ["b", "A"])
    got = sorted((r.domain_name, r._train_dataset_idx, r.domain_ids) for r in df.collect())
    assert got == [("A", 0, 0), ("A", 1, 0), ("A", 2, 0), ("b", 0, 1), ("b", 1, 1)]
    with pytest.raises(FileNotFoundError):
        readers.read_domain_files(spark, d, ["missing"])


def test_sinks_roundtrip(spark):
    d = _tmp()
    df = spark.createDataFrame([("t", "en", 0.5)], "task string, lang string, acc double")
    out = os.path.join(d, "scores")
    assert sinks.append_scores(spark, df, out).count() == 1
    assert sinks.append_scores(spark, df, out).count() == 0
    assert spark.read.parquet(out).count() == 1
    assert not sinks.write_if_any(df.limit(0), os.path.join(d, "empty"))
    line = sinks.log_lines(spark.createDataFrame([(3, 0.25)], "step int, loss double")).collect()
    assert json.loads(line[0].value) == {"loss": 0.25, "step": 3}


def test_domain_files_in_one_pass(spark, tmp_path):
    from tessera.sources import sinks
    rows = [(i, "hot" if i % 3 else ["a b", "x=1%", "ünï"][i % 9 // 3], f"q{i}") for i in range(500)] + [(900, None, "none")]
    df = spark.createDataFrame(rows, "n int, source string, query string").repartition(7)
    sinks.write_domain_files(df, str(tmp_path / "d"), "source", "n")
    back = readers.read_domain_files(spark, str(tmp_path / "d"), ["hot", "a b", "ünï"]) \
        .select("domain_name", "n", "_train_dataset_idx").collect()
    for name in ("hot", "a b", "ünï"):
        own = sorted(i for i, s, _ in rows if s == name)
        assert sorted((r[2], r.n) for r in back if r.domain_name == name) == list(enumerate(own))
    assert (tmp_path / "d" / "x=1%.jsonl").is_dir()
