import numpy as np
import pytest
from pyspark.sql import functions as F
from shared import docs  # noqa: F401

from tessera.llm import language, quality, toxicity

SF = "/root/testdata/sf0.01"


def _held(result, labels, column):
    got = result.filter("held_out").join(labels.select("doc_id", F.col(column).alias("y")), "doc_id").collect()
    return np.array([(r.score, r.predicted, r.y) for r in got])


def _auc(score, y):
    a, b = score[y == 1], score[y == 0]
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())


def test_toxicity_held_out(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(documents, labels)
    assert got.count() == documents.count()
    assert got.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").isEmpty()
    x = _held(got, labels, "toxic")
    assert _auc(x[:, 0], x[:, 2]) > 0.85
    assert x[x[:, 2] == 0, 1].mean() < 0.05


def test_machine_learns_a_pair_that_weights_cannot(spark):
    """Each word alone is harmless and as common; only the pair is toxic."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(2400):
        a, b = rng.integers(0, 2, 2)
        words = [f"f{k}" for k in rng.integers(0, 30, 6)] + ["insult"] * a + ["group"] * b
        rows.append((" ".join(words), int(a and b)))
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"), rounds=12)
    terms = toxicity.Terms()
    s = model.score([terms.of(t) for t in (b"f1 f2 insult group", b"f1 f2 insult", b"f1 f2 group", b"f1 f2")])
    assert s[0] > 0.6 and max(s[1:]) < 0.3
    assert np.abs(model.factors).max() > 0.1


def test_machine_learns_a_pair_of_words_that_tell_nothing_alone(spark):
    """Both words are as common in toxic as in clean texts; toxic is who has
    both or neither."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(2400):
        a, b = rng.integers(0, 2, 2)
        words = [f"f{k}" for k in rng.integers(0, 30, 6)] + ["insult"] * a + ["group"] * b
        rows.append((" ".join(words), int(a == b)))
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"), rounds=30)
    terms = toxicity.Terms()
    s = model.score([terms.of(text.encode()) for text, _ in rows])
    y = np.array([label for _, label in rows])
    assert _auc(s, y) > 0.95 and ((s > 0.5) == y).mean() > 0.9


def test_rare_terms_are_not_pushed_out_by_common_ones(spark):
    """A term's value depends on its own counts; none is 0, however many
    others differ more."""
    total = np.array([100_000] * 20_000 + [3, 1, 0])
    positive = np.array([11_000] * 20_000 + [3, 1, 0])
    value = toxicity.evidence(positive, total, 100_000, 1_000_000)
    assert value.min() >= 0.05 and value[20_000] > 0.2
    assert value[20_000] == toxicity.evidence(positive[20_000:], total[20_000:], 100_000, 1_000_000)[0]


def test_toxicity_edges(docs, spark):
    rows = [(i, f"fine text number {i}" if i % 2 else f"awful scum text {i}") for i in range(400)]
    rows += [(None, "scum"), (None, None), (1000, ""), (1001, "scum " * 20_000), (3, "fine text number 3")]
    labels = spark.createDataFrame([(i, 1 - i % 2, None if i % 7 == 0 else 1 - i % 2) for i in range(400)]
                                   + [(9999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1001].predicted == 1 and by[301].predicted == 0
    assert toxicity.classify(docs([]), labels).collect() == []
    none = labels.filter("doc_id < 0")
    assert {r.predicted for r in toxicity.classify(docs(rows), none).collect()} == {0}


def test_toxicity_reads_no_held_out_label(docs, spark):
    rows = [(i, f"w{i % 13} scum" if i % 3 == 0 else f"w{i % 13}") for i in range(300)]
    df = docs(rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.bucket(F.col("doc_id"), 4) == 2, 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.classify(df, x).collect())) for x in (labels, flipped))
    assert a == b


def test_quality_held_out(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(documents, labels)
    assert got.count() == documents.count()
    assert got.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").isEmpty()
    x = _held(got, labels, "quality")
    assert _auc(x[:, 0], x[:, 2]) > 0.95
    assert (x[:, 1] == x[:, 2]).mean() > 0.93


def test_rules_are_sparse_column_expressions(spark):
    rng = np.random.default_rng(1)
    n = len(quality.STATISTICS)
    x = rng.random((1500, n))
    y = ((x[:, 3] > 0.6) & (x[:, 5] <= 0.5)).astype(int)
    rows = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)],
                                 "label int, " + ", ".join(f"{s} double" for s in quality.STATISTICS))
    model = quality.fit(rows, trees=10)
    assert 0 < len(model.rules) < 60
    used = {name for rule, _ in model.rules for name, _, _ in rule}
    assert {quality.STATISTICS[3], quality.STATISTICS[5]} <= used
    got = rows.select("label", model.column().alias("p")).collect()
    assert np.mean([(r.p >= 0.5) == r.label for r in got]) > 0.95


def test_statistics_edges():
    names = quality.STATISTICS
    assert quality.statistics(None) == quality.statistics(b"") == quality.statistics(b" \n") == [0.0] * len(names)
    s = dict(zip(names, quality.statistics(b"Ab ab!\nAb ab!\n12 | x")))
    assert s["distinct_lines"] == pytest.approx(2 / 3) and s["capital_words"] == pytest.approx(2 / 7)
    assert s["bar"] == pytest.approx(1 / 20) and s["bang_question"] == pytest.approx(2 / 20)


def test_quality_edges(docs, spark):
    rows = [(i, f"A clean sentence with number {i}." if i % 2 else "### !!! ||| $$$ " * (i % 5 + 1)) for i in range(200)]
    rows += [(None, "A clean one."), (1000, None), (1001, ""), (1, rows[1][1]), (1002, "A word. " * 20_000)]
    labels = spark.createDataFrame([(i, None if i % 9 == 0 else i % 2) for i in range(200)] + [(None, 1), (7777, 0)],
                                   "doc_id long, quality int")
    got = quality.classify(docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[101].predicted == 1 and by[100].predicted == 0
    assert quality.classify(docs([]), labels).collect() == []
    assert {r.score for r in quality.classify(docs(rows), labels.filter("doc_id < 0")).collect()} == {0.5}


# --- language

@pytest.fixture(scope="module")
def text_model(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    return language.fit_text_model(documents.filter("doc_id % 4 <> 0"))


def test_text_model_equals_counting(spark):
    from collections import Counter
    rows = [("a", "Hello  there"), ("a", "hello"), ("b", "été"), ("b", None), (None, "x"), ("b", "")]
    model = language.fit_text_model(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    assert model.languages == ["a", "b"]
    for k, lang in enumerate(model.languages):
        counts = Counter()
        for own, text in rows:
            if own == lang:
                counts.update(language.grams((text or "").encode()).tolist())
        want = np.full(1 << language.BITS, 0.5)
        for g, n in counts.items():
            want[g] += n
        assert np.allclose(model.log_p[k], np.log(want / want.sum()))
    assert np.allclose(np.exp(model.log_prior), [3 / 7, 4 / 7])


def test_text_language_of_held_out_documents(spark, text_model):
    held = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 4 = 0")
    got = language.text_evidence(held, text_model, "text", ("doc_id", "lang"), False).collect()
    right = [text_model.languages[int(np.argmax(r.evidence))] == r.lang for r in got]
    assert np.mean(right) > 0.98


def test_all_pages_get_their_language(spark, text_model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = language.identify(pages, text_model).collect()
    assert len(got) == pages.count()
    assert np.mean([r.lang == r.declared for r in got]) > 0.97


def test_evidence_decides_where_text_cannot(spark, text_model):
    text = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 800")
            .dropDuplicates(["lang"]).collect()}
    page = lambda lang, body: f'<html lang="{lang}"><script>x()</script><body>{body}</body></html>'
    rows = [(i, f"http://de{i % 3}.shop.de/x{i}", page("de", text["de"])) for i in range(30)]
    rows += [(100 + i, f"http://www.fr{i % 3}.fr:80/x", page("fr-FR", text["fr"])) for i in range(30)]
    rows += [(200, "http://de1.shop.de/empty", None), (201, "http://fr1.fr/empty", "<html></html>"),
             (202, None, page("fr", "")), (203, "http://de0.shop.de/q", page("fr", text["de"])),
             (204, None, None), (None, "", ""), (200, "http://de1.shop.de/empty", None),
             (205, "http://new.shop.de/", "<p>1234</p>")]
    df = spark.createDataFrame([(*r, "l", 1) for r in rows], "page_id long, url string, html string, lang string, p int")
    got = language.identify(df, text_model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[200].lang == "de" and by[201].lang == "fr"  # by host
    assert by[202].lang == "fr"  # by declaration
    assert by[203].lang == "de"  # text against declaration
    assert by[205].lang == "de"  # by domain
    assert by[0].host == "de0.shop.de" and by[101].host == "fr1.fr" and by[101].declared == "fr"
    assert all(0 < r.confidence <= 1 for r in got)
    assert language.identify(df.limit(0), text_model).collect() == []


def test_page_text():
    html = "<!-- a --><style>b{}</style><SCRIPT>var t='</p>'</SCRIPT><nav>x</nav><p>A &amp; <b>B</b>"
    assert language.page_text(html).split() == ["A", "&", "B"]
    assert language.page_text(None) == ""


def test_toxicity_is_the_same_on_every_run(docs, spark):
    """Bit for bit, however the rows arrive and however many tasks there are."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 12) % 3000) + (" scum" if i % 9 == 0 else "")) for i in range(20_000)]
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(20_000)], "doc_id long, toxic int")
    df, found, before = docs(rows), [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, shuffle, batch in ((3, 8, 10_000), (17, 5, 10_000), (17, 5, 700)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            arrived = df.repartition(parts, F.rand(parts))
            found.append(sorted(map(tuple, toxicity.classify(arrived, labels).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert found[0] == found[1] == found[2]
    held = [r for r in found[0] if r[1]]
    assert sum(r[3] == int(r[0] % 9 == 0) for r in held) > 0.99 * len(held)


def test_toxicity_on_a_bounded_number_of_rows(docs, spark):
    rows = docs([(i, f"w{i % 50} scum" if i % 4 == 0 else f"w{i % 50} fine") for i in range(6000)])
    labelled = rows.withColumn("label", (F.col("doc_id") % 4 == 0).cast("int"))
    model = toxicity.fit(labelled, max_rows=1500)
    good, bad = model.score([toxicity.Terms().of(t) for t in (b"w3 fine", b"w3 scum")])
    assert good < 0.3 < bad
