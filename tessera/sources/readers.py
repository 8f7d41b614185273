"""Readers for the collection formats of retrieval training and evaluation
data.  Every reader is a plain ``spark.read`` (JSON / CSV / text; gzip is
read natively) followed by column expressions — no Python row loops.  Paths
may be on any file system that Spark reads.  "Last line wins" and line
numbers follow file names, then lines, however the files are split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import number_rows
from .files import decoded, exists, files_of, last_of, with_line_numbers, with_place

JSON_SUFFIXES = ("json", "jsonl")
#: A text is blank without a character outside this set (all white space).
NOT_BLANK = r"[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_ID_ALIASES = ("query_id", "docid", "id")
_TEXT_ALIASES = ("query", "question")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename ``query_id/docid/id -> _id`` and ``query/question -> text``
    (first alias present wins) and cast ``_id`` to string."""
    cols = set(df.columns)
    if "_id" not in cols:
        for a in _ID_ALIASES:
            if a in cols:
                df = df.withColumnRenamed(a, "_id")
                break
    if "text" not in cols:
        for a in _TEXT_ALIASES:
            if a in cols:
                df = df.withColumnRenamed(a, "text")
                break
    if "_id" in df.columns:
        df = df.withColumn("_id", F.col("_id").cast("string"))
    return df


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON-lines corpus/queries from a file or a directory (S1)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return normalize_columns(reader.json(files_of(spark, path, JSON_SUFFIXES)))


def read_beir_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """BEIR corpus/queries (S6): ``title`` defaults to ""; a later duplicate
    ``_id`` wins (by file name, then line)."""
    df = normalize_columns(with_place(spark.read.json(files_of(spark, path, JSON_SUFFIXES))))
    if "title" not in df.columns:
        df = df.withColumn("title", F.lit(""))
    return last_of(df.withColumn("title", F.coalesce(F.col("title"), F.lit(""))), ["_id"])


QRELS_SCHEMA = "query_id string, doc_id string, score int"


def read_qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Header TSV ``query-id, corpus-id, score`` (S5); ids stay strings; for a
    duplicated (query, doc) the last line wins."""
    df = with_place(spark.read.option("sep", "\t").option("header", True)
                    .schema("`query-id` string, `corpus-id` string, score int").csv(path)) \
        .withColumnRenamed("query-id", "query_id").withColumnRenamed("corpus-id", "doc_id")
    return last_of(df, ["query_id", "doc_id"])


def read_trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """4-column TREC qrels ``qid Q0 docid rel`` without header (S9): keep
    relevance >= 1, stored as 1."""
    return (spark.read.option("sep", "\t").option("header", False)
            .schema("query_id string, q0 string, doc_id string, rel int").csv(path)
            .where(F.col("rel") >= 1)
            .select("query_id", "doc_id", F.lit(1).alias("score")))


def read_topics_tsv(spark: SparkSession, path: str) -> DataFrame:
    """2-column topics TSV without header (S8); trailing newline stripped."""
    return (spark.read.option("sep", "\t").option("header", False).option("quote", "")
            .schema("query_id string, text string").csv(path)
            .withColumn("text", F.regexp_replace("text", "[\\r\\n]+$", "")))


def read_run_tsv(spark: SparkSession, path: str, depth: int = 1000) -> DataFrame:
    """Run file (S10), tab-separated, with 3 (``qid pid score``) or 4
    (``qid x pid score``) columns: ids stripped of blanks around them, per
    query sorted by score descending (stable in file order), first ``depth``
    kept.  A line of another shape, or a score that is no number, is an
    error.  Returns ``query_id, doc_id, score, rank``."""
    raw = with_line_numbers(spark.read.text(path), "_ord").select(F.split("value", "\t").alias("f"), "_ord")
    four = F.size("f") == 4
    shape = F.when(F.size("f") >= 3, F.lit(True)).otherwise(F.raise_error(F.lit("run line needs 3 or 4 tab-separated columns")))
    df = raw.where(shape).select(
        F.trim(F.col("f")[0]).alias("query_id"),
        F.trim(F.when(four, F.col("f")[2]).otherwise(F.col("f")[1])).alias("doc_id"),
        F.trim(F.when(four, F.col("f")[3]).otherwise(F.col("f")[2])).cast("double").alias("score"),
        "_ord")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_ord")
    return (df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)
            .drop("_ord"))


def read_train_pairs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Training pair lines (S2), gzip or plain, in three shapes:
    ``["q","p"]`` (exactly two, else an error; a blank positive stays),
    ``{"query", "pos": [...]}`` and ``{"set": [...]}`` (sets of fewer than two
    are skipped; first item is the query, the rest positives; blank positives
    are dropped, kept text is not trimmed).  Any other shape is an error, a
    query line with ``neg`` included.  Ids are ``train-<line index>``; rows
    with an empty query or no positives are dropped.  Returns ``_id, text,
    pos``."""
    idx = with_line_numbers(spark.read.text(paths))
    v = F.trim("value")
    keys = F.json_object_keys("value")
    has = lambda k: F.array_contains(keys, k)
    parsed = idx.select(
        "idx",
        F.when(v.startswith("["), F.from_json("value", "array<string>")).alias("a"),
        F.from_json("value", "struct<query:string,pos:array<string>,set:array<string>>").alias("o"),
        (has("query") & has("pos") & ~has("neg")).alias("query_line"), has("set").alias("set_line"))
    kind = (F.when(F.col("a").isNotNull(), F.when(F.size("a") == 2, "pair")
                   .otherwise(F.raise_error(F.lit("pair line must hold exactly two texts"))))
            .when(F.col("query_line"), "query").when(F.col("set_line"), "set")
            .otherwise(F.raise_error(F.lit("unknown training line shape"))))
    filled = lambda x: F.filter(x, lambda p: F.coalesce(p, F.lit("")).rlike(NOT_BLANK))
    text = F.when(F.col("kind") == "pair", F.col("a")[0]).when(F.col("kind") == "query", F.col("o.query")) \
        .otherwise(F.get(F.col("o.set"), F.lit(0)))
    pos = F.when(F.col("kind") == "pair", F.slice("a", 2, 1)).when(F.col("kind") == "query", filled(F.col("o.pos"))) \
        .otherwise(filled(F.slice(F.col("o.set"), 2, 1 << 30)))
    out = parsed.withColumn("kind", kind).select(
        F.concat(F.lit("train-"), F.col("idx").cast("string")).alias("_id"), text.alias("text"), pos.alias("pos"))
    return out.where((F.col("text") != "") & (F.size("pos") > 0))


PASSAGE = "struct<docid:string,title:string,text:string,ce_score:double>"


def read_training_groups(spark: SparkSession, path: str) -> DataFrame:
    """Training-group JSONL (S3) whose passages are objects or plain strings,
    told apart by their JSON type: a string, whatever its first character,
    becomes ``{docid: "", title: "", text}``.  ``ce_score`` (the teacher's
    score) is kept, null where absent.  A missing ``query_id`` becomes
    ``train-<line index>``."""
    def passages(name):
        found = F.try_variant_get("v", f"$.{name}", "array<variant>")
        text = F.schema_of_variant
        return F.transform(found, lambda x: F.when(
            text(x) == "STRING",
            F.struct(F.lit("").alias("docid"), F.lit("").alias("title"), F.try_variant_get(x, "$", "string").alias("text"),
                     F.lit(None).cast("double").alias("ce_score")))
            .otherwise(F.struct(*[F.try_variant_get(x, f"$.{f}", t).alias(f) for f, t in (
                ("docid", "string"), ("title", "string"), ("text", "string"), ("ce_score", "double"))])))

    rows = with_line_numbers(spark.read.text(path)).select("idx", F.parse_json("value").alias("v"))
    return rows.select(
        F.coalesce(F.try_variant_get("v", "$.query_id", "string"),
                   F.concat(F.lit("train-"), F.col("idx").cast("string"))).alias("query_id"),
        F.try_variant_get("v", "$.query", "string").alias("query"),
        passages("positive_passages").alias("positive_passages"),
        passages("negative_passages").alias("negative_passages"))


def read_test_queries(spark: SparkSession, folder: str) -> DataFrame:
    """All ``.json/.jsonl`` test-query files of a folder (S11): adds
    ``meta.filename``; underscores removed; empty queries dropped."""
    df = spark.read.json(files_of(spark, folder, (".json", ".jsonl"))) \
        .withColumn("_file", F.col("_metadata.file_path"))
    return (df.withColumn("query", F.regexp_replace("query", "_", ""))
            .where(F.col("query") != "")
            .withColumn("meta", F.struct(F.element_at(F.split("_file", "/"), -1).alias("filename")))
            .drop("_file"))


def read_domain_files(spark: SparkSession, folder: str, domains: list[str],
                      domain_to_idx: dict[str, int] | None = None) -> DataFrame:
    """``<folder>/<domain>.jsonl`` (a file, or a folder of part files) for
    each configured domain (S13), in sorted name order; a missing file is an error.  Adds
    ``_train_dataset_idx`` (row index within the domain), ``domain_name``
    and ``domain_ids``."""
    names = sorted(domains)
    paths = {d: f"{folder.rstrip('/')}/{d}.jsonl" for d in names}
    missing = [d for d in names if not exists(spark, paths[d])]
    if missing:
        raise FileNotFoundError(f"missing domain files: {missing}")
    ids = domain_to_idx or {d: i for i, d in enumerate(names)}
    idmap = F.create_map(*[x for d, i in ids.items() for x in (F.lit(d), F.lit(i))])
    name = lambda path: F.regexp_extract(decoded(path), r"([^/]+)\.jsonl(?:/[^/]*)?$", 1)
    df = with_line_numbers(spark.read.json(list(paths.values())).withColumn(
        "domain_name", name("_metadata.file_path")), "_train_dataset_idx", per=name("_file"))
    return df.withColumn("domain_ids", idmap[F.col("domain_name")].cast("tinyint"))


DOMAIN_CONFIG_SCHEMA = T.StructType([
    T.StructField("domain_ids", T.MapType(T.StringType(), T.LongType())),
    T.StructField("domain_weights", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("size", T.MapType(T.StringType(), T.LongType())),
    T.StructField("epoch", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("category_list", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])


def read_domain_config(spark: SparkSession, path: str) -> DataFrame:
    """Domain config JSON (S14) exploded into a dimension table
    ``domain, domain_id, weight (normalised to sum 1), raw_weight, size,
    epoch``."""
    cfg = spark.read.option("multiLine", True).schema(DOMAIN_CONFIG_SCHEMA).json(path)
    dims = cfg.select(F.explode("domain_weights").alias("domain", "raw_weight"),
                      "domain_ids", "size", "epoch")
    return dims.select(
        "domain", F.col("domain_ids")[F.col("domain")].alias("domain_id"), "raw_weight",
        (F.col("raw_weight") / F.sum("raw_weight").over(Window.partitionBy())).alias("weight"),
        F.col("size")[F.col("domain")].alias("size"),
        F.col("epoch")[F.col("domain")].alias("epoch"))


def read_category_bridge(spark: SparkSession, path: str) -> DataFrame:
    """``category -> [domain]`` of a domain config as a bridge table."""
    cfg = spark.read.option("multiLine", True).schema(DOMAIN_CONFIG_SCHEMA).json(path)
    return (cfg.select(F.explode("category_list").alias("category", "domains"))
            .select("category", F.explode("domains").alias("domain")))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """Id-mapping TSV with header ``beir-docid, faiss-docid`` (S15)."""
    return (spark.read.option("sep", "\t").option("header", True)
            .option("escape", '"').schema("`beir-docid` string, `faiss-docid` long").csv(path)
            .select(F.col("beir-docid").alias("doc_id"), F.col("faiss-docid").alias("row_id")))


def write_id_map(ids: DataFrame, path: str) -> None:
    """``doc_id, row_id`` as the id-mapping TSV that :func:`read_id_map`
    reads; tabs, quotes and line ends inside an id are quoted."""
    ids.select(F.col("doc_id").alias("beir-docid"), F.col("row_id").alias("faiss-docid")) \
        .write.mode("overwrite").option("sep", "\t").option("header", True).option("escape", '"').csv(path)


def build_id_map(corpus: DataFrame, id_col: str = "_id") -> DataFrame:
    """Dense 0-based integer id per corpus id (by id order)."""
    return number_rows(corpus.select(F.col(id_col).alias("doc_id")).distinct(), ["doc_id"], "row_id")


def medmcqa_groups(df: DataFrame) -> DataFrame:
    """MedMCQA rows as training groups (S4): rows with a non-empty
    explanation ``exp``; the explanation is the single positive."""
    return (df.where(F.col("exp").isNotNull() & (F.col("exp") != ""))
            .withColumn("positive_passages", F.array(F.struct(
                F.lit("").alias("docid"), F.lit("").alias("title"), F.col("exp").alias("text"))))
            .withColumn("negative_passages",
                        F.array().cast("array<struct<docid:string,title:string,text:string>>")))


def read_lang_shards(spark: SparkSession, paths: list[str], key: str = "docid") -> DataFrame:
    """Per-language corpus shards (S7, e.g. ``.../<lang>/docs-<i>.jsonl.gz``):
    one multi-path read; ``lang`` is taken from the parent folder name."""
    df = spark.read.json(paths).withColumn("_file", F.col("_metadata.file_path"))
    return (df.withColumnRenamed(key, "_id").withColumn("_id", F.col("_id").cast("string"))
            .withColumn("lang", F.element_at(F.split(decoded("_file"), "/"), -2)).drop("_file"))


def read_multilingual_qa(spark: SparkSession, folder: str) -> DataFrame:
    """Multilingual QA files ``<folder>/<lang>.jsonl`` with ``id, question,
    answers`` (S12): ``lang`` from the file name."""
    df = spark.read.json(files_of(spark, folder, (".jsonl",))).withColumn("_file", F.col("_metadata.file_path"))
    return df.select(F.col("id").cast("string").alias("query_id"), F.col("question").alias("text"),
                     "answers",
                     F.regexp_extract("_file", r"([^/]+)\.jsonl(?:/[^/]*)?$", 1).alias("lang"))


def read_multilingual_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The QA corpus (S12): the id is ``_id``, else ``docid``, else an error;
    the last line of an id wins."""
    df = with_place(spark.read.json(files_of(spark, path, JSON_SUFFIXES)))
    present = [c for c in ("_id", "docid") if c in df.columns]
    if not present:
        raise KeyError("the corpus needs an _id or docid field")
    key = F.coalesce(*[F.col(c).cast("string") for c in present])
    key = F.when(key.isNull(), F.raise_error(F.lit("a corpus line has neither _id nor docid"))).otherwise(key)
    return last_of(df.withColumn("_key", key).drop(*present).withColumnRenamed("_key", "_id"), ["_id"])


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that have qrels (J4, semi join)."""
    return queries.join(qrels.select(F.col("query_id").alias("_id")).distinct(), "_id", "left_semi")


def lookup_ids(ids: DataFrame, rows: DataFrame, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Id -> row lookup (J1): ``(hits, rejects)``; callers decide whether a
    reject is reported (corpus) or an error (queries)."""
    hits = ids.join(rows, key, "inner")
    rejects = ids.join(rows.select(key), key, "left_anti")
    return hits, rejects


def union_test_sets(*sets: DataFrame) -> DataFrame:
    """Union of test-query sets with a running index (U1): ``idx`` orders
    by set, then by row order inside the set."""
    out = None
    for i, s in enumerate(sets):
        s = s.withColumn("_set", F.lit(i)).withColumn("_ord", F.monotonically_increasing_id())
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return number_rows(out, ["_set", "_ord"], "idx").drop("_set", "_ord")


def align_union(frames: list[DataFrame]) -> DataFrame:
    """Union by name with missing columns as null (U3); a column present
    with different types is an error."""
    types: dict[str, str] = {}
    for f in frames:
        for c, t in f.dtypes:
            if types.setdefault(c, t) != t:
                raise TypeError(f"column {c} has types {types[c]} and {t}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def category_union(domain_rows: DataFrame, bridge: DataFrame, category_ids: dict[str, int]) -> DataFrame:
    """Concatenate the domains of each category (U2): rows keep
    ``domain_name``; ``domain_ids`` becomes the category id."""
    ids = F.create_map(*[x for c, i in category_ids.items() for x in (F.lit(c), F.lit(i))])
    return (domain_rows.join(bridge.withColumnRenamed("domain", "domain_name"), "domain_name")
            .withColumn("domain_ids", ids[F.col("category")].cast("tinyint")))
