"""Queries of this package: name -> builder, and the SQL of those that SQL
can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup,
    fim,
    language,
    mixing,
    near_dedup,
    packing,
    quality,
    scoring,
    substring,
    toxicity,
    vector_dedup,
    wavelet,
    whitening,
)
from .common import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_text_model(read_table(spark, sf_dir, "documents"))
    return language.identify(read_table(spark, sf_dir, "pages"), model)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(read_table(spark, sf_dir, "documents"),
                              public_tokenizers.path("word_bpe_49k.json"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_mix(read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "size", "source_size", "target", "taken", "copies")


OP8_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM per),
walk AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
         sum(source_size) OVER () AS all_size,
         sum(cap) OVER w - cap AS cap_before,
         sum(weight) OVER () - sum(weight) OVER w + weight AS weight_left
  FROM weighed
  WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
stops AS (SELECT *, CAST(all_size - cap_before AS DOUBLE) / weight_left > ratio AS stopped FROM walk),
shared AS (
  SELECT *, sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER () AS cap_all,
         sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS weight_all FROM stops),
targets AS (
  SELECT source, source_size,
         CASE WHEN stopped THEN CAST(cap AS DOUBLE)
              ELSE CAST(all_size - cap_all AS DOUBLE) * weight / weight_all END AS target FROM shared),
stepped AS (
  SELECT s.doc_id, s.size, s.source, s.h, t.source_size, t.target,
         CASE WHEN t.source_size > 0
              THEN CAST(floor(t.target / t.source_size * 16777216 + 0.5) AS BIGINT) ELSE 0 END AS step,
         CAST('0x' || substr(md5('0|' || coalesce(s.source, '')), 1, 6) AS BIGINT) AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
reached AS (
  SELECT *, CAST(sum(step) OVER (PARTITION BY source ORDER BY size, h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
            + start AS reach FROM stepped),
taken AS (SELECT *, reach // 16777216 - (reach - step) // 16777216 AS copies FROM reached)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

def op11_rows(embeddings: DataFrame) -> DataFrame:
    out = whitening.whitened_components(embeddings)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_rows(read_table(spark, sf_dir, "embeddings"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.held_out_scores(read_table(spark, sf_dir, "documents"))


def op13_digests(docs: DataFrame) -> DataFrame:
    out = fim.fill_in_middle(docs)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      digest(F.col("output")).alias("output_sha256"),
                      digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_digests(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS r1,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS r2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, array_to_string(u[1:least(r1, r2)], '') AS p,
         array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
         array_to_string(u[greatest(r1, r2) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_quality": (op1_quality, None),
    "op2_packing": (op2_packing, None),
    "op3_language": (op3_language, None),
    "op4_near_dedup": (op4_near_dedup, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_wavelet": (op6_wavelet, None),
    "op7_vector_dedup": (op7_vector_dedup, None),
    "op8_mixing": (op8_mixing, OP8_SQL),
    "op9_substring_dedup": (op9_substring_dedup, None),
    "op10_exact_dedup": (op10_exact_dedup, OP10_SQL),
    "op11_whitening": (op11_whitening, None),
    "op12_lm_scoring": (op12_lm_scoring, None),
    "op13_fill_in_middle": (op13_fill_in_middle, OP13_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for name, (build, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
