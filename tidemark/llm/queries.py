"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, language_id, near_dedup, packing, pii, quality_rules, token_counts, token_files, warc
from .chunks import vocabulary
from .shared import fresh_folder, table

#: Of the synthetic tables only; a real corpus has a key of its own.
PSEUDONYM_KEY = "synthetic tables"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"), percent=85)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), fresh_folder(spark, "tokens"), path, end_id=2))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1, room=2048)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.archive(table(spark, sf_dir, "pages"), fresh_folder(spark, "warc")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PSEUDONYM_KEY)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.documents_counted(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=50256)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_token_files": op2_token_files,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
}

ORACLES = {
    "op6_warc": r"""
        WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
        d AS (SELECT page_id, p, octet_length(p) AS n, sha1(p) AS sha FROM t),
        g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY p) ELSE page_id END AS keep FROM d)
        SELECT page_id, n AS payload_bytes, sha AS payload_digest, CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN keep = page_id THEN NULL ELSE keep END AS refers_to FROM g""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS n FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id))
        SELECT doc_id, keep_id, n AS group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
}
