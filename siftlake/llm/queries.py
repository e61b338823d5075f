"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table, tune


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    tune(spark)
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_of_documents

    tune(spark)
    return quality_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    tune(spark)
    return extract(table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_scan import encode_and_decode

    tune(spark)
    return encode_and_decode(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    tune(spark)
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_of_documents

    tune(spark)
    return language_of_documents(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    tune(spark)
    return exact_groups(table(spark, sf_dir, "documents")).drop("row_no")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import materialise

    tune(spark)
    return materialise(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_quality_classifier, op3_html_extraction, op4_sentencepiece, op5_best_fit_packing, op6_language_id, op7_fingerprints, op8_license_scan, op9_exact_dedup, op10_token_output)}


#: Equal but for white space: the row of the smallest id stays.
EXACT_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": EXACT_SQL}
