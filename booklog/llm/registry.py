"""The operators as queries over the given tables, with SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.session import scratch_folder

from . import anchors, cap_filters, decontaminate, licenses, minhash, packing, suffix_dedup, token_counts, token_files, toxicity, variants, warc, word_bpe
from .shared import ship_package, table

VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest_columns(decontaminate.contamination(docs, benchmark))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = scratch_folder(spark, "token-cache")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), cache, public_tokenizers.path(VOCABULARY))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op5_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, with_payload=False).drop("url")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY))
    return token_files.read_token_files(spark, folder)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.vector_codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontamination, op2_token_counts, op3_suffix_dedup, op4_minhash, op5_cap_filters,
        op6_license_scan, op7_warc, op8_token_files, op9_packing, op10_toxicity,
        op11_word_bpe, op12_spelling_variants, op13_anchor_codes,
    )
    return {query.__name__: _shipping(query) for query in found}


def _shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.oracle_sql(),
        "op6_license_scan": licenses.oracle_sql(),
        "op7_warc": """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
    o AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS original FROM d)
    SELECT page_id, n AS payload_bytes, h AS payload_digest,
      CASE WHEN original IS NOT NULL AND original IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN original IS DISTINCT FROM page_id THEN original END AS refers_to
    FROM o""",
        "op12_spelling_variants": variants.oracle_sql(),
        "op13_anchor_codes": anchors.oracle_sql(),
    }
