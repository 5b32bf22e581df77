"""Token counts through a cache keyed by content and vocabulary digests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder_source, version_digest
from .shared import batch_of, stored, text_slices, whole_text

CACHE_SCHEMA = "vocabulary string, digest binary, n_tokens long"
TOKEN_LIMIT = 512


def cached_counts(docs: DataFrame, cache: str, vocabulary: str) -> DataFrame:
    """The cached counts of one vocabulary: a row per digest, whoever appended it."""
    spark = docs.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache)
    found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    ours = found.filter(F.col("vocabulary") == vocabulary)
    return ours.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs: DataFrame, cache: str, path: str) -> None:
    """Encodes every distinct text that the cache lacks, once, and appends the counts.

    Copies of a text are combined in their tasks before the shuffle, so that a text that makes
    up a third of all rows arrives once per task. The append is one write: a failed attempt
    leaves nothing, and a repeated one adds rows that ``cached_counts`` combines.
    """
    spark = docs.sparkSession
    vocabulary = version_digest(path)
    texts = docs.select(F.unhex(F.sha2(whole_text(), 256)).alias("digest"), whole_text().alias("text"))
    misses = texts.dropDuplicates(["digest"]).join(
        cached_counts(docs, cache, vocabulary), "digest", "left_anti"
    )
    encoder = encoder_source(spark, path)
    schema = pa.schema([("vocabulary", pa.string()), ("digest", pa.binary()), ("n_tokens", pa.int64())])

    def encode(batches):
        for rows, _, _ in text_slices(batches, "text"):
            counts = encoder().counts(rows.column("text").to_pylist())
            yield batch_of(schema, [vocabulary] * len(counts), rows.column("digest"), counts)

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    The content is normalised only in that null is the empty text, because any other change
    could change its count. Counts come from the cache folder, which is created where it is
    missing and gains the distinct texts that it lacks. Every row gives a row: repeated rows
    and null ids are kept as they are. Further columns of ``docs`` are not read.
    """
    encode_misses(docs, cache, path)
    keys = docs.select(
        "doc_id",
        F.octet_length(whole_text()).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(whole_text(), 256)).alias("digest"),
    )
    counts = cached_counts(docs, cache, version_digest(path)).join(keys.select("digest"), "digest", "left_semi")
    # Stored, so that the last join shuffles both sides itself and can split a frequent digest.
    counted = keys.join(stored(counts, "token-counts"), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
