"""Stored micro-batches and their commit ledger."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from booklog.config import Store
from booklog.schema import (
    CLEAN_EVENT,
    DEAD_LETTER,
    HOURLY_DELTA,
    HOURLY_METRIC,
    QUALITY_METRIC,
    RAW_EVENT,
)
from booklog.sources import ledger, storage

BATCH_KEY = T.StructField("batch_id", T.LongType())


def commits(spark: SparkSession, paths: Store) -> DataFrame:
    """One row per batch whose outputs are complete."""
    return ledger.rows(spark, paths)


def batches(spark: SparkSession, root: str, schema: T.StructType, paths: Store) -> DataFrame:
    """All committed batches of one dataset.

    The ledger gives ranges of ids, which prune the directories of the one root, so a batch
    that is incomplete or being replaced is never read.
    """
    fields = [field for field in schema.fields if field.name != BATCH_KEY.name]
    full_schema = T.StructType([*fields, BATCH_KEY])
    visible = ledger.read(spark, paths).visible()
    if not visible:
        return spark.createDataFrame([], full_schema)
    stored = spark.read.schema(full_schema).parquet(root)
    return stored.filter(ledger.in_ranges(BATCH_KEY.name, visible)).select(*full_schema.fieldNames())


def raw_events(spark: SparkSession, paths: Store) -> DataFrame:
    return batches(spark, paths.raw_events, RAW_EVENT, paths)


def clean_events(spark: SparkSession, paths: Store) -> DataFrame:
    return batches(spark, paths.clean_events, CLEAN_EVENT, paths)


def dead_letters(spark: SparkSession, paths: Store) -> DataFrame:
    return batches(spark, paths.dead_letter, DEAD_LETTER, paths)


def quality_metrics(spark: SparkSession, paths: Store) -> DataFrame:
    return batches(spark, paths.quality_metrics, QUALITY_METRIC, paths)


def hourly_deltas(spark: SparkSession, paths: Store) -> DataFrame:
    return batches(spark, paths.hourly_airline_deltas, HOURLY_DELTA, paths)


def hourly_metrics(spark: SparkSession, paths: Store) -> DataFrame:
    """The merged cube, empty before the first merge."""
    folder = storage.current(spark, paths.hourly_airline_metrics)
    if folder is None:
        return spark.createDataFrame([], HOURLY_METRIC)
    return spark.read.schema(HOURLY_METRIC).parquet(folder)
