"""Which events earlier batches held already: ids in buckets that a batch meets without moving them.

A batch's distinct events are written once, in buckets by their hash. Tables in buckets by the
same columns are joined and grouped where they lie, so the only shuffle is that of the batch.
All ids of a batch are kept, repeats too: replacing one batch is then all that a replay needs.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.config import Store
from booklog.operators.metrics import token_rows
from booklog.schema import DIMENSIONS
from booklog.sources import batches, ledger, storage

EVENT = [*DIMENSIONS, "event_key"]
# Runs of folded batches are partitions below zero; a batch that is not folded is its own.
_COLUMNS = "event_date STRING, event_hour INT, airline_code STRING, event_key BINARY, batch_id BIGINT, run BIGINT"


def _table(spark: SparkSession, paths: Store) -> str:
    """The stored ids as a table of this session; the first call fixes the count of buckets."""
    folder = paths.seen_events
    storage.claim(spark, f"{folder}/_buckets", spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"seen_events_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} ({_COLUMNS}) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY ({', '.join(EVENT)}) INTO {buckets(spark, paths)} BUCKETS LOCATION '{folder}'"
        )
    # Another session may have added batches.
    spark.catalog.recoverPartitions(name)
    return name


def buckets(spark: SparkSession, paths: Store) -> int:
    return int(storage.read_text(spark, f"{paths.seen_events}/_buckets"))


def folded_before(spark: SparkSession, paths: Store) -> int:
    """Batches below this number are folded and can no longer be replaced."""
    folder = f"{paths.seen_events}/_folded"
    names = storage.children(spark, folder) if storage.exists(spark, folder) else []
    return max((int(name) for name in names if name.isdigit()), default=0)


def record_batch(spark: SparkSession, paths: Store, batch_id: int) -> None:
    """Store the distinct events of a committed batch, replacing what it had before.

    Copies of an event are combined before the shuffle, so one that fills a third of the batch
    is harmless. A batch without events leaves an empty partition.
    """
    if batch_id < folded_before(spark, paths):
        raise ValueError(f"batch {batch_id} is folded; its events are final")
    clean = batches.clean_events(spark, paths).filter(F.col("batch_id") == batch_id)
    named = token_rows(clean).withColumn("event_key", F.unhex("event_id"))
    events = named.groupBy(*EVENT).agg(F.lit(batch_id).cast("long").alias("batch_id"))
    _replace(spark, paths, events, batch_id)


def _replace(spark: SparkSession, paths: Store, events: DataFrame, run: int) -> None:
    table, count = _table(spark, paths), buckets(spark, paths)
    if count != int(spark.conf.get("spark.sql.shuffle.partitions")):
        # The session shuffles into another number of parts than the store has buckets.
        events = events.repartition(count, *EVENT)
    # Rows are read from the table that a fold writes to, which Spark allows where it only adds.
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (run = {run})")
    storage.delete(spark, f"{paths.seen_events}/run={run}")
    columns = ", ".join([*EVENT, "batch_id"])
    spark.sql(f"INSERT INTO {table} PARTITION (run = {run}) SELECT {columns} FROM {{events}}", events=events)


def seen_events(spark: SparkSession, paths: Store) -> DataFrame:
    """``EVENT, batch_id`` of the committed batches that were recorded, by bucket.

    Of folded batches, an event is there once, with the first batch that held it.
    """
    stored = spark.read.table(_table(spark, paths))
    first, visible = folded_before(spark, paths), ledger.read(spark, paths).visible()
    current = (F.col("run") == -first) if first else F.lit(False)
    open_batches = (F.col("run") >= first) & ledger.in_ranges("run", visible)
    return stored.filter(current | open_batches).select(*EVENT, "batch_id")


def fresh_events(spark: SparkSession, paths: Store, batch_id: int) -> DataFrame:
    """Events of one batch that no batch with a smaller number holds. Nothing is shuffled."""
    seen = seen_events(spark, paths)
    batch, earlier = (seen.filter(F.col("batch_id") == batch_id), seen.filter(F.col("batch_id") < batch_id))
    # A broadcast of history would outgrow memory; merged by bucket, it stays in place.
    return batch.join(earlier.select(*EVENT).hint("merge"), EVENT, "left_anti")


def first_batches(spark: SparkSession, paths: Store) -> DataFrame:
    """Every event once, with the first batch that holds it. Nothing is shuffled."""
    return seen_events(spark, paths).groupBy(*EVENT).agg(F.min("batch_id").alias("first_batch"))


def distinct_responses(spark: SparkSession, paths: Store) -> DataFrame:
    """``successful_response_records`` in which an event counts once over all batches.

    Only sums per date, hour and airline are shuffled.
    """
    counted = first_batches(spark, paths).groupBy(*DIMENSIONS)
    return counted.agg(F.count(F.lit(1)).alias("successful_response_records"))


def fold_batches(spark: SparkSession, paths: Store, before: int) -> None:
    """Move the events of all batches below ``before`` into one run, each with its first batch.

    Every batch adds a file per bucket, so this bounds their number. It reads and writes by
    bucket. Folded batches are final, which a stream guarantees once their successor began.
    A small file makes the new run current in one step; what it replaces goes afterwards.
    """
    if before <= folded_before(spark, paths):
        return
    table = _table(spark, paths)
    rows = first_batches(spark, paths).filter(F.col("first_batch") < before)
    _replace(spark, paths, rows.withColumnRenamed("first_batch", "batch_id"), -before)
    storage.claim(spark, f"{paths.seen_events}/_folded/{before}", "")
    names = storage.children(spark, paths.seen_events)
    for run in (int(name[4:]) for name in names if name.startswith("run=")):
        if -before < run < before:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (run = {run})")
            storage.delete(spark, f"{paths.seen_events}/run={run}")
