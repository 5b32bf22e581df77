"""Clean events by date: a date is a folder, and in it every batch has one of its own."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from booklog.config import Store
from booklog.schema import CLEAN_EVENT
from booklog.sources import batches, ledger, storage

_DATED = T.StructType([*CLEAN_EVENT.fields, batches.BATCH_KEY])


def _note(paths: Store, batch_id: int) -> str:
    """A small file that names every date a batch may have a folder in."""
    return f"{paths.clean_by_date}/_dates/{batch_id}"


def file_by_date(spark: SparkSession, paths: Store, batch_id: int) -> list[str]:
    """File the clean events of a committed batch under their dates; returns these.

    Folders of an earlier attempt go first, also under dates that the batch no longer has. The
    dates are noted before anything is written, so an attempt that stops half-way is cleared by
    the next one. The events are shuffled once, by date in parts of the advisory size, so that
    a date gets few files and a large one is not left to one task.
    """
    clean = batches.clean_events(spark, paths).filter(F.col("batch_id") == batch_id)
    # Days of the calendar, not events.
    dates = sorted(row.event_date for row in clean.select("event_date").distinct().collect())
    note = _note(paths, batch_id)
    if storage.exists(spark, note):
        for date in json.loads(storage.read_text(spark, note)):
            storage.delete(spark, f"{paths.clean_by_date}/event_date={date}/batch_id={batch_id}")
        storage.delete(spark, note)
    if dates:
        storage.claim(spark, note, json.dumps(dates))
        parts = clean.hint("rebalance", "event_date")
        parts.write.mode("append").partitionBy("event_date", "batch_id").parquet(paths.clean_by_date)
    return dates


def clean_events_between(
    spark: SparkSession, paths: Store, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Filed events of committed batches from ``first`` to ``last``, both included, as ``yyyymmdd``.

    Only the folders of these dates are listed.
    """
    if first and last and first > last:
        raise ValueError(f"the range ends before it begins: {first} to {last}")
    root, visible = paths.clean_by_date, ledger.read(spark, paths).visible()
    names = storage.children(spark, root) if storage.exists(spark, root) else []
    dates = [name[11:] for name in names if name.startswith("event_date=")]
    chosen = [date for date in dates if (not first or date >= first) and (not last or date <= last)]
    if not chosen or not visible:
        return spark.createDataFrame([], _DATED)
    reader = spark.read.schema(_DATED).option("basePath", root)
    stored = reader.parquet(*[f"{root}/event_date={date}" for date in chosen])
    return stored.filter(ledger.in_ranges("batch_id", visible)).select(*_DATED.fieldNames())
