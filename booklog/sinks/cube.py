"""The merged hourly cube, replaced as a whole."""

from pyspark.sql import SparkSession

from booklog.config import Store
from booklog.schema import HOURLY_METRIC
from booklog.sinks.runs import close_runs, merged_runs
from booklog.sources import storage

ATTEMPTS = 5


def publish_metrics(spark: SparkSession, paths: Store) -> int:
    """Merge every committed delta and make the cube current; returns its rows.

    Deltas are read as sums of closed runs of batches. Nothing is incremented, so running it
    again changes nothing. Where another writer makes a cube current in the meantime, this one
    may lack its batches, so it is merged again.
    """
    close_runs(spark, paths)
    for _ in range(ATTEMPTS):
        seen = storage.version_number(spark, paths.hourly_airline_metrics)
        folder = storage.new_version(paths.hourly_airline_metrics)
        try:
            merged_runs(spark, paths).write.parquet(folder)
            rows = spark.read.schema(HOURLY_METRIC).parquet(folder).count()
            storage.switch(spark, paths.hourly_airline_metrics, folder, seen)
            return rows
        except storage.VersionConflict:
            storage.delete(spark, folder)
        except Exception:
            storage.delete(spark, folder)
            raise
    raise storage.VersionConflict(f"{ATTEMPTS} other writers came before a merge of {paths.base}")
