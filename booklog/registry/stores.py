"""Stored outputs that several registered queries read, written once per session."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from booklog.operators.metrics import line_metrics
from booklog.operators.records import clean_records
from booklog.plans.event_log import event_lines, read_events
from booklog.session import scratch_folder
from booklog.sinks.publication import publish
from booklog.sinks.snapshot import export_snapshot
from booklog.sources import storage
from booklog.sources.serving import ServingPaths

# Folders by session, table folder and purpose.
_SHARED: dict[tuple[str, str, str], str] = {}


def shared(spark: SparkSession, sf_dir: str, purpose: str, build: Callable[[str], None]) -> str:
    """A folder filled by ``build``, reused within the session while it exists."""
    key = (spark.sparkContext.applicationId, sf_dir, purpose)
    folder = _SHARED.get(key)
    if folder is None or not storage.exists(spark, folder):
        folder = scratch_folder(spark, purpose)
        build(folder)
        _SHARED[key] = folder
    return folder


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(read_events(spark, sf_dir))


def log_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_metrics(clean_records(log_lines(spark, sf_dir)))


def published(spark: SparkSession, sf_dir: str) -> ServingPaths:
    """The cube of the whole log, exported and published."""

    def build(root: str) -> None:
        snapshot = export_snapshot(spark, log_cube(spark, sf_dir), f"{root}/snapshot", "events-root", "v1")
        publish(spark, snapshot, ServingPaths(f"{root}/serving"))

    return ServingPaths(f"{shared(spark, sf_dir, 'published', build)}/serving")
