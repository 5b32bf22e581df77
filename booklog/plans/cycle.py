"""Ingest, merge, validate, export, publish, validate: one refresh of the serving table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.config import Ingest, Store
from booklog.operators.audit import one_row, pipeline_summary
from booklog.sinks.cube import publish_metrics
from booklog.sinks.publication import Publication, publish, validate_serving
from booklog.sinks.snapshot import export_snapshot
from booklog.sources import batches
from booklog.sources.serving import ServingPaths
from booklog.streaming.query import start_query


@dataclass(frozen=True)
class Cycle:
    cube_rows: int
    publication: Publication


def output_counts(spark: SparkSession, paths: Store) -> DataFrame:
    """Row counts of the five datasets and whether they are consistent."""
    sizes = {
        "raw": batches.raw_events(spark, paths),
        "clean": batches.clean_events(spark, paths),
        "dead": batches.dead_letters(spark, paths),
        "quality_rows": batches.quality_metrics(spark, paths),
        "final_metric_rows": batches.hourly_metrics(spark, paths),
    }
    counts = one_row(*[df.agg(F.count(F.lit(1)).alias(name)) for name, df in sizes.items()])
    return counts.withColumn("valid", F.expr("raw >= clean AND quality_rows > 0"))


def inspect_outputs(spark: SparkSession, paths: Store) -> DataFrame:
    """Conservation summary of the stored pipeline outputs."""
    return pipeline_summary(
        batches.raw_events(spark, paths),
        batches.clean_events(spark, paths),
        batches.dead_letters(spark, paths),
        batches.quality_metrics(spark, paths),
    )


def refresh(
    spark: SparkSession,
    ingest: Ingest,
    serving: ServingPaths,
    snapshot_folder: str,
    records: DataFrame,
) -> Cycle:
    """Run the whole chain once over whatever is new in the stream of ``records``."""
    paths = ingest.store
    start_query(records, ingest).awaitTermination()
    rows = publish_metrics(spark, paths)
    if not output_counts(spark, paths).first().valid:
        raise RuntimeError(f"inconsistent outputs below {paths.root}")
    cube = batches.hourly_metrics(spark, paths)
    snapshot = export_snapshot(spark, cube, snapshot_folder, paths.base, paths.version)
    publication = publish(spark, snapshot, serving)
    matches, message = validate_serving(spark, snapshot, serving)
    if not matches:
        raise RuntimeError(message)
    return Cycle(rows, publication)
