"""The confirmed lines of every source, kept up to date by a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from booklog.operators.audit import joined_runs, landed_runs, prefix_of_runs
from booklog.sources import storage

RUNS = "source_file string, first bigint, last bigint"


def start_prefix(lines: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Add the landed lines of each micro-batch to the runs stored in ``folder``.

    ``lines`` is a stream of ``source_file, source_line_number``; rows without either are left
    out, as are numbers below 1. The state is a versioned table of runs: a source without gaps
    is one row, whatever its length. Joining runs is the same done once or twice, in any
    order, so a batch that is retried after its version became current changes nothing, and
    repeated and late lines need no watermark.
    """

    def add(batch: DataFrame, _batch_id: int) -> None:
        add_lines(batch, folder)

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def add_lines(lines: DataFrame, folder: str) -> None:
    """Join landed lines to the stored runs; a writer that was overtaken fails."""
    spark = lines.sparkSession
    seen = storage.version_number(spark, folder)
    landed = lines.filter("source_file IS NOT NULL AND source_line_number >= 1")
    staged = storage.new_version(folder)
    try:
        joined_runs(landed_runs(landed).unionByName(stored_runs(spark, folder))).write.parquet(staged)
        storage.switch(spark, folder, staged, seen)
    except Exception:
        storage.delete(spark, staged)
        raise


def stored_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of landed lines that the current version holds."""
    version = storage.current(spark, folder)
    return spark.createDataFrame([], RUNS) if version is None else spark.read.schema(RUNS).parquet(version)


def live_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """``source_file, confirmed_line, distinct_lines`` as of the last finished batch."""
    return prefix_of_runs(stored_runs(spark, folder))
