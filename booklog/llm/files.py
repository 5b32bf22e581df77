"""Binary files written and read by Spark, so that any file system it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_frames(frames: DataFrame, folder: str, end: bytes) -> None:
    """Writes the ``frame`` column as one file per partition: each frame, then ``end``.

    A binary value read as a string keeps its bytes, and the text writer copies them as they
    are; ``end`` takes the place of the line end and must be ASCII. Spark's committer makes
    each file appear whole or not at all, and retries replace it.
    """
    frames.select(F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", end.decode("ascii")
    ).text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, content`` of every file of a folder; a file is read by one task."""
    read = spark.read.format("binaryFile").load(folder)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
