"""Two cubes compared by digests of ranges of their keys."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.functions.digest import content_digests
from booklog.operators.audit import reconcile
from booklog.schema import DIMENSIONS, MEASURES
from booklog.session import scratch_folder

# The tree below all keys: days, then the hours of a day, then rows.
RANGES = (DIMENSIONS[:1], DIMENSIONS[:2])


def reconcile_by_ranges(spark: SparkSession, actual: DataFrame, expected: DataFrame) -> DataFrame:
    """The rows of ``reconcile``, found by descending only into ranges that differ.

    A level shuffles one digest per range and side, and stores those that differ; rows outside
    of them are left out of the next level before its shuffle. The planner knows the size of
    the stored ranges and broadcasts them only while they are small. Equal cubes shuffle no
    row at all. Each side is read three times, so pass stored cubes; their keys are unique and
    not null, as in every cube.
    """
    for keys in RANGES:
        folder = scratch_folder(spark, "ranges")
        differing_ranges(actual, expected, list(keys)).write.parquet(folder)
        ranges = spark.read.parquet(folder)
        actual, expected = (side.join(ranges, list(keys), "left_semi") for side in (actual, expected))
    return reconcile(actual, expected)


def differing_ranges(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """The ranges of keys that do not hold the same rows on both sides."""
    cells = [F.coalesce(F.col(name).cast("string"), F.lit("?")) for name in (*DIMENSIONS, *MEASURES)]
    sides = [
        content_digests(df, keys, F.concat_ws(",", *cells)).select(*keys, F.col("digest").alias(name))
        for name, df in (("left_digest", actual), ("right_digest", expected))
    ]
    joined = sides[0].join(sides[1], keys, "full_outer")
    return joined.filter(~F.col("left_digest").eqNullSafe(F.col("right_digest"))).select(*keys)
