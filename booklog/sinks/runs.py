"""Sums of closed runs of batches, so that a merge reads a few runs instead of every batch.

A run of level ``l`` holds the deltas of ``FAN ** l`` batches, the first a multiple of that
number, and its folder names them. It is built from the runs one level below, once all its
batches are committed, and dropped when one of them is written again. Any range of batches is
the union of at most ``2 * FAN`` runs a level. The number is kept with the runs.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from booklog.config import Store
from booklog.operators.metrics import merge_metrics
from booklog.schema import DIMENSIONS, HOURLY_DELTA, HOURLY_METRIC
from booklog.sources import ledger, storage

FAN = 8
_FIRST = T.StructField("first", T.LongType())


def _level(paths: Store, level: int) -> str:
    return f"{paths.hourly_airline_runs}/level={level}"


def _fan(spark: SparkSession, paths: Store) -> int:
    file = f"{paths.hourly_airline_runs}/_fan"
    return int(storage.read_text(spark, file)) if storage.exists(spark, file) else FAN


def closed_runs(spark: SparkSession, paths: Store) -> list[set[int]]:
    """The first batches of all runs, by level; level 0 is the batches themselves."""
    found: list[set[int]] = [set()]
    while storage.exists(spark, folder := _level(paths, len(found))):
        names = storage.children(spark, folder)
        found.append({int(name.partition("=")[2]) for name in names if name.startswith("first=")})
    return found


def _read(spark: SparkSession, paths: Store, level: int, ranges: ledger.Ranges) -> DataFrame:
    """Runs of one level that begin in the ranges, with ``first``."""
    if level == 0:
        read = spark.read.schema(HOURLY_DELTA).parquet(paths.hourly_airline_deltas)
        return read.filter(ledger.in_ranges("batch_id", ranges)).withColumnRenamed("batch_id", "first")
    read = spark.read.schema(T.StructType([*HOURLY_METRIC.fields, _FIRST])).parquet(_level(paths, level))
    return read.filter(ledger.in_ranges("first", ranges))


def drop_runs(spark: SparkSession, paths: Store, batch_id: int) -> None:
    """Removes every run that holds a batch: one a level."""
    level, fan = 1, _fan(spark, paths)
    size = fan
    while storage.exists(spark, folder := _level(paths, level)):
        storage.delete(spark, f"{folder}/first={batch_id // size * size}")
        size, level = size * fan, level + 1


def close_runs(spark: SparkSession, paths: Store, fan: int = FAN) -> int:
    """Builds the runs that are missing, one job a level; returns how many.

    The first call fixes how many runs make one of the next level.
    """
    storage.claim(spark, f"{paths.hourly_airline_runs}/_fan", str(fan))
    fan = _fan(spark, paths)
    visible, known, size, built = ledger.read(spark, paths).visible(), closed_runs(spark, paths), 1, 0
    for level in range(1, 64):
        size *= fan
        whole = {b * size for low, high in visible for b in range(-(-low // size), (high + 1) // size)}
        if not whole:
            break
        have = known[level] if level < len(known) else set()
        missing = sorted(whole - have)
        if missing:
            _build(spark, paths, level, size, missing)
            built += len(missing)
    return built


def _build(spark: SparkSession, paths: Store, level: int, size: int, missing: list[int]) -> None:
    """Runs appear whole by a rename; one that holds no rows is an empty folder."""
    staged = storage.new_version(f"{paths.hourly_airline_runs}/.staged")
    parts = _read(spark, paths, level - 1, ledger.joined([(x, x + size - 1) for x in missing]))
    start = (F.floor(F.col("first") / size) * size).cast("long")
    sums = parts.withColumn("first", start).groupBy("first", *DIMENSIONS)
    names = [field.name for field in HOURLY_METRIC.fields if field.name not in DIMENSIONS]
    found = sums.agg(*[F.sum(name).alias(name) for name in names])
    found.repartition("first").write.partitionBy("first").parquet(staged)
    for first in missing:
        run = f"{_level(paths, level)}/first={first}"
        storage.make_folder(spark, f"{staged}/first={first}")
        storage.rename(spark, f"{staged}/first={first}", run)
    storage.delete(spark, staged)


def cover(visible: ledger.Ranges, runs: list[set[int]], fan: int) -> list[list[int]]:
    """By level the first batches of runs that together hold every visible batch once."""
    found: list[list[int]] = [[] for _ in runs]
    for low, high in visible:
        at = low
        while at <= high:
            level = len(runs) - 1
            while level and (at not in runs[level] or at + fan**level - 1 > high):
                level -= 1
            found[level].append(at)
            at += fan**level
    return found


def merged_runs(spark: SparkSession, paths: Store) -> DataFrame:
    """The cube of every committed batch, from as few runs as there are."""
    visible = ledger.read(spark, paths).visible()
    cube = spark.createDataFrame([], HOURLY_METRIC)
    parts = []
    for level, firsts in enumerate(cover(visible, closed_runs(spark, paths), _fan(spark, paths))):
        if firsts:
            ranges = ledger.joined([(x, x) for x in firsts])
            parts.append(_read(spark, paths, level, ranges).select(*cube.columns))
    for part in parts:
        cube = cube.unionByName(part) if part is not parts[0] else part
    return merge_metrics(cube)
