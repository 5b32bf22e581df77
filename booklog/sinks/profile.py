"""The source profile as a folder of artifacts."""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.operators import profile
from booklog.operators.audit import one_row
from booklog.operators.snapshot_checks import KEY, to_snapshot
from booklog.session import scratch_folder
from booklog.sources import storage
from booklog.sources.lines import InvalidEncodingError, numbered, source_identity, split_rows

ARTIFACTS = (
    "profile.json",
    "hourly_airline_metrics.csv",
    "invalid_records.csv",
    "duplicate_summary.json",
    "log_type_counts.json",
    "duplicate_totals.json",
)


def write_profile(
    spark: SparkSession,
    source: str,
    output: str,
    invalid_limit: int = profile.DEFAULT_INVALID_LIMIT,
    overwrite: bool = False,
) -> DataFrame:
    """Profile a log file or folder; returns the profile row.

    ``profile.json`` is one row, ``duplicate_totals.json`` another. Whatever grows with the
    source (log types, duplicates, the cube) is a dataset of its own, in the promised order,
    written in parallel. The source is read twice, for the facts and to number the rejected
    lines, and a single file once more for its digest.
    """
    if invalid_limit < 0:
        raise ValueError("negative invalid_limit")
    if source.rstrip("/") == output.rstrip("/"):
        raise ValueError("source and output must differ")
    if storage.current(spark, output) and not overwrite:
        raise FileExistsError(f"{output} exists; pass overwrite to replace it")
    started = time.perf_counter()
    rows = split_rows(spark, source)
    staged = storage.new_version(output)
    work = scratch_folder(spark, "profile")
    try:
        profile.profile_facts(rows).write.partitionBy("kind").parquet(work)
        facts = spark.read.schema(profile.profile_facts(rows).schema).parquet(work)
        counts, cube = profile.facts_of_lines(facts), profile.facts_of_cube(facts)
        undecodable = counts.agg(F.sum("undecodable")).first()[0]
        if undecodable:
            raise InvalidEncodingError(f"{source}: {undecodable} lines are not valid UTF-8")
        to_snapshot(cube).orderBy(*KEY).write.csv(f"{staged}/{ARTIFACTS[1]}", header=True)
        rejected = profile.rejected_lines(rows)
        lines = numbered(rejected, profile.facts_of_splits(facts), number_across_files=True)
        profile.first_rejected(lines, invalid_limit).write.csv(f"{staged}/{ARTIFACTS[2]}", header=True)
        duplicates = f"{staged}/{ARTIFACTS[3]}"
        profile.duplicate_fingerprints(profile.facts_of_copies(facts)).write.json(duplicates)
        repeated = spark.read.schema("sha256 string, occurrences bigint").json(duplicates)
        profile.log_type_counts(counts).orderBy("log_type").write.json(f"{staged}/{ARTIFACTS[4]}")
        totals = profile.duplicate_totals(repeated)
        totals.coalesce(1).write.json(f"{staged}/{ARTIFACTS[5]}")
        reasons = profile.failure_reason_counts(counts).agg(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("failure_reason", "records")))
            ).alias("failure_reason_counts")
        )
        row = one_row(
            source_identity(spark, source),
            profile.profile_totals(counts, cube),
            reasons,
            profile.known_type_counts(counts),
            totals,
        ).withColumns(
            {
                "source_name": F.lit(source.rstrip("/").rpartition("/")[2]),
                "elapsed_seconds": F.lit(0.0),
            }
        )
        values = row.first().asDict()
        values["elapsed_seconds"] = time.perf_counter() - started
        row = spark.createDataFrame([values], row.schema).withColumn(
            "records_per_second", F.try_divide("physical_line_count", "elapsed_seconds")
        )
        row.coalesce(1).write.json(f"{staged}/{ARTIFACTS[0]}")
        storage.switch(spark, output, staged)
    except Exception:
        storage.delete(spark, staged)
        raise
    finally:
        storage.delete(spark, work)
    return row
