"""Canonical CSV snapshot of the cube with a digest-stamped manifest."""

from pyspark.sql import DataFrame, SparkSession

from booklog.operators.snapshot_checks import KEY, to_snapshot
from booklog.schema import SCHEMA_VERSION, SNAPSHOT_MANIFEST
from booklog.sources import storage
from booklog.sources.snapshot import TOTALS, Snapshot, check_metrics_file, snapshot_rows

METRICS_FILE, MANIFEST_FILE = "metrics.csv", "manifest.json"


def export_snapshot(
    spark: SparkSession,
    cube: DataFrame,
    destination: str,
    source_root: str,
    output_version: str,
) -> Snapshot:
    """Write ``metrics.csv`` and ``manifest.json``, validate them, then make them current.

    The interchange format is one sorted file, so one task writes it: it sorts with spill
    to disk and streams, holding nothing whole in memory. The cube has at most 24 hours x
    the airline codes per day. Rows, totals and digest are checked on the written file. A
    failure leaves the previous snapshot in place.
    """
    if not source_root.strip() or not output_version.strip():
        raise ValueError("blank source_root or output_version")
    staged = storage.new_version(destination)
    try:
        ordered = to_snapshot(cube).repartition(1).sortWithinPartitions(*KEY)
        ordered.write.csv(f"{staged}/csv", header=True, lineSep="\n")
        _promote(spark, f"{staged}/csv", f"{staged}/{METRICS_FILE}")
        checked = check_metrics_file(spark, f"{staged}/{METRICS_FILE}")
        manifest = {
            **checked.asDict(),
            "output_version": output_version,
            "schema_version": SCHEMA_VERSION,
            "source_hdfs_root": source_root.rstrip("/"),
        }
        row = spark.createDataFrame([manifest], SNAPSHOT_MANIFEST).coalesce(1)
        row.write.json(f"{staged}/json")
        _promote(spark, f"{staged}/json", f"{staged}/{MANIFEST_FILE}")
        storage.switch(spark, destination, staged)
    except Exception:
        storage.delete(spark, staged)
        raise
    return Snapshot(
        snapshot_rows(spark, f"{staged}/{METRICS_FILE}"),
        manifest["source_hdfs_root"],
        output_version,
        *[checked[name] for name in (*TOTALS, "metrics_sha256")],
    )


def _promote(spark: SparkSession, folder: str, file: str) -> None:
    """Turn the only part file of a one-partition write into a plain file."""
    parts = [name for name in storage.children(spark, folder) if name.startswith("part-")]
    if len(parts) != 1:
        raise OSError(f"expected one part file in {folder}, found {len(parts)}")
    storage.rename(spark, f"{folder}/{parts[0]}", file)
    storage.delete(spark, folder)
