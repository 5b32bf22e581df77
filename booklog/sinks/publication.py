"""Publication of whole snapshots to the serving table, with an audit log."""

from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from booklog.operators.serving import serving_rows
from booklog.operators.snapshot_checks import to_cube
from booklog.schema import PUBLICATION, SERVING_METRIC
from booklog.sources import storage
from booklog.sources.serving import (
    ServingPaths,
    find_publication,
    publication_log,
    served_digest,
    serving_table,
    serving_totals,
)
from booklog.sources.snapshot import TOTALS, Snapshot

MESSAGE_LENGTH = 1024


class PublicationError(RuntimeError):
    """The written snapshot disagrees with the validated one."""


@dataclass(frozen=True)
class Publication:
    publication_id: str
    status: str
    row_count: int
    successful_response_records: int
    success_token_count: int
    metrics_sha256: str


def publish(
    spark: SparkSession, snapshot: Snapshot, paths: ServingPaths, force: bool = False
) -> Publication:
    """Serve a snapshot, or report ``unchanged`` if it already is the one being served.

    Rows are written to a folder of their own and re-read and verified there. Appending the
    log row is the switch: the newest published row names the folder that is served. Until
    then, and after any failure, the previous snapshot stays in place. Of publications that
    overlap, the first to finish is served; the others fail and are logged so.
    """
    turn = storage.version_number(spark, paths.turns)
    if not force:
        same = find_publication(
            publication_log(spark, paths),
            snapshot.source_hdfs_root,
            snapshot.output_version,
            snapshot.metrics_sha256,
        ).first()
        if same is not None:
            served = F.col("publication_id") == same.publication_id
            if not serving_table(spark, paths).filter(served).isEmpty():
                return _result(snapshot, same.publication_id, "unchanged")

    publication_id, started = str(uuid4()), _now()
    folder = paths.snapshot(publication_id)
    try:
        rows = serving_rows(to_cube(snapshot.rows), F.lit(publication_id), F.current_timestamp())
        # Files of consecutive days, so that a range of dates opens few of them.
        dealt = rows.repartitionByRange("stat_date")
        dealt.sortWithinPartitions("stat_date", "stat_hour", "airline_code").write.parquet(folder)
        _verify(spark, snapshot, folder)
        storage.switch(spark, paths.turns, publication_id, turn)
    except Exception as error:
        try:
            storage.delete(spark, folder)
            _log(spark, paths, snapshot, publication_id, "failed", started, str(error))
        except Exception as second:  # the first error is the one to report
            error.add_note(f"the failure could not be recorded: {second}")
        raise
    _log(spark, paths, snapshot, publication_id, "published", started, None)
    return _result(snapshot, publication_id, "published")


def validate_serving(
    spark: SparkSession, snapshot: Snapshot, paths: ServingPaths
) -> tuple[bool, str]:
    """Whether the serving table holds exactly this snapshot."""
    serving = serving_table(spark, paths)
    actual = serving_totals(serving).first()
    expected = (*_totals(snapshot), 1)
    if tuple(actual) != expected:
        return False, f"served totals {tuple(actual)} differ from {expected}"
    recorded = served_digest(serving, publication_log(spark, paths)).first()
    digest = recorded and recorded.metrics_sha256
    if digest != snapshot.metrics_sha256:
        return False, f"served digest {digest} differs from {snapshot.metrics_sha256}"
    return True, "the serving table holds this snapshot"


def _verify(spark: SparkSession, snapshot: Snapshot, folder: str) -> None:
    written = spark.read.schema(SERVING_METRIC).parquet(folder)
    actual = tuple(serving_totals(written).drop("publication_count").first())
    if actual != _totals(snapshot):
        raise PublicationError(
            f"written totals {actual} differ from {_totals(snapshot)}"
        )


def _totals(snapshot: Snapshot) -> tuple[int, ...]:
    return tuple(getattr(snapshot, name) for name in TOTALS)


def _result(snapshot: Snapshot, publication_id: str, status: str) -> Publication:
    return Publication(publication_id, status, *_totals(snapshot), snapshot.metrics_sha256)


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _log(spark, paths, snapshot, publication_id, status, started, message) -> None:
    row = (
        publication_id,
        snapshot.source_hdfs_root,
        snapshot.output_version,
        *_totals(snapshot),
        snapshot.metrics_sha256,
        status,
        message and message[:MESSAGE_LENGTH],
        started,
        _now(),
    )
    spark.createDataFrame([row], PUBLICATION).coalesce(1).write.mode("append").parquet(
        paths.publications
    )
