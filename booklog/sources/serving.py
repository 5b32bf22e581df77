"""The serving table and the publication log, and the questions asked of them."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.operators.serving import require_rows
from booklog.schema import PUBLICATION, SERVING_METRIC
from booklog.sources import storage


@dataclass(frozen=True)
class ServingPaths:
    root: str

    @property
    def snapshots(self) -> str:
        return f"{self.root.rstrip('/')}/snapshots"

    @property
    def publications(self) -> str:
        return f"{self.root.rstrip('/')}/publications"

    @property
    def turns(self) -> str:
        return f"{self.root.rstrip('/')}/turns"

    def snapshot(self, publication_id: str) -> str:
        return f"{self.snapshots}/{publication_id}"


def publication_log(spark: SparkSession, paths: ServingPaths) -> DataFrame:
    """One row per publication attempt."""
    if not storage.exists(spark, paths.publications):
        return spark.createDataFrame([], PUBLICATION)
    return spark.read.schema(PUBLICATION).parquet(paths.publications)


def latest_publication(log: DataFrame) -> DataFrame:
    """The newest published row, or none."""
    return log.filter(F.col("status") == "published").orderBy(F.desc("completed_at"), F.desc("publication_id")).limit(1)


def recent_publications(log: DataFrame, limit: int = 10) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError(f"limit {limit} is outside 1..100")
    newest = log.orderBy(F.desc("started_at"), F.desc("publication_id")).limit(limit)
    return newest.select(
        "publication_id",
        "status",
        F.col("source_row_count").alias("row_count"),
        "metrics_sha256",
        "completed_at",
    )


def find_publication(
    log: DataFrame, source_hdfs_root: str, output_version: str, metrics_sha256: str
) -> DataFrame:
    """The newest published row of identical content from the same source."""
    same = (
        (F.col("source_hdfs_root") == source_hdfs_root)
        & (F.col("output_version") == output_version)
        & (F.col("metrics_sha256") == metrics_sha256)
    )
    return latest_publication(log.filter(same))


def is_served(serving: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate publications that the serving table holds rows of."""
    return candidates.join(serving.select("publication_id"), "publication_id", "left_semi")


def serving_table(spark: SparkSession, paths: ServingPaths) -> DataFrame:
    """Rows of the current publication; empty before the first one."""
    current = latest_publication(publication_log(spark, paths)).first()
    if current is None:
        return spark.createDataFrame([], SERVING_METRIC)
    return spark.read.schema(SERVING_METRIC).parquet(paths.snapshot(current.publication_id))


def current_publication(spark: SparkSession, paths: ServingPaths) -> DataFrame:
    log = publication_log(spark, paths)
    return require_rows(latest_publication(log), "no snapshot has been published").drop(
        "failure_message", "started_at"
    )


def serving_totals(serving: DataFrame) -> DataFrame:
    """Counts and totals that must equal the snapshot's, and the publications involved."""
    measures = ("successful_response_records", "success_token_count")
    return serving.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in measures],
        F.countDistinct("publication_id").alias("publication_count"),
    )


def served_digest(serving: DataFrame, log: DataFrame) -> DataFrame:
    """Digest recorded for the publication that is being served."""
    served = serving.agg(F.min("publication_id").alias("publication_id"))
    published = log.filter(F.col("status") == "published")
    return published.join(F.broadcast(served), "publication_id").select("metrics_sha256")
