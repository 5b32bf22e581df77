"""Canonical snapshot files: one CSV and its manifest."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from booklog.operators.snapshot_checks import (
    canonical_line,
    order_violations,
    row_violation,
    snapshot_totals,
)
from booklog.schema import SCHEMA_VERSION, SHA256_HEX, SNAPSHOT_COLUMNS, SNAPSHOT_MANIFEST
from booklog.sources.lines import file_identity, log_lines

HEADER = ",".join(SNAPSHOT_COLUMNS)
TOTALS = ("row_count", "successful_response_records", "success_token_count")


class SnapshotError(ValueError):
    """Snapshot bytes, rows or manifest violate the contract."""


@dataclass(frozen=True)
class Expectations:
    """Values that the caller already knows; None means not known."""

    row_count: int | None = None
    successful_response_records: int | None = None
    success_token_count: int | None = None
    metrics_sha256: str | None = None


@dataclass(frozen=True)
class Snapshot:
    """Validated rows with their manifest values."""

    rows: DataFrame
    source_hdfs_root: str
    output_version: str
    row_count: int
    successful_response_records: int
    success_token_count: int
    metrics_sha256: str


def _numbered_lines(spark: SparkSession, csv_path: str, in_parts: bool = False) -> DataFrame:
    """Typed lines with their first violation; only LF ends a line, so a CR stays visible."""
    lines = log_lines(spark, csv_path, number_across_files=in_parts, line_separator="\n")
    fields = lines.select("line_number", "raw_line", F.split("raw_line", ",", -1).alias("v"))
    integer = {"stat_hour": "int", SNAPSHOT_COLUMNS[3]: "bigint", SNAPSHOT_COLUMNS[4]: "bigint"}
    typed = fields.select(
        "line_number",
        "raw_line",
        F.size("v").alias("column_count"),
        *[
            F.try_element_at("v", F.lit(i)).try_cast(integer.get(name, "string")).alias(name)
            for i, name in enumerate(SNAPSHOT_COLUMNS, 1)
        ],
    )
    violation = (
        F.when(F.col("column_count") != len(SNAPSHOT_COLUMNS), "wrong_column_count")
        .when(row_violation().isNotNull(), row_violation())
        .when(canonical_line() != F.col("raw_line"), "not_canonical")
    )
    return typed.select("line_number", "raw_line", *SNAPSHOT_COLUMNS, violation.alias("violation"))


def snapshot_lines(spark: SparkSession, csv_path: str) -> DataFrame:
    """Typed rows with line number and first violation; line 1 is the header."""
    return _numbered_lines(spark, csv_path).filter("line_number > 1").drop("raw_line")


def snapshot_rows(spark: SparkSession, csv_path: str) -> DataFrame:
    """The rows of a snapshot file that is known to be valid."""
    schema = T.StructType(
        [
            T.StructField(name, T.StringType() if name in ("stat_date", "airline_code") else kind)
            for name, kind in zip(
                SNAPSHOT_COLUMNS,
                (None, T.IntegerType(), None, T.LongType(), T.LongType()),
            )
        ]
    )
    return spark.read.schema(schema).csv(csv_path, header=True, enforceSchema=False)


def read_manifest(spark: SparkSession, path: str) -> Row:
    rows = spark.read.schema(SNAPSHOT_MANIFEST).option("mode", "FAILFAST").json(path).take(2)
    if len(rows) != 1:
        raise SnapshotError("manifest: not one JSON object")
    return rows[0]


def manifest_violation(df: DataFrame) -> DataFrame:
    """Manifest rows with the first rule they break."""

    def blank(name: str):
        return F.col(name).isNull() | (F.trim(name) == "")

    bad_total = F.lit(False)
    for name in TOTALS:
        bad_total = bad_total | F.col(name).isNull() | (F.col(name) < 0)
    digest = F.coalesce(F.col("metrics_sha256"), F.lit(""))
    return df.withColumn(
        "violation",
        F.when(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "schema_version")
        .when(blank("source_hdfs_root") | blank("output_version"), "source_identity")
        .when(bad_total, "totals")
        .when(~digest.rlike(SHA256_HEX), "sha256"),
    )


def check_metrics_file(spark: SparkSession, csv_path: str) -> Row:
    """Totals and digest of a canonical metrics file; raises ``SnapshotError`` for others."""
    totals = _checked_totals(spark, csv_path, in_parts=False)
    return Row(**totals.asDict(), metrics_sha256=file_identity(spark, csv_path).first().sha256)


def check_metrics_parts(spark: SparkSession, folder: str) -> Row:
    """Totals of part files that make one canonical metrics file in name order, or ``SnapshotError``."""
    return _checked_totals(spark, folder, in_parts=True)


def _checked_totals(spark: SparkSession, path: str, in_parts: bool) -> Row:
    """The bytes are canonical when the header and every line are, keys strictly ascend (so
    none repeats), and the lines with one LF each add up to the size. None of this needs the
    text in one place.
    """
    lines = _numbered_lines(spark, path, in_parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        is_row, broken = F.col("line_number") > 1, F.col("violation").isNotNull()
        found = lines.agg(
            F.max(F.when(~is_row, F.col("raw_line"))).alias("header"),
            F.min(F.when(is_row & broken, F.struct("line_number", "violation"))).alias("broken"),
            F.sum(F.octet_length("raw_line") + 1).alias("bytes"),
        ).first()
        if found.header is None:
            raise SnapshotError("no header line")
        if found.header != HEADER:
            raise SnapshotError(f"wrong header: {found.header!r}")
        if found.broken is not None:
            raise SnapshotError(f"line {found.broken.line_number}: {found.broken.violation}")
        rows = lines.filter("line_number > 1")
        unordered = order_violations(rows).orderBy("line_number").first()
        if unordered is not None:
            kind = "repeated key" if unordered.repeated else "out of order"
            raise SnapshotError(f"line {unordered.line_number}: {kind}")
        totals = snapshot_totals(rows).first()
        if totals.row_count == 0:
            raise SnapshotError("no rows")
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
        if size != found.bytes:
            raise SnapshotError("line ends are not canonical")
        return totals
    finally:
        lines.unpersist()


def load_snapshot(
    spark: SparkSession,
    csv_path: str,
    manifest_path: str,
    expectations: Expectations | None = None,
) -> Snapshot:
    """Read and independently validate a snapshot; raises ``SnapshotError``."""
    actual = check_metrics_file(spark, csv_path)
    manifest = manifest_violation(
        spark.createDataFrame([read_manifest(spark, manifest_path)], SNAPSHOT_MANIFEST)
    ).first()
    if manifest.violation is not None:
        raise SnapshotError(f"manifest: bad {manifest.violation}")
    for name in (*TOTALS, "metrics_sha256"):
        wanted = getattr(expectations, name, None)
        for source, value in (("manifest", manifest[name]), ("expectation", wanted)):
            if value is not None and value != actual[name]:
                raise SnapshotError(f"{source} says {name} is {value!r}, the file has {actual[name]!r}")
    return Snapshot(
        snapshot_rows(spark, csv_path),
        manifest.source_hdfs_root,
        manifest.output_version,
        *[actual[name] for name in (*TOTALS, "metrics_sha256")],
    )
