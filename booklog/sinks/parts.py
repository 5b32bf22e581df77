"""The canonical snapshot as ordered part files, for cubes that one task should not write."""

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from booklog.functions.digest import tree_roots
from booklog.operators.snapshot_checks import KEY, canonical_line, to_snapshot
from booklog.schema import SNAPSHOT_COLUMNS
from booklog.sources import storage
from booklog.sources.lines import file_identity
from booklog.sources.snapshot import HEADER, SnapshotError, check_metrics_parts

# Rows of a part, about 30 MB of text.
PART_ROWS = 1_000_000
# Part names have five digits, and their order is that of the file.
MOST_PARTS = 99_999
PARTS, LIST, SUMMARY = "parts", "list", "summary"

PART = "part int, file string, byte_size bigint, sha256 string"
PARTS_SUMMARY = (
    "part_count bigint, byte_size bigint, parts_sha256 string, row_count bigint, "
    "successful_response_records bigint, success_token_count bigint"
)


def export_parts(
    spark: SparkSession, cube: DataFrame, destination: str, part_rows: int = PART_ROWS
) -> str:
    """Write the snapshot as parts, check them and make them current; returns their folder.

    The parts in name order, one after the other, are byte for byte the single canonical file,
    header included. Spark deals the rows by ranges of the key, so each task sorts one part.
    ``list`` holds a row per part with its digest, ``summary`` the totals and the root of the
    digests: a change of a part, their order or number changes it. ``cube`` is read three
    times (counted, sampled, written); pass a stored one. A failure leaves the previous
    version in place. An empty cube is an error, as with the single file.
    """
    if part_rows < 1:
        raise ValueError("part_rows starts at 1")
    parts = -(-cube.count() // part_rows)
    if parts > MOST_PARTS:
        raise ValueError(f"{parts} parts; raise part_rows")
    staged = storage.new_version(destination)
    try:
        rows = to_snapshot(cube).select(F.lit(True).alias("is_row"), *KEY, canonical_line().alias("value"))
        nothing = [F.lit(None).cast(rows.schema[name].dataType).alias(name) for name in KEY]
        header = spark.range(1).select(F.lit(False).alias("is_row"), *nothing, F.lit(HEADER).alias("value"))
        dealt = header.unionByName(rows).repartitionByRange(max(1, parts), "is_row", *KEY)
        ordered = dealt.sortWithinPartitions("is_row", *KEY).select("value")
        ordered.write.option("maxRecordsPerFile", 0).text(f"{staged}/{PARTS}", lineSep="\n")
        totals = check_metrics_parts(spark, f"{staged}/{PARTS}")
        # One row per part.
        part_list(spark, staged).coalesce(1).write.json(f"{staged}/{LIST}")
        listed = spark.read.schema(PART).json(f"{staged}/{LIST}")
        row = {**_sealed(listed).asDict(), **totals.asDict()}
        spark.createDataFrame([row], PARTS_SUMMARY).coalesce(1).write.json(f"{staged}/{SUMMARY}")
        storage.switch(spark, destination, staged)
    except Exception:
        storage.delete(spark, staged)
        raise
    return staged


def part_list(spark: SparkSession, folder: str) -> DataFrame:
    """The part files of an export as they are now: number, name, size and SHA-256."""
    file = F.element_at(F.split("path", "/"), -1)
    return file_identity(spark, f"{folder}/{PARTS}").select(
        F.regexp_extract(file, r"^part-(\d+)", 1).cast("int").alias("part"),
        file.alias("file"),
        "byte_size",
        "sha256",
    )


def load_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot rows of an export whose bytes are those that it lists, else ``SnapshotError``.

    Digests suffice: rows and order were checked before the list was written.
    """
    listed = spark.read.schema(PART).option("mode", "FAILFAST").json(f"{folder}/{LIST}")
    stated = spark.read.schema(PARTS_SUMMARY).option("mode", "FAILFAST").json(f"{folder}/{SUMMARY}").first()
    found = part_list(spark, folder)
    wrong = listed.withColumnRenamed("sha256", "stated").join(found, ["part", "file", "byte_size"], "full_outer")
    first = wrong.filter(~F.col("stated").eqNullSafe(F.col("sha256"))).orderBy("part").first()
    if first is not None:
        raise SnapshotError(f"{first.file} is not as listed")
    sealed = _sealed(listed)
    for name in sealed.asDict():
        if stated is None or stated[name] != sealed[name]:
            raise SnapshotError(f"summary: wrong {name}")
    return part_rows_of(spark, folder)


def part_rows_of(spark: SparkSession, folder: str) -> DataFrame:
    """Typed rows of the parts; the first part begins with the header."""
    text = T.StructType([T.StructField(name, T.StringType()) for name in SNAPSHOT_COLUMNS])
    kinds = {"stat_hour": "int", SNAPSHOT_COLUMNS[3]: "bigint", SNAPSHOT_COLUMNS[4]: "bigint"}
    lines = spark.read.schema(text).csv(f"{folder}/{PARTS}", header=False)
    return lines.filter(F.col(SNAPSHOT_COLUMNS[0]) != SNAPSHOT_COLUMNS[0]).select(
        *[F.col(name).cast(kinds.get(name, "string")).alias(name) for name in SNAPSHOT_COLUMNS]
    )


def _sealed(listed: DataFrame) -> Row:
    digests = listed.select(
        F.lit(1).alias("snapshot"), F.col("part").alias("number"), F.lit(1).cast("long").alias("rows"),
        F.col("sha256").alias("digest"),
    )
    roots = tree_roots(digests, ["snapshot"]).select("rows", "digest")
    size = listed.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("byte_size"))
    found, bytes_ = roots.first(), size.first().byte_size
    if found is None:
        raise SnapshotError("no parts")
    return Row(part_count=found.rows, byte_size=bytes_, parts_sha256=found.digest)
