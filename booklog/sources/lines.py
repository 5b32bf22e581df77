"""Log text with physical line numbers, and the identity of source files."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from booklog.functions import sha_state
from booklog.functions.digest import content_digests, tree_roots
from booklog.session import ship_package

# Lines whose digests are added up to that of one block.
BLOCK_LINES = 4096
# File splits whose offsets may be sent to every task: two numbers each, 64 MB in all.
SENT_SPLITS = 4_000_000
# A file is read whole to be hashed; no binary value can be larger.
WHOLE_FILE_BYTES = (1 << 31) - 1024
# Larger files are hashed split by split where no task may hold one.
STEP_FILE_BYTES = 128 << 20
_BYTE_ORDER_MARK = b"\xef\xbb\xbf"


class InvalidEncodingError(ValueError):
    """The source is not UTF-8."""


def log_lines(
    spark: SparkSession,
    path: str,
    number_across_files: bool = False,
    line_separator: str | None = None,
) -> DataFrame:
    """``source_file, line_number, raw_line`` of every physical line, numbered from 1.

    Lines end with LF, CR LF or CR unless a separator is given.

    The text is never shuffled or sorted. A row's id counts up inside its read task, so its
    line number is that id plus an offset of its file split, and the offsets come from one
    count per split. They are sent to all tasks as two numbers per split: a split of 128 MB
    makes that 1.3 MB for every 10 TB of text. More than ``SENT_SPLITS`` splits are refused
    before they are sent; larger splits (``spark.sql.files.maxPartitionBytes``) are fewer. ``number_across_files`` numbers the parts of
    a directory, in name order, as one file.
    """
    rows = split_rows(spark, path, line_separator)
    splits = rows.groupBy("source_file", "block").agg(
        F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("lines")
    )
    return numbered(rows, splits, number_across_files).select(
        "source_file", "line_number", "raw_line"
    )


def split_rows(spark: SparkSession, path: str, line_separator: str | None = None) -> DataFrame:
    """``source_file, block, row_id, raw_line``: ids count up inside each file split."""
    return spark.read.text(path, lineSep=line_separator).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("raw_line"),
    )


def numbered(rows: DataFrame, splits: DataFrame, number_across_files: bool) -> DataFrame:
    """``rows`` with ``line_number``, from the first id and the line count of every split."""
    # The windows see one row per split, not per line.
    order = Window.orderBy("source_file", "block")
    if not number_across_files:
        order = Window.partitionBy("source_file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    split = F.xxhash64("source_file", "block")
    shifts = splits.select(
        split.alias("split"),
        (F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1 - F.col("first_id")).alias("shift"),
    )
    # Counted in the task that the broadcast reads, so the bound holds before anything is sent.
    found = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    shifts = shifts.withColumn("splits", found)
    refused = F.raise_error(
        F.concat(
            F.lit(f"more than {SENT_SPLITS} file splits to number lines by: "),
            F.col("splits").cast("string"),
            F.lit("; raise spark.sql.files.maxPartitionBytes"),
        )
    )
    # Two splits with one hash would number lines wrongly, so they are an error.
    collision = F.raise_error(F.lit("two file splits share a hash"))
    offsets = shifts.groupBy("split").agg(
        F.when(F.count(F.lit(1)) == 1, F.min("shift")).otherwise(collision.cast("long")).alias("shift"),
        F.min("splits").alias("splits"),
    )
    within = F.when(F.col("splits") <= SENT_SPLITS, F.col("shift")).otherwise(refused.cast("long"))
    offsets = offsets.select("split", within.alias("shift"))
    return rows.join(F.broadcast(offsets), split == F.col("split")).select(
        *rows.columns, (F.col("row_id") + F.col("shift")).alias("line_number")
    )


def require_utf8(spark: SparkSession, path: str) -> None:
    """Raise unless every line is valid UTF-8; line breaks never split a character."""
    invalid = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    if not invalid.isEmpty():
        raise InvalidEncodingError(f"{path} is not valid UTF-8")


def file_identity(spark: SparkSession, path: str) -> DataFrame:
    """``path, byte_size, sha256`` per file, by built-in functions through Spark's file systems.

    A digest is sequential over its file, so files are the unit of parallelism, and a task
    holds one whole file. Files of 2 GiB and more are refused: no value can hold them.
    """
    files = spark.read.format("binaryFile").load(path)
    refused = F.raise_error(F.concat(F.lit("too large to hash: "), "path"))
    digest = F.when(F.col("length") <= WHOLE_FILE_BYTES, F.sha2("content", 256)).otherwise(refused)
    return files.select("path", F.col("length").alias("byte_size"), digest.alias("sha256"))


def stepwise_identity(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``file_identity``, files of any size, a task reading one file split at most.

    The splits of a file above ``STEP_FILE_BYTES`` are hashed one after the other, as the digest
    is sequential: a step is a job over the next split of every such file, and hands on the
    digests' states of 112 bytes. Steps are as many as the largest file has splits. Splits end at
    a byte 10; a stretch without one is a single value and must stay below 2 GiB. Where the splits
    do not add up to the file, as Spark unpacks it, or the hash library is missing, the file is
    hashed whole. The driver holds a row per split of the large files.
    """
    files = spark.read.format("binaryFile").load(path)
    # By the name that its splits have; blanks are escaped in it, but not in the path.
    name = F.col("_metadata.file_path").alias("name")
    rows = files.filter(F.col("length") > STEP_FILE_BYTES).select(name, "path", "length").collect()
    large = {row.name: (row.path, row.length) for row in rows}
    found = _stepwise(spark, large) if large and sha_state.is_available() else []
    if not found:
        return file_identity(spark, path)
    left = {path for path, _ in large.values()} - {row[0] for row in found}
    columns = "path string, byte_size long, sha256 string"
    small = files.filter(F.col("length") <= STEP_FILE_BYTES)
    parts = [small.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))]
    parts += [file_identity(spark, whole) for whole in sorted(left)]
    result = spark.createDataFrame(found, columns)
    for part in parts:
        result = result.unionByName(part)
    return result


def _stepwise(spark: SparkSession, large: dict[str, tuple[str, int]]) -> list[tuple[str, int, str]]:
    """Path, size and digest of the files whose splits add up to their size."""
    ship_package(spark)
    rows = spark.read.text(sorted(path for path, _ in large.values()), lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )
    # Every line with the byte that ends it; the last may have none.
    splits = rows.groupBy("path", "block", F.spark_partition_id().alias("task")).agg(
        F.sum(F.length("line") + F.lit(1).cast("long")).alias("size")
    )
    found: dict[str, list] = {}
    for split in splits.orderBy("path", "block").collect():
        found.setdefault(split.path, []).append(split)
    states, ends = {}, {}
    for path, of_file in found.items():
        missing = large[path][1] - sum(split.size for split in of_file)
        # The reader passes over a byte order mark.
        if missing in (0, -1, 3, 2):
            states[path] = sha_state.update(sha_state.begin(), _BYTE_ORDER_MARK if missing > 0 else b"")
            ends[path] = b"\n" if missing in (0, 3) else b""
    for step in range(max((len(found[path]) for path in states), default=0)):
        due = {path: found[path][step] for path in states if step < len(found[path])}
        handed = _step(spark, rows, {(s.path, s.block): states[s.path] for s in due.values()}, step == 0, due.values())
        if handed.keys() != due.keys():
            raise RuntimeError("the splits of a file changed while it was hashed")
        states |= handed
    return [(*large[path], sha_state.digest(sha_state.update(x, ends[path]))) for path, x in states.items()]


def _step(spark: SparkSession, rows: DataFrame, begun: dict, first: bool, splits) -> dict[str, bytes]:
    """The states after one split of each file; only the tasks of these splits run."""
    schema = pa.schema([("path", pa.string()), ("state", pa.binary())])

    def hashed(batches):
        held, opening = {}, set(begun) if first else set()
        for batch in batches:
            keys = list(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True))
            lines = batch.column("line").to_pylist()
            low = 0
            while low < len(keys):
                key, high = keys[low], low + 1
                if keys[-1] == key:
                    high = len(keys)
                while high < len(keys) and keys[high] == key:
                    high += 1
                if key in begun:
                    content = b"\n".join(lines[low:high])
                    if key in opening:
                        opening.discard(key)
                    else:
                        content = b"\n" + content
                    held[key] = sha_state.update(held.get(key, begun[key]), content)
                low = high
        if held:
            yield pa.record_batch([[path for path, _ in held], list(held.values())], schema=schema)

    tasks = sorted({split.task for split in splits})
    after = rows.mapInArrow(hashed, "path string, state binary").rdd
    return {row.path: bytes(row.state) for row in spark.sparkContext.runJob(after, list, tasks)}


def source_identity(spark: SparkSession, path: str) -> DataFrame:
    """File count and total size, and the digest of a source that is a single file.

    The files of a larger source have digests of their own (``file_identity``); their content
    is not read here.
    """
    sizes = spark.read.format("binaryFile").load(path).select("length")
    count, size = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    digest = file_identity(spark, path).first().sha256 if count == 1 else None
    return spark.createDataFrame(
        [(count, size, digest)], "file_count long, byte_size long, sha256 string"
    )


def tree_identity(spark: SparkSession, path: str, number_across_files: bool = False) -> DataFrame:
    """``source_file, byte_size, line_count, tree_sha256`` of files of any size.

    Files are read by splits, and the splits do not show in the result: a block is a fixed
    count of lines, each hashed with its number, and the blocks of a file are the leaves of a
    tree of digests. Size and line count enter the root, so a missing last line end changes
    it. Lines end with LF; a CR is part of its line. The shuffle carries one row per block and
    split. Spark lists no empty files, so these have no row. ``number_across_files`` takes the parts of a
    directory, in name order, as one file whose name is the given path.
    """
    lines = log_lines(spark, path, number_across_files, line_separator="\n")
    sizes = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("source_file"), "length"
    )
    if number_across_files:
        lines, sizes = (df.withColumn("source_file", F.lit(path)) for df in (lines, sizes))
    number = F.floor((F.col("line_number") - 1) / F.lit(BLOCK_LINES))
    content = F.concat(F.col("line_number").cast("string"), F.lit(":"), "raw_line")
    blocks = content_digests(lines.withColumn("number", number), ["source_file", "number"], content)
    roots = tree_roots(blocks, ["source_file"])
    files = sizes.groupBy("source_file").agg(F.sum("length").alias("byte_size"))
    root = F.concat_ws(",", "byte_size", "rows", "digest")
    return files.join(roots, "source_file").select(
        "source_file", "byte_size", F.col("rows").alias("line_count"), F.sha2(root, 256).alias("tree_sha256")
    )
