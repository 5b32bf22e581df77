"""Helpers of the operators: stored intermediate tables, Arrow text slices, fixed-size bitmaps."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from booklog.session import scratch_folder, ship_package  # noqa: F401

# Bits of a filter that is sent to every task: 4 MiB, whatever the size of the data.
FILTER_BITS = 1 << 25
SLICE_BYTES = 1 << 19


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read again.

    Cuts the lineage: a lost executor costs the tasks of one later stage, never this work.
    """
    folder = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_by(df: DataFrame, purpose: str, key: str) -> DataFrame:
    """``df`` stored in buckets of ``key``, so that a join on it moves the other side only.

    The catalog forgets the table at once; its files stay like those of ``stored``.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, purpose)
    name = folder.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", folder).saveAsTable(name)
    read = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return read


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def whole_text(name: str = "text") -> Column:
    """A text as the operators read it: null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text, as two columns ``key_1`` and ``key_2``."""
    return [
        F.xxhash64(text).alias("key_1"),
        F.xxhash64(F.lit("second"), text).alias("key_2"),
    ]


def filter_of(df: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the hashed ``key`` values, as 64-bit words: no false negatives.

    At most ``bits / 64`` words reach the driver, however many keys there are.
    """
    slots = df.select(F.pmod(F.col(key), F.lit(bits)).cast("long").alias("slot"))
    words = (
        slots.groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("mask"))
        .toArrow()
    )
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["mask"].to_numpy()
    return bitmap.view(np.uint64)


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.astype(np.int64) % np.int64(len(bitmap) * 64)
    word = bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)
    return (word & np.uint64(1)).astype(bool)


def text_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, and where each text starts and ends in them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    found = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return found, bounds.astype(np.int64)


def give_back() -> None:
    """Returns freed memory to the machine, as workers are reused by later tasks."""
    pa.default_memory_pool().release_unused()
    library = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(library), "malloc_trim", None) if library else None
    if trim:
        trim(0)


def where_text(test: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int = SLICE_BYTES) -> Column:
    """Whether the whole text of a row passes ``test``, which takes the bytes and bounds of texts.

    Only the text goes to Python and only the answer comes back; the rows stay where they are.
    """

    @F.arrow_udf("boolean")
    def passes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            rows = pa.RecordBatch.from_arrays([array], ["text"])
            answers = [test(data, bounds) for _, data, bounds in text_slices([rows], "text", size)]
            yield pa.array(np.concatenate([np.zeros(0, bool), *answers]))

    return passes(whole_text())


def unused(df: DataFrame, name: str) -> str:
    """``name``, or what it needs to differ from all columns of ``df``."""
    while name.lower() in {column.lower() for column in df.columns}:
        name += "_"
    return name


def where_in(bitmap: np.ndarray, spark: SparkSession, key: Column) -> Column:
    """Whether a 64-bit key may be in a bitmap of ``filter_of``."""
    shared = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def known(keys: pa.Array) -> pa.Array:
        return pa.array(in_filter(shared.value, keys.to_numpy()))

    return known(key)


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows with at most ``size`` bytes of text, or a single longer text.

    Yields the rows, their bytes and the bounds of each text within these bytes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        data, bounds = text_bounds(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            low, high = bounds[first], bounds[last]
            yield batch.slice(first, last - first), data[low:high], bounds[first : last + 1] - low
            first = last
    give_back()


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, field.type)
        for c, field in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def binary_column(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in ``data``."""
    return pa.Array.from_buffers(
        pa.binary(),
        len(bounds) - 1,
        [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))],
    )
