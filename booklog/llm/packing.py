"""Token sequences by concatenate and cut, with global offsets from two passes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder_source
from .shared import SLICE_BYTES, batch_of, stored, text_slices, whole_text

WINDOW = 2048
END_ID = 1
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """First pass, stored: each document's ids, its partition, and its start in the partition."""
    encoder = encoder_source(docs.sparkSession, path)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("part", pa.int64()), ("start_in_part", pa.int64()), ("ids", pa.binary())]
    )

    def encode(batches):
        part, used = TaskContext.get().partitionId(), 0
        for rows, _, _ in text_slices(batches, "text"):
            found = [np.append(x, end_id) for x in encoder().encode(rows.column("text").to_pylist())]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            starts = used + np.cumsum(sizes) - sizes
            used += int(sizes.sum())
            ids = [x.astype("<u4").tobytes() for x in found]
            yield batch_of(schema, rows.column("doc_id"), [part] * len(ids), starts, ids)

    read = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    columns = "doc_id long, part long, start_in_part long, ids binary"
    return stored(read.mapInArrow(encode, columns), "packing-ids")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in gapless sequences of ``window`` ids; only the last may be shorter.

    The ids of all documents form one stream, in the order in which the input's partitions
    hold them. The first pass encodes and stores them; the totals of its partitions, one number
    each, give every partition its offset in the stream. The second pass cuts each document
    where the stream reaches a multiple of ``window``: a document across a boundary gives one
    record on either side. Nothing is shuffled. A null or empty text is its end id alone;
    repeated rows and null ids are documents of their own; a long text spans as many sequences
    as it fills. Columns besides ``doc_id`` and ``text`` are not read. ``with_ids`` adds the ids of each
    piece.
    """
    spark = docs.sparkSession
    ids = encoded(docs, path, end_id)
    size = F.octet_length("ids").cast("long") / F.lit(4)
    totals = ids.groupBy("part").agg(F.sum(size.cast("long")).alias("total")).orderBy("part").collect()
    parts = np.array([row.part for row in totals], np.int64)
    before = np.cumsum([0, *(row.total for row in totals)])[:-1].astype(np.int64)
    offsets = spark.sparkContext.broadcast((parts, before))
    names = [x.split()[0] for x in PIECES.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.binary())] * with_ids)

    def cut(batches):
        parts, before = offsets.value
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("doc_id", "part", "start_in_part")]
            rows, held = [], 0
            for number, (doc_id, part, within) in enumerate(zip(*columns, strict=True)):
                found = batch.column("ids")[number].as_buffer()
                total = found.size // 4
                begin = int(before[np.searchsorted(parts, part)]) + within
                start = 0
                while start < total:
                    length = min(total - start, window - (begin + start) % window)
                    piece = found.slice(4 * start, 4 * length)
                    place = divmod(begin + start, window)
                    row = (doc_id, start, length, zlib.crc32(piece), total, *place)
                    rows.append((*row, piece.to_pybytes()) if with_ids else row)
                    held += 4 * length * with_ids + 64
                    start += length
                    if held > SLICE_BYTES:
                        yield batch_of(schema, *map(list, zip(*rows, strict=True)))
                        rows, held = [], 0
            if rows:
                yield batch_of(schema, *map(list, zip(*rows, strict=True)))

    return ids.mapInArrow(cut, PIECES + ", ids binary" * with_ids)
