"""Token ids of documents as Simple-8b files in ascending order of their ids.

A file is a row of frames; all numbers are little-endian and every part is aligned to 64-bit
words. A frame: the magic, the numbers of documents, ids, blocks, words and raw values, the
CRC-32 of what follows; then document ids, a word per document that is 1 where the id is null,
the ids per document, the first word of each block with an end, the raw values, the words.
``FRAME_END`` follows each frame.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .bpe import encoder_source
from .files import read_files, write_frames
from .shared import batch_of, binary_column, give_back, stored, text_slices, whole_text

MAGIC = b"IDS8BV01"
FRAME_END = b"\nEND8B\n\n"
END_ID = 0
# Ids of a frame before it is closed, blocks decoded at a time, sampled keys per file.
FRAME_IDS = 1 << 18
STEP_BLOCKS = 512
SAMPLE_KEYS = 100
_HEADER_WORDS = 7


def frame(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    every = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.uint64)
    words, offsets, raw = simple8b.encode(every)
    body = b"".join(
        np.asarray(part).astype("<u8").tobytes()
        for part in (
            np.array([0 if x is None else x for x in doc_ids], np.int64).view(np.uint64),
            np.array([x is None for x in doc_ids], np.uint64),
            lengths, offsets, raw, words,
        )
    )
    counts = (len(ids), len(every), len(offsets) - 1, len(words), len(raw), zlib.crc32(body))
    return MAGIC + np.array(counts, "<u8").tobytes() + body


def frames(content: memoryview | bytes) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """The documents of each frame of a file; raises ValueError on anything malformed."""
    at = 0
    while at < len(content):
        if content[at : at + 8] != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        header = np.frombuffer(content, "<u8", _HEADER_WORDS - 1, at + 8).astype(np.int64)
        docs, total, blocks, words, raws, check = header.tolist()
        low = at + 8 * _HEADER_WORDS
        sizes = (docs, docs, docs, blocks + 1, raws, words)
        high = low + 8 * sum(sizes)
        if high + len(FRAME_END) > len(content) or content[high : high + 8] != FRAME_END:
            raise ValueError(f"the frame at byte {at} is cut short")
        if zlib.crc32(memoryview(content)[low:high]) != check:
            raise ValueError(f"the frame at byte {at} has a wrong checksum")
        every = np.frombuffer(content, "<u8", sum(sizes), low)
        parts = np.split(every, np.cumsum(sizes)[:-1])
        if not simple8b.blocks_fit(parts[5], parts[3], total):
            raise ValueError(f"the frame at byte {at} has wrong offsets of blocks")
        ids = _decoded(parts[5], parts[3].astype(np.int64), parts[4])
        if len(ids) != total or int(parts[2].sum()) != total:
            raise ValueError(f"the frame at byte {at} has a wrong number of ids")
        names = [
            None if null else int(name)
            for name, null in zip(parts[0].view(np.int64).tolist(), parts[1].tolist(), strict=True)
        ]
        yield names, np.split(ids, np.cumsum(parts[2].astype(np.int64))[:-1]) if docs else []
        at = high + len(FRAME_END)


def _decoded(words: np.ndarray, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The ids of all blocks, some at a time, each from its own offset on."""
    last = len(offsets) - 1
    parts = [
        simple8b.decode(words[offsets[k] : offsets[min(k + STEP_BLOCKS, last)]], raw).astype(np.uint32)
        for k in range(0, last, STEP_BLOCKS)
    ]
    return np.concatenate([np.zeros(0, np.uint32), *parts])


def key_bounds(keyed: DataFrame, count: int) -> list[tuple]:
    """Up to ``count - 1`` keys that part the rows evenly, from a sample of bounded size.

    They only decide how even the files are; every row has its place whatever they say.
    """
    rows = keyed.count()
    share = min(1.0, SAMPLE_KEYS * count / max(rows, 1))
    sample = keyed if share == 1.0 else keyed.sample(share, seed=1)
    keys = sorted(tuple(r) for r in sample.collect())
    return sorted({keys[len(keys) * k // count] for k in range(1, count)}) if keys else []


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encodes every text, appends ``end_id`` and writes the files of ``folder``.

    Texts are encoded where they are read; ids alone are shuffled, to ranges of the document id,
    null first. Rows with equal ids are told apart by their text and place in the input, so that
    a repeated id does not fill one task. Null is the empty text, whose only id is ``end_id``;
    no rows give files without documents; further columns are not read.
    """
    encoder = encoder_source(docs.sparkSession, path)
    keyed = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Null before all ids, and hashes that tell equal ids apart.
    order = (F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("tie"))
    bounds = key_bounds(keyed.select(*order), count)
    at = docs.sparkSession.sparkContext.broadcast(bounds)
    columns = [("bucket", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("place", pa.int64())]
    coded, framed = pa.schema([*columns, ("wide", pa.bool_()), ("ids", pa.binary())]), pa.schema([("frame", pa.binary())])

    def encode(batches):
        for rows, _, _ in text_slices(batches, "text"):
            found = encoder().encode(rows.column("text").to_pylist())
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
            flat = np.full(int(ends[-1]), end_id, np.int64)
            taken = np.ones(len(flat), bool)
            taken[ends - 1] = False
            flat[taken] = np.concatenate(found)
            kind = np.dtype("<u4" if flat.max() >> 16 else "<u2")
            ids = binary_column(flat.astype(kind).view(np.uint8), np.append(0, ends) * kind.itemsize)
            wide = [kind.itemsize == 4] * len(found)
            doc_ids, ties = (rows.column(n).to_pylist() for n in ("doc_id", "tie"))
            keys = ((x is not None, x or 0, tie) for x, tie in zip(doc_ids, ties, strict=True))
            buckets = [bisect_right(at.value, key) for key in keys]
            yield batch_of(coded, buckets, *(rows.column(n) for n in ("doc_id", "tie", "place")), wide, ids)

    def write(batches):
        held, size = [], 0
        for batch in batches:
            doc_ids, wide = batch.column("doc_id").to_pylist(), batch.column("wide").to_pylist()
            for doc_id, is_wide, found in zip(doc_ids, wide, batch.column("ids"), strict=True):
                ids = np.frombuffer(found.as_buffer(), "<u4" if is_wide else "<u2")
                held.append((doc_id, ids))
                size += len(ids)
                if size >= FRAME_IDS:
                    yield batch_of(framed, [frame(*map(list, zip(*held, strict=True)))])
                    held, size = [], 0
        if held:
            yield batch_of(framed, [frame(*map(list, zip(*held, strict=True)))])
        give_back()

    found = keyed.mapInArrow(encode, "bucket int, doc_id long, tie long, place long, wide boolean, ids binary")
    dealt = found.repartitionById(count, "bucket").sortWithinPartitions("doc_id", "tie", "place")
    write_frames(dealt.select("doc_id", "wide", "ids").mapInArrow(write, "frame binary"), folder, FRAME_END)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of the files.

    ``start`` counts the ids of all documents before it: of earlier files by their totals, one
    number per file, and of earlier documents of its file by the reading task.
    """
    schema = pa.schema(
        [(n, pa.string() if n == "file" else pa.int64()) for n in ("file", "doc_id", "within", "n_tokens", "ids_crc32")]
    )

    def decode(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                within = 0
                for names, ids in frames(memoryview(content.as_buffer()).cast("B")):
                    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                    starts = within + np.cumsum(sizes) - sizes
                    within += int(sizes.sum())
                    checks = [zlib.crc32(x.astype("<u4", copy=False)) for x in ids]
                    yield batch_of(schema, [file] * len(ids), names, starts, sizes, checks)

    columns = "file string, doc_id long, within long, n_tokens long, ids_crc32 long"
    read = stored(read_files(spark, folder).mapInArrow(decode, columns), "token-rows")
    # Files have the numbers of their tasks; names would put 100000 before 99999.
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    totals = read.groupBy("file").agg(F.sum("n_tokens").alias("total")).orderBy(number, "file").collect()
    before = np.cumsum([0, *(row.total for row in totals)]).tolist()
    offsets = spark.createDataFrame(
        [(row.file, start) for row, start in zip(totals, before, strict=False)], "file string, before long"
    )
    placed = read.join(offsets, "file")
    return placed.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
