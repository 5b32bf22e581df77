"""WARC archives as Zstandard files: one frame per record, the dictionary in a leading frame.

The first frame of a file is skippable and holds the dictionary, itself compressed as the
archive convention allows. Every record is a frame of its own that states its content size.
Between frames stands an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_files, write_frames
from .shared import batch_of

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = b"P*M\x18\0\0\0\0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"

REVISIT_BYTES = 100
DICTIONARY_BYTES = 16 * 1024
DICTIONARY_PAGES = 128
DICTIONARY_SAMPLE = 8 * 1024
_STEP = 1 << 15
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def with_digests(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )


def with_originals(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``original``, the smallest page id of equal payloads of at least ``least`` bytes.

    Only digests that occur twice are joined back, and payloads are compared by SHA-256.
    Null ids count only where a payload has no other; then all its rows are originals.
    """
    keyed = with_digests(pages)
    repeated = (
        keyed.filter(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    return keyed.join(repeated, "digest", "left")


def dictionary_of(pages: DataFrame) -> bytes:
    """A compression dictionary from the start of at most ``DICTIONARY_PAGES`` payloads.

    It changes sizes only. Where there is too little to train on it holds the samples.
    """
    rows = pages.filter("html is not null").select(F.substring("html", 1, DICTIONARY_SAMPLE)).limit(DICTIONARY_PAGES)
    samples = [row[0].encode() for row in rows.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    """One WARC record; a page whose payload another page holds becomes a revisit of that."""
    revisit = original is not None and original != page_id
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", RECORD_DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if url is None:
        fields = [field for field in fields if field[0] != "WARC-Target-URI"]
    if revisit:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(original, digest)),
            ("Refers-To-Page-ID", str(original)),
        ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor().compress(dictionary)
    return np.array([DICTIONARY_MAGIC, len(packed)], "<u4").tobytes() + packed


def write_archives(pages: DataFrame, folder: str) -> None:
    """Writes one archive per partition; a revisit's record has no payload.

    A null ``html`` is an empty payload. Rows with equal payloads of some length are one
    response and its revisits, repeated rows too. No rows give archives without records.
    Columns besides ``page_id``, ``url`` and ``html`` are not read.
    """
    dictionary = dictionary_of(pages)
    columns = with_originals(pages).select("page_id", "url", "payload", "digest", "original")
    schema = pa.schema([("frame", pa.binary())])

    def compress(batches):
        packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        leading = [dictionary_frame(dictionary)]
        for batch in batches:
            found, held = [], 0
            for number in range(batch.num_rows):
                row = [batch.column(at)[number].as_py() for at in range(5)]
                found.append(packer.compress(record(*row)))
                held += len(found[-1])
                if held > 1 << 20:
                    yield batch_of(schema, leading + found)
                    found, held, leading = [], 0, []
            if found:
                yield batch_of(schema, leading + found)
                leading = []

    write_frames(columns.mapInArrow(compress, "frame binary"), folder, EMPTY_FRAME)


def archive_records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each from a frame of its own.

    Raises ValueError where the archive doesn't start with its dictionary, where a frame is
    damaged, cut short or of another length than it states.
    """
    view = memoryview(content)
    unpacker = None
    at = 0
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            body = bytes(view[at + 8 : at + 8 + size])
            if len(body) < size or at + 8 > len(view):
                raise ValueError(f"the skippable frame at byte {at} is cut short")
            if at == 0 and magic == DICTIONARY_MAGIC:
                try:
                    found = zstandard.ZstdDecompressor().decompress(body) if body[:4] == b"\x28\xb5\x2f\xfd" else body
                except zstandard.ZstdError as error:
                    raise ValueError(f"the dictionary is damaged: {error}") from error
                unpacker = zstandard.ZstdDecompressor(
                    dict_data=zstandard.ZstdCompressionDict(found) if found else None
                )
            at += 8 + size
            continue
        if unpacker is None:
            raise ValueError("the archive doesn't start with a dictionary")
        try:
            stated = zstandard.frame_content_size(view[at : at + 18])
            reader, parts, low = unpacker.decompressobj(), [], at
            while not reader.eof and at < len(view):
                chunk = view[at : at + _STEP]
                parts.append(reader.decompress(chunk))
                at += len(chunk)
            at -= len(reader.unused_data)
        except zstandard.ZstdError as error:
            raise ValueError(f"the frame at byte {at} is damaged: {error}") from error
        if not reader.eof:
            raise ValueError(f"the frame at byte {low} is cut short")
        whole = b"".join(parts)
        if stated != len(whole):
            raise ValueError(f"the frame at byte {low} states {stated} bytes and holds {len(whole)}")
        yield whole


def parse_record(data: bytes) -> tuple:
    """The columns of ``RECORDS``; raises ValueError where headers or lengths are wrong."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC 1.1 record")
    pairs = [line.partition(": ") for line in lines[1:]]
    fields = {name.lower(): value for name, colon, value in pairs if colon}
    if len(fields) != len(pairs):
        raise ValueError("a header is malformed or repeated")
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"):
        if not fields.get(name):
            raise ValueError(f"{name} is missing")
    length = _whole(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("the block's length is wrong")
    if fields.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("the block's digest is wrong")
    http, mark, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length: (\d+)\r?$", http)
    if not mark or not stated:
        raise ValueError("the HTTP header is malformed")
    kind, size = fields["warc-type"], int(stated[1])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    refers_to = fields.get("refers-to-page-id")
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload differs from its length or digest")
    elif kind != "revisit" or payload or refers_to is None:
        raise ValueError("neither a response nor a revisit that names its original")
    page_id = fields.get("page-id")
    return (
        None if page_id is None else int(page_id), fields.get("warc-target-uri"), size, digest, kind,
        None if refers_to is None else int(refers_to), payload if kind == "response" else None,
    )


def _whole(text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise ValueError(f"{text!r} is not a length")
    return int(text)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The ``RECORDS`` of all archives of a folder; a file is read by one task.

    Any malformed archive or record fails the read with its file and reason.
    """
    columns = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in columns.split(", "))])

    def parse(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                try:
                    for data in archive_records(content.as_buffer().to_pybytes()):
                        rows.append(parse_record(data)[: len(schema)])
                        held += len(data) if with_payload else 256
                        if held > 1 << 20:
                            yield batch_of(schema, *map(list, zip(*rows, strict=True)))
                            rows, held = [], 0
                except ValueError as error:
                    raise ValueError(f"{file}: {error}") from error
                if rows:
                    yield batch_of(schema, *map(list, zip(*rows, strict=True)))

    return read_files(spark, folder).mapInArrow(parse, columns)
