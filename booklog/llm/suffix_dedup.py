"""Removal of byte strings that occur twice anywhere in the corpus, with suffix arrays.

A window is a string of ``LENGTH`` bytes. Equal windows must meet in one task without moving
every window, so the windows of a text are dealt by their least ``GRAM``-byte gram: neighbours
mostly share it and travel as one run. Runs travel as digests first. Only runs whose gram occurs
in other content are then fetched, once per content, sorted by two-stage suffix sorting, and
compared by adjacent common prefixes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, powers
from .shared import batch_of, filter_of, in_filter, stored, text_key, text_slices, where_in, whole_text
from .suffixes import byte_sums, repeated_windows

LENGTH = 400
GRAM = 64
# For passages of fifty words: as many words of four letters with a blank, and a gram in it.
PASSAGE = 250
PASSAGE_GRAM = 48
RUN_WINDOWS = 512
SEGMENT = (1 << 20) - 1024
# Content of one gram that a single suffix array takes; more is compared window by window.
GROUP_BYTES = 1 << 20
_PLACE = np.uint64((1 << 20) - 1)
RUNS = "gram long, again boolean, c1 long, c2 long, key_1 long, key_2 long, start long, windows int"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    count = len(values) - width + 1
    rows = -(-len(values) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(values)] = values
    grid = grid.reshape(rows, width)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    since = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:count], upto[width - 1 : width - 1 + count])


def runs_of(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one least gram: ``text, start, windows, gram, again``, in segments.

    ``again`` tells that a run holds its gram more than once, so that a window may repeat
    within the run itself. Cutting runs anywhere is allowed, as a window keeps its gram.
    """
    size = len(data)
    allowed = np.zeros(size + 1, np.int64)
    long = np.flatnonzero(np.diff(bounds) >= length)
    np.add.at(allowed, bounds[long], 1)
    np.add.at(allowed, bounds[long + 1] - length + 1, -1)
    allowed = np.cumsum(allowed[:-1]) > 0
    width = length - gram + 1
    for low in range(0, size - length + 1, SEGMENT):
        part = data[low : low + SEGMENT + length - 1]
        mine = allowed[low : low + len(part) - length + 1]
        if not mine.any():
            continue
        sums = byte_sums(part)
        grams = mix((sums[gram:] - sums[:-gram]) * powers(len(sums))[1][: len(sums) - gram]) & ~_PLACE
        places = np.arange(len(grams), dtype=np.uint64)
        first = _sliding_least(grams | places, width)
        last = _sliding_least(grams | (_PLACE - places), width)
        least = first & ~_PLACE
        changes = np.ones(len(mine), bool)
        changes[1:] = (least[1:] != least[:-1]) | ~mine[:-1]
        starts = np.flatnonzero(changes & mine)
        stops = np.flatnonzero(mine & np.append(changes[1:] | ~mine[1:], True)) + 1
        pieces = -(-(stops - starts) // RUN_WINDOWS)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins = np.repeat(starts, pieces) + at * RUN_WINDOWS
        counts = np.minimum(np.repeat(stops, pieces) - begins, RUN_WINDOWS)
        tail = _PLACE - (last[begins + counts - 1] & _PLACE)
        again = tail != (first[begins] & _PLACE)
        texts = np.searchsorted(bounds, low + begins, "right") - 1
        yield texts, low + begins, counts, (least[begins] >> np.uint64(20)).astype(np.int64), again


def _contents(data: np.ndarray, starts, counts, length: int):
    return [
        data[a : a + n + length - 1].tobytes() for a, n in zip(starts.tolist(), counts.tolist(), strict=True)
    ]


def _digests(contents: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, contents)), ">i8").astype(np.int64).reshape(-1, 2)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*text_key(whole_text()), whole_text().alias("text"))


def text_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    schema = pa.schema(
        [
            ("gram", pa.int64()), ("again", pa.bool_()), ("c1", pa.int64()), ("c2", pa.int64()),
            ("key_1", pa.int64()), ("key_2", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()),
        ]
    )

    def extract(batches):
        for rows, data, bounds in text_slices(batches, "text"):
            for texts, starts, counts, grams, again in runs_of(data, bounds, length, gram):
                digests = _digests(_contents(data, starts, counts, length))
                keys = [rows.column(k).to_numpy()[texts] for k in ("key_1", "key_2")]
                yield batch_of(schema, grams, again, digests[:, 0], digests[:, 1], *keys, starts - bounds[texts], counts)

    return _keyed(docs).mapInArrow(extract, RUNS)


def _in_bitmap(df: DataFrame, bitmap: np.ndarray, column: str) -> DataFrame:
    return df.filter(where_in(bitmap, df.sparkSession, F.col(column)))


def candidate_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs whose gram occurs twice, stored; equal runs at equal places of equal texts once, counted.

    The grams that occur twice go to the tasks as a bitmap of fixed size. It lets through too
    much where it is full, which costs time, and never drops a run.
    """
    runs = stored(text_runs(docs, length, gram), "suffix-runs")
    grams = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
    repeated = filter_of(grams.filter("n > 1 OR again"), "gram")
    kept = _in_bitmap(runs, repeated, "gram")
    return stored(kept.groupBy(*runs.columns).agg(F.count(F.lit(1)).alias("copies")), "suffix-candidates")


def fetched(docs: DataFrame, bitmap: np.ndarray, length: int, gram: int) -> DataFrame:
    """The bytes of runs whose gram is in the bitmap, once per gram and content."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("content", pa.binary())])

    def fetch(batches):
        for rows, data, bounds in text_slices(batches, "text"):
            for _, starts, counts, grams, _ in runs_of(data, bounds, length, gram):
                wanted = in_filter(shared.value, grams)
                contents = _contents(data, starts[wanted], counts[wanted], length)
                digests = _digests(contents)
                yield batch_of(schema, grams[wanted], digests[:, 0], digests[:, 1], contents)

    found = docs.select(whole_text().alias("text")).mapInArrow(fetch, "gram long, c1 long, c2 long, content binary")
    return found.dropDuplicates(["gram", "c1", "c2"])


def _spans(repeated: np.ndarray) -> list[dict]:
    edges = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    return [
        {"low": a, "high": b}
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)
    ]


MARKS = "gram long, c1 long, c2 long, spans array<struct<low:int,high:int>>"


def sorted_marks(contents: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows of each content, from suffix arrays over whole gram groups."""
    span = pa.struct([("low", pa.int32()), ("high", pa.int32())])
    schema = pa.schema([("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("spans", pa.list_(span))])

    def compare(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            found = repeated_windows([x[3] for x in held], length)
            rows = [(*x[:3], _spans(y)) for x, y in zip(held, found, strict=True) if y.any()]
            held.clear()
            return batch_of(schema, *(list(x) for x in zip(*rows, strict=True))) if rows else None

        last = None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("gram", "c1", "c2", "content")]
            for row in zip(*columns, strict=True):
                if row[0] != last and size >= GROUP_BYTES // 2:
                    if (found := flush()) is not None:
                        yield found
                    size = 0
                last = row[0]
                held.append(row)
                size += len(row[3])
        if held and (found := flush()) is not None:
            yield found

    dealt = contents.repartition("gram").sortWithinPartitions("gram")
    return dealt.select("gram", "c1", "c2", "content").mapInArrow(compare, MARKS)


def counted_marks(contents: DataFrame, length: int) -> DataFrame:
    """The same for grams with too much content for one task: windows as hashes, counted."""
    schema = pa.schema([(n, pa.int64()) for n in ("gram", "window", "c1", "c2", "at")])

    def windows(batches):
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("gram", "c1", "c2", "content")), strict=True):
                sums = byte_sums(np.frombuffer(row[3], np.uint8))
                count = len(row[3]) - length + 1
                hashes = mix((sums[length:] - sums[:-length]) * powers(len(sums))[1][:count]).view(np.int64)
                yield batch_of(schema, [row[0]] * count, hashes, [row[1]] * count, [row[2]] * count, np.arange(count))

    each = contents.select("gram", "c1", "c2", "content").mapInArrow(
        windows, "gram long, window long, c1 long, c2 long, at long"
    )
    twice = each.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return (
        each.join(twice, ["gram", "window"])
        .groupBy("gram", "c1", "c2")
        .agg(
            F.collect_list(
                F.struct(F.col("at").cast("int").alias("low"), (F.col("at") + 1).cast("int").alias("high"))
            ).alias("spans")
        )
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``key_1, key_2, spans``: starts of windows that also start elsewhere, per distinct text."""
    runs = candidate_runs(docs, length, gram)
    contents = runs.groupBy("gram", "c1", "c2").agg(
        F.sum("copies").alias("copies"), F.max("windows").alias("windows"), F.max("again").alias("again")
    )
    contents = stored(contents, "suffix-contents")
    groups = contents.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), F.sum(F.col("windows") + length - 1).alias("bytes")
    )
    mixed = groups.filter("n > 1 OR again")
    pieces = fetched(docs, filter_of(mixed, "gram"), length, gram).join(mixed.select("gram", "bytes"), "gram")
    pieces = stored(pieces, "suffix-pieces")
    marks = sorted_marks(pieces.filter(F.col("bytes") <= GROUP_BYTES), length).unionByName(
        counted_marks(pieces.filter(F.col("bytes") > GROUP_BYTES), length)
    )
    whole = F.array(F.struct(F.lit(0).alias("low"), F.col("windows").alias("high")))
    verdicts = contents.join(marks, ["gram", "c1", "c2"], "left").select(
        "gram", "c1", "c2", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).alias("spans")
    )
    placed = runs.select("gram", "c1", "c2", "key_1", "key_2", "start").join(
        verdicts.filter("spans IS NOT NULL"), ["gram", "c1", "c2"]
    )
    moved = F.transform(
        "spans", lambda x: F.struct((F.col("start") + x["low"]).alias("low"), (F.col("start") + x["high"]).alias("high"))
    )
    return placed.groupBy("key_1", "key_2").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def _covered(spans: list[dict], size: int, length: int) -> np.ndarray:
    change = np.zeros(size + 1, np.int64)
    for span in spans:
        change[span["low"]] += 1
        change[span["high"] + length - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def _with_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All columns of ``docs`` below new names, the text, its spans; stored."""
    spans = repeated_spans(docs, length, gram)
    every = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *text_key(whole_text()))
    return every.join(spans, ["key_1", "key_2"], "left").select("doc", "spans")


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    A byte is removed where a window that covers it starts anywhere else, in the same or in
    another row; copies of a row are other rows, with equal or null ids too. Null is the empty
    text. Shorter texts than a window keep everything. Other columns are not read.
    """
    joined = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, gram)
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    schema = pa.schema(list(kinds.items()))

    def remove(batches):
        for rows, data, bounds in text_slices(batches, "text"):
            found = []
            spans = rows.column("spans").to_pylist()
            for at, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                text = data[bounds[at] : bounds[at + 1]]
                gone = _covered(spans[at] or [], len(text), length) if spans[at] else np.zeros(len(text), bool)
                begins = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
                kept = hashlib.sha256(text[~gone].tobytes() if begins else text.tobytes())
                found.append((doc_id, len(text), int(gone.sum()), begins, kept.hexdigest()))
            yield batch_of(schema, *(list(x) for x in zip(*found, strict=True)))

    read = joined.select(F.col("doc.doc_id").alias("doc_id"), whole_text("doc.text").alias("text"), "spans")
    return read.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """``docs`` with all their columns and without the repeated bytes of ``text``.

    Bytes of a character of which a part was removed go too, so that the text stays UTF-8.
    Texts without repeats stay as they are, null included; ``n_chars``, if it is a column,
    counts the new text.
    """
    joined = _with_spans(docs, length, gram)
    read = joined.select("doc", whole_text("doc.text").alias("text"), F.coalesce("spans", F.array().cast("array<struct<low:bigint,high:bigint>>")).alias("spans"))

    def remove(batches):
        for rows, data, bounds in text_slices(batches, "text"):
            cleaned = []
            for at, spans in enumerate(rows.column("spans").to_pylist()):
                if spans:
                    text = data[bounds[at] : bounds[at + 1]]
                    cleaned.append(text[~_covered(spans, len(text), length)].tobytes().decode("utf-8", "ignore"))
                else:
                    cleaned.append(None)
            yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(cleaned, pa.string())], names=["doc", "cleaned"])

    kind = joined.schema["doc"].dataType.simpleString()
    found = read.mapInArrow(remove, f"doc {kind}, cleaned string")
    columns = []
    for name in docs.columns:
        column = F.col(f"doc.`{name}`")
        if name == "text":
            column = F.coalesce("cleaned", column)
        elif name == "n_chars":
            column = F.when(F.col("cleaned").isNotNull(), F.length("cleaned").cast(docs.schema[name].dataType)).otherwise(column)
        columns.append(column.alias(name))
    return found.select(*columns)
