"""Word-level BPE through distinct words: split, encode each word once, join back, decode.

For vocabularies whose pieces never cross a blank and whose text is lower-cased first. A word
here is a stretch between places where the library is certain to cut: at ASCII white space, and
between ASCII letters, digits and signs but for the apostrophe, which may open a contraction.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, binary_column, stored_by, text_bounds, text_slices, whole_text

BLOCK_BYTES = 32 << 20
STEP_WORDS = 1 << 16
_LETTER, _DIGIT, _SIGN, _BLANK = 1, 2, 3, 4
# Fixed value: the pattern by which such vocabularies cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_classes() -> np.ndarray:
    classes = np.zeros(256, np.uint8)
    classes[33:127] = _SIGN
    classes[48:58] = _DIGIT
    classes[65:91] = classes[97:123] = _LETTER
    classes[[32, *range(9, 14)]] = _BLANK
    classes[ord("'")] = 0
    return classes


_CLASSES = _byte_classes()


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _check(path: str) -> None:
    """Refuses vocabularies for which a cut at the places above isn't certain."""
    found = json.loads(Path(path).read_text())
    steps = [x["type"] for x in (found.get("normalizer") or {}).get("normalizers", [])]
    cuts = (found.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    plain = steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": PATTERN}
    if not plain or found.get("decoder") or any(not x["special"] or x["lstrip"] or x["rstrip"] for x in found["added_tokens"]):
        raise ValueError(f"{path} isn't a lower-casing word vocabulary without decoder")


def split_words(texts: pa.Array, data: np.ndarray, bounds: np.ndarray, specials: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts with A-Z in lower case, and how many each text has.

    A text that holds a special token in any case is one word as it stands.
    """
    kinds, low = _CLASSES[data], data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    whole = np.zeros(len(texts), bool)
    for special in specials:
        whole |= pc.match_substring(texts, special, ignore_case=True).to_numpy(zero_copy_only=False)
    for at in np.flatnonzero(whole).tolist():
        kinds[bounds[at] : bounds[at + 1]] = 0
        low[bounds[at] : bounds[at + 1]] = data[bounds[at] : bounds[at + 1]]
    begins = np.ones(len(data), bool)
    before, after = kinds[:-1], kinds[1:]
    begins[1:] = (before != after) & (before != 0) & (after != 0)
    begins[1:] |= (before == _DIGIT) & (after == _DIGIT)
    begins[1:] |= (before == _BLANK) != (after == _BLANK)
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(data)))
    words = kinds[starts] != _BLANK
    edges = np.append(0, np.cumsum(sizes[words]))
    counts = np.diff(np.searchsorted(starts[words], bounds))
    return binary_column(low[kinds != _BLANK], edges), counts


def _block_rows(docs: DataFrame, path: str) -> DataFrame:
    """Texts as places in the word list of their block, stored by block.

    A block is some 32 MB of consecutive texts of a task, or one longer text. Rows with
    ``words`` list its distinct words by falling frequency; rows with ``places`` hold documents.
    """
    block_of_task = 1 << 32

    def split(batches):
        part = TaskContext.get().partitionId() * block_of_task
        specials = [x.content for x in _library(path).get_added_tokens_decoder().values()]
        held, size, number = [], 0, 0
        for rows, data, bounds in text_slices(batches, "text"):
            words, counts = split_words(rows.column("text"), data, bounds, specials)
            coded = words.dictionary_encode()
            held.append((rows.column("doc_id"), counts, coded.dictionary, coded.indices.to_numpy()))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from _finished(part + number, held)
                held, size, number = [], 0, number + 1
        if held:
            yield from _finished(part + number, held)

    columns = "block long, first_slot int, words array<binary>, doc_ids array<long>, counts array<int>, places binary"
    read = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return stored_by(read.mapInArrow(split, columns), "word-blocks", "block")


_BLOCK_SCHEMA = pa.schema(
    [
        ("block", pa.int64()), ("first_slot", pa.int32()), ("words", pa.list_(pa.binary())),
        ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("places", pa.binary()),
    ]
)
LISTED_WORDS = 1 << 14


def _finished(block: int, held: list):
    """The rows of one block."""
    every = pa.chunked_array([x[2] for x in held]).combine_chunks().dictionary_encode()
    edges = np.cumsum([0, *(len(x[2]) for x in held)])
    codes = every.indices.to_numpy()
    seen = np.zeros(len(every.dictionary), np.int64)
    for (_, _, _, local), low, high in zip(held, edges[:-1], edges[1:], strict=True):
        seen += np.bincount(codes[low:high][local], minlength=len(seen))
    order = np.argsort(-seen, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    for low in range(0, len(order), LISTED_WORDS):
        listed = every.dictionary.take(pa.array(order[low : low + LISTED_WORDS])).to_pylist()
        yield batch_of(_BLOCK_SCHEMA, [block], [low], [listed], [None], [None], [None])
    packer = zstandard.ZstdCompressor(1)
    for (doc_ids, counts, _, local), low, high in zip(held, edges[:-1], edges[1:], strict=True):
        places = rank[codes[low:high]][local]
        # Planes of bytes: the upper ones are nearly always zero.
        planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        packed = packer.compress(planes.tobytes())
        yield batch_of(_BLOCK_SCHEMA, [block], [None], [None], [doc_ids.to_pylist()], [counts.astype(np.int32)], [packed])


def id_type(path: str) -> str:
    """The narrowest number that holds every id of a vocabulary."""
    return "<u2" if max(_library(path).get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``words (block, slot, word)`` with the ``ids`` of each word, encoded once.

    Rows are dealt and sorted by word, so that equal words follow one another in one task. A
    word has one row per block at most, so none is frequent enough to fill a task.
    """
    schema = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("ids", pa.binary())])
    kind = id_type(path)

    def encode(batches):
        library, last, known = _library(path), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("word"))
            distinct = [x.decode() for x in runs.values.to_pylist()]
            skip = last is not None and distinct[0] == last
            coded = library.encode_batch_fast(distinct[skip:], add_special_tokens=False)
            found = [known] * skip + [np.array(x.ids, kind).tobytes() for x in coded]
            last, known = distinct[-1], found[-1]
            each = np.repeat(np.arange(len(distinct)), np.diff(runs.run_ends.to_numpy(), prepend=0))
            ids = pa.array(found, schema.field("ids").type).take(pa.array(each))
            yield batch_of(schema, batch.column("block"), batch.column("slot"), ids)

    dealt = words.repartition("word").sortWithinPartitions("word").select("word", "block", "slot")
    return dealt.mapInArrow(encode, "block long, slot int, ids binary")


def piece_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of a vocabulary, each with a blank after it, and where that of each id lies.

    As large as the vocabulary, however much text there is.
    """
    vocabulary = _library(path).get_vocab(with_added_tokens=True)
    pieces = {number: piece.encode() + b" " for piece, number in vocabulary.items()}
    sizes = np.zeros(max(pieces) + 1, np.int64)
    sizes[list(pieces)] = [len(x) for x in pieces.values()]
    data = b"".join(pieces[number] for number in sorted(pieces))
    return np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes, sizes


def _joined(pool: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that a table has for ``keys``, one after the other, and their bounds."""
    data, starts, sizes = pool
    size = sizes[keys]
    edges = np.append(0, np.cumsum(size))
    return data[np.repeat(starts[keys] - edges[:-1], size) + np.arange(edges[-1])], edges


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def _assembled(documents: pa.Table, words: pa.Table, kind: str, pieces) -> pa.Table:
    """The digests of the documents of one block: ids by place, and pieces by id."""
    slots, ids = words.column("slot").to_numpy(), words.column("ids").combine_chunks()
    count = int(slots.max()) + 1 if len(slots) else 0
    # One more slot stands for words without ids.
    starts, sizes = np.zeros(count + 1, np.int64), np.zeros(count + 1, np.int64)
    data, edges = text_bounds(ids)
    sizes[slots] = np.diff(edges) // np.dtype(kind).itemsize
    starts[slots] = np.cumsum(sizes[slots]) - sizes[slots]
    of_words = (data[edges[0] : edges[-1]].view(kind).astype("<u4"), starts, sizes)
    found: list[tuple] = []
    columns = (documents.column(n).to_pylist() for n in ("doc_ids", "counts", "places"))
    for doc_ids, counts, packed in zip(*columns, strict=True):
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        places = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
        places = np.minimum(places.astype(np.int64), count)
        borders = np.append(0, np.cumsum(counts))
        hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in doc_ids]
        totals = [0] * len(doc_ids)
        for low in range(0, len(places), STEP_WORDS):
            some = places[low : low + STEP_WORDS]
            tokens, edges = _joined(of_words, some)
            decoded, bounds = _joined(pieces, tokens)
            for doc in range(int(np.searchsorted(borders, low, "right")) - 1, len(doc_ids)):
                a, b = max(int(borders[doc]) - low, 0), min(int(borders[doc + 1]) - low, len(some))
                if a >= len(some):
                    break
                first, last = int(edges[a]), int(edges[max(a, b)])
                if first == last:
                    continue
                hashes[doc][0].update(tokens[first:last])
                # The blank that parts pieces goes before a text's next ones, never after its last.
                if totals[doc]:
                    hashes[doc][1].update(b" ")
                hashes[doc][1].update(decoded[bounds[first] : bounds[last] - 1])
                totals[doc] += last - first
        found += [(d, n, x.hexdigest(), y.hexdigest()) for d, n, (x, y) in zip(doc_ids, totals, hashes, strict=True)]
    rows = map(list, zip(*found, strict=True)) if found else [[]] * 4
    return pa.Table.from_batches([batch_of(_RESULT, *rows)], _RESULT)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs``.

    Tasks split their texts and store them as places in the word lists of blocks. Each distinct
    word is encoded once; its ids go back to the blocks that list it and meet the pieces there,
    whose table, bounded by the vocabulary, every task has. Null and empty texts, and texts of white space, have no ids and decode to
    the empty text. Repeated rows and null ids give rows of their own; further columns are not
    read. A text is held whole by its task, whatever its length.
    """
    _check(path)
    blocks = _block_rows(docs, path)
    listed = blocks.filter("words IS NOT NULL").select("block", "first_slot", F.posexplode("words").alias("at", "word"))
    words = listed.select("block", (F.col("first_slot") + F.col("at")).alias("slot"), "word")
    coded = encode_words(words, path).repartition("block")
    kind, pieces = id_type(path), docs.sparkSession.sparkContext.broadcast(piece_table(path))

    def assemble(documents: pa.Table, words: pa.Table) -> pa.Table:
        return _assembled(documents, words, kind, pieces.value)

    documents = blocks.filter("places IS NOT NULL").select("block", "doc_ids", "counts", "places")
    result = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, result)
