"""Token ids of whole texts, as the public libraries give them.

For byte-level vocabularies the pieces of a slice of texts are found with array operations and
only pieces not seen before go through the library, since few pieces make up most of a text.
Texts with a special token, and other vocabularies, go through the library as they are.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from .hashing import mix, powers, prefix_sums

GROUP_CHARS = 1 << 18
_SLOTS = 1 << 20
_POOL_IDS = 1 << 22
_ENCODERS: dict[str, Encoder] = {}
_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 0, 3


def version_digest(path: str) -> str:
    """Identifies a vocabulary by its content and the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    name = f"{library.__name__} {library.__version__} "
    return hashlib.sha256(name.encode() + Path(path).read_bytes()).hexdigest()


def is_byte_level(path: str) -> bool:
    if not path.endswith(".json"):
        return False
    found = json.loads(Path(path).read_text())
    pre, model = found.get("pre_tokenizer") or {}, found["model"]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    return (
        {k: pre.get(k) for k in plain} == plain
        and model.get("type", "BPE") == "BPE"
        and not model.get("dropout")
        and not any(found.get(k) for k in ("normalizer", "truncation", "padding"))
        and all(x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in found["added_tokens"])
    )


@lru_cache
def character_kinds() -> np.ndarray:
    """For every code point what the library's own pre-tokenizer takes it for.

    Runs of code points that another Unicode table puts together are confirmed by the library
    as one piece, and halved where it disagrees, as the two may know different versions.
    """
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    splitter = ByteLevel(add_prefix_space=False, use_regex=True)
    mates = {_LETTER: "a", _NUMBER: "1", _OTHER: "."}
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    kinds = np.full(0x110000, _SPACE, np.uint8)

    def is_one(kind: int, run: str) -> bool:
        return len(splitter.pre_tokenize_str(mates[kind] + run)) == 1

    def settle(guess: int, run: str) -> None:
        if is_one(guess, run):
            kinds[[ord(c) for c in run]] = guess
        elif len(run) == 1:
            kinds[ord(run)] = next((k for k in mates if is_one(k, run)), _SPACE)
        else:
            settle(guess, run[: len(run) // 2])
            settle(guess, run[len(run) // 2 :])

    for match in regex.finditer(r"(\p{L}{1,4096})|(\p{N}+)|(\s)|([^\s\p{L}\p{N}]{1,4096})", every):
        settle({1: _LETTER, 2: _NUMBER, 3: _OTHER, 4: _OTHER}[match.lastindex], match[0])
    return kinds


class Encoder:
    """Encodes texts with the vocabulary at ``path``; made once per worker."""

    def __init__(self, path: str, kinds: np.ndarray | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kinds = kinds
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: pieces.encode(texts, num_threads=1)
            self.specials: list[str] = []
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.library = lambda texts: [
                x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
            self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False)
            self.specials = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(_SLOTS, np.uint64)
        self.at = np.zeros(_SLOTS, np.int32)
        self.count = np.zeros(_SLOTS, np.int32)
        self.pool = np.zeros(1 << 20, np.int32)
        self.used = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self._run(texts, ids=True)

    def counts(self, texts: list[str]) -> list[int]:
        return self._run(texts, ids=False)

    def _run(self, texts: list[str], ids: bool) -> list:
        if self.kinds is None:
            found = self.library(texts)
            return [np.array(x, np.int32) for x in found] if ids else [len(x) for x in found]
        results: list = [[] for _ in texts]
        group: list[tuple[int, str]] = []
        size = 0

        def flush():
            nonlocal size
            if group:
                for (text, _), part in zip(group, self._group([x for _, x in group], ids), strict=True):
                    results[text].append(part)
            group.clear()
            size = 0

        for number, text in enumerate(texts):
            if any(x in text for x in self.specials):
                found = self.library([text])[0]
                results[number].append(np.array(found, np.int32) if ids else len(found))
                continue
            for part in safe_parts(text):
                group.append((number, part))
                size += len(part)
                if size >= GROUP_CHARS:
                    flush()
        flush()
        if ids:
            none = np.zeros(0, np.int32)
            return [x[0] if len(x) == 1 else np.concatenate([none, *x]) for x in results]
        return [sum(x) for x in results]

    def _encode_pieces(self, pieces: list[str], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has; the first ``plain`` go as one text."""
        if plain:
            one = self.whole("".join(pieces[:plain]))
            ids, counts = np.array(one.ids, np.int32), np.bincount(np.array(one.word_ids, np.int64))
            if len(counts) != plain:
                plain, ids, counts = 0, ids[:0], counts[:0]
        else:
            ids, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        rest = self.library(pieces[plain:])
        sizes = np.fromiter(map(len, rest), np.int64, len(rest))
        return np.concatenate([ids, np.array([x for y in rest for x in y], np.int32)]), np.concatenate([counts, sizes])

    def _group(self, parts: list[str], ids: bool) -> list:
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *map(len, parts)])
        starts = piece_starts(points, bounds, self.kinds)
        ends = np.append(starts[1:], len(points))
        sums = prefix_sums(mix(points.astype(np.uint64) + np.uint64(1)))
        hashes = mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])
        slots = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        if self.used > _POOL_IDS:
            self._forget()
        at, count = self.at[slots], self.count[slots]
        new = np.flatnonzero((self.known[slots] != hashes) | (count == 0))
        if len(new):
            _, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            some = new[first]
            # A blank and letters: such pieces stay pieces when they stand one after the other.
            plain = (points[starts[some]] == 32) & (ends[some] - starts[some] > 1)
            plain &= self.kinds[points[np.minimum(starts[some] + 1, len(points) - 1)]] == _LETTER
            by_kind = np.argsort(~plain, kind="stable")
            pieces = [joined[a:b] for a, b in zip(starts[some[by_kind]].tolist(), ends[some[by_kind]].tolist(), strict=True)]
            found, of_each = self._encode_pieces(pieces, int(plain.sum()))
            sizes, places = np.empty_like(of_each), np.empty_like(of_each)
            sizes[by_kind], places[by_kind] = of_each, self.used + np.cumsum(of_each) - of_each
            while self.used + len(found) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(found)] = found
            self.used += len(found)
            at[new], count[new] = places[back], sizes[back]
            self.known[slots[some]], self.at[slots[some]] = hashes[some], places
            self.count[slots[some]] = sizes
        totals = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=totals[1:])
        borders = totals[np.searchsorted(starts, bounds)]
        if not ids:
            return np.diff(borders).tolist()
        every = self.pool[np.repeat(at - totals[:-1], count) + np.arange(totals[-1])]
        return [every[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]


def encoder_source(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """A function for tasks: the worker's encoder for a vocabulary that every machine has."""
    kinds = spark.sparkContext.broadcast(character_kinds()) if is_byte_level(path) else None

    def encoder() -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[path] = Encoder(path, kinds.value if kinds else None)
        return _ENCODERS[path]

    return encoder


def safe_parts(text: str, size: int = GROUP_CHARS) -> list[str]:
    """A long text cut before single blanks between other characters, where no piece crosses."""
    parts, low = [], 0
    while len(text) - low > size:
        cut = text.find(" ", low + size)
        while cut != -1 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        parts.append(text[low:cut])
        low = cut
    parts.append(text[low:])
    return parts


def piece_starts(points: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start that lie one after the other in ``points``.

    A piece is a run of letters, numbers or other signs with one blank before it if there is
    one, a run of white space without the last before a sign, or a contraction.
    """
    size = len(points)
    if not size:
        return np.zeros(0, np.int64)
    kind = kinds[points]
    texts = bounds[:-1][bounds[:-1] < bounds[1:]]
    changes = np.ones(size, bool)
    changes[1:] = kind[1:] != kind[:-1]
    changes[texts] = True
    after_blank = np.zeros(size, bool)
    after_blank[1:] = points[:-1] == 32
    after_blank[texts] = False
    space = kind == _SPACE
    begins = changes & (space | ~after_blank)
    last = space.copy()
    last[:-1] &= ~space[1:]
    last[np.append(texts[1:], size) - 1] = False
    begins |= last
    for at in np.flatnonzero((points == 39) & changes & ~after_blank).tolist():
        end = int(bounds[np.searchsorted(bounds, at, "right")])
        tail = "".join(map(chr, points[at + 1 : min(at + 3, end)]))
        taken = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
        if tail and taken:
            begins[at + 1] = False
            if at + 1 + taken < size:
                begins[at + 1 + taken] = True
    return np.flatnonzero(begins)
