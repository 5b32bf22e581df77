"""Hashes of words, shingles and byte windows of whole slices of text at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E6C63D0876A9A47
_TABLE = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_TABLE = _TABLE[_LOWER]
BLOCK_BYTES = 1 << 21

# Bytes of words: digits, letters and everything beyond ASCII; or everything but white space.
ALPHANUMERIC = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALPHANUMERIC[_low:_high] = True
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, *range(9, 14)]] = False

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hashes and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < count:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            values = np.full(count, base, np.uint64)
            values[0] = 1
            tables.append(np.cumprod(values, dtype=np.uint64))
        _powers = (tables[0], tables[1])
    return _powers


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of ``values[j] * base^j`` before each position."""
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, equal for equal content wherever it stands."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def word_spans(
    data: np.ndarray, bounds: np.ndarray, alphabet: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts start and end; no word crosses the bounds of a text."""
    size = len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = alphabet[data]
    begins = np.ones(size, bool)
    begins[1:] = ~inside[:-1]
    begins[bounds[bounds < size]] = True
    finishes = np.ones(size, bool)
    finishes[:-1] = ~inside[1:]
    finishes[bounds[bounds > 0] - 1] = True
    return np.flatnonzero(inside & begins), np.flatnonzero(inside & finishes) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word with A-Z in lower case, in blocks of bounded memory."""
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        low = starts[done]
        after = max(int(np.searchsorted(ends, low + BLOCK_BYTES, "right")), done + 1)
        sums = prefix_sums(LOWER_TABLE[data[low : ends[after - 1]]])
        hashes[done:after] = span_hashes(sums, starts[done:after] - low, ends[done:after] - low)
        done = after
    return hashes


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words; of all words where there are fewer."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    count = len(words) - size + 1
    total = np.full(count, size, np.uint64)
    for at in range(size):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total ^= mix(words[at : at + count] + np.uint64(at))
    return mix(total)
