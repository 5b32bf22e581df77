"""Suffix arrays of byte strings by two-stage sorting, and their adjacent common prefixes.

Only suffixes smaller than their successors are sorted directly. The rest follow from scans of
the buckets of equal first bytes, from the smallest: the predecessor of a suffix that is in
place takes the next free place at the front of its own bucket.
"""

from __future__ import annotations

import numpy as np

from .hashing import LOWER_TABLE, mix, powers, prefix_sums

# Every byte value has its own random number; the sums of these identify spans.
_NUMBERS = mix(np.arange(256, dtype=np.uint64) + np.uint64(1) + LOWER_TABLE[:1])
_SKIPS = (128, 32)


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_NUMBERS[data])


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    size = len(data)
    differs = np.append(data[1:] != data[:-1], True)
    places = np.where(differs, np.arange(size), size - 1)
    border = np.minimum.accumulate(places[::-1])[::-1]
    after = np.append(data[1:], 0)
    return (border < size - 1) & (data[border] < after[border])


def _eight_bytes(data: np.ndarray) -> np.ndarray:
    padded = np.append(data, np.zeros(8, np.uint8))
    words = np.zeros(len(data) + 1, np.uint64)
    for at in range(8):
        words[:-1] |= padded[at : at + len(data)].astype(np.uint64) << np.uint64(56 - 8 * at)
    return words


def directly_sorted(data: np.ndarray, suffixes: np.ndarray, depth: int, sums: np.ndarray) -> np.ndarray:
    """``suffixes`` in order of their first ``depth`` bytes.

    Eight bytes at a time; a group that agrees on all that is left is done, and one that agrees
    on a long stretch passes over it.
    """
    size = len(data)
    words = _eight_bytes(data)
    order = suffixes[np.argsort(words[suffixes], kind="stable")]
    keys = words[order]
    first = np.ones(len(order), bool)
    first[1:] = keys[1:] != keys[:-1]
    places = np.flatnonzero(~first | ~np.append(first[1:], True))
    begins = first[places]
    depths = np.full(len(places), 8)
    while len(places):
        heads = np.flatnonzero(begins)
        counts = np.diff(np.append(heads, len(places)))
        tied = order[places]

        def agrees(low, high):
            found = _hashes(sums, np.minimum(low, size), np.minimum(high, size))
            # Spans cut off by the end differ in length, and so in content.
            found += np.minimum(high, size).astype(np.uint64) - np.minimum(low, size).astype(np.uint64)
            return np.logical_and.reduceat(found == np.repeat(found[heads], counts), heads)

        done = agrees(tied + depths, tied + depth) | (depths[heads] >= depth)
        left = ~np.repeat(done, counts)
        places, begins, depths, tied = places[left], begins[left], depths[left], tied[left]
        if not len(places):
            break
        heads = np.flatnonzero(begins)
        counts = np.diff(np.append(heads, len(places)))
        for skip in _SKIPS:
            depths += skip * np.repeat(agrees(tied + depths, tied + depths + skip), counts)
        groups = np.cumsum(begins)
        keys = words[np.minimum(tied + depths, size)]
        by_key = np.lexsort((keys, groups))
        order[places] = tied[by_key]
        keys, depths = keys[by_key], depths + 8
        first = np.ones(len(places), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (groups[1:] != groups[:-1])
        still = ~first | ~np.append(first[1:], True)
        places, begins, depths = places[still], first[still], depths[still]
    return order


def suffix_array(data: np.ndarray, depth: int, sums: np.ndarray) -> np.ndarray:
    """All suffixes in order of their first ``depth`` bytes at least."""
    size = len(data)
    smaller = smaller_than_successor(data)
    array = np.full(size, -1, np.int64)
    ends = np.cumsum(np.bincount(data, minlength=256))
    starts = ends - np.bincount(data, minlength=256)
    direct = directly_sorted(data, np.flatnonzero(smaller), depth, sums)
    counts = np.bincount(data[direct], minlength=256)
    begins = ends - counts
    placed = np.cumsum(counts)
    for byte in np.flatnonzero(counts).tolist():
        array[begins[byte] : ends[byte]] = direct[placed[byte] - counts[byte] : placed[byte]]
    front = starts.copy()
    array[front[data[-1]]] = size - 1
    front[data[-1]] += 1

    def induce(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return
        heads = data[before]
        by_head = np.argsort(heads, kind="stable")
        before, heads = before[by_head], heads[by_head]
        edges = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
        for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(heads)], strict=True):
            byte = heads[low]
            array[front[byte] : front[byte] + high - low] = before[low:high]
            front[byte] += high - low

    for byte in np.flatnonzero(ends > starts).tolist():
        scanned = starts[byte]
        while scanned < front[byte]:
            low, scanned = scanned, front[byte]
            induce(array[low:scanned])
        induce(array[begins[byte] : ends[byte]])
    return array


def share_prefix(array: np.ndarray, length: int, sums: np.ndarray) -> np.ndarray:
    """Whether each suffix but the first has a common prefix of ``length`` with the one before."""
    size = len(sums) - 1
    whole = array + length <= size
    found = _hashes(sums, array, np.minimum(array + length, size))
    return whole[1:] & whole[:-1] & (found[1:] == found[:-1])


def repeated_windows(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each content which of its windows of ``length`` bytes also start elsewhere in any.

    A byte that no text has ends each content, so that no shared prefix of whole windows
    reaches beyond one.
    """
    data = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8)
    sums = byte_sums(data)
    array = suffix_array(data, length, sums)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    begins = np.cumsum(sizes + 1) - sizes - 1
    whole = np.zeros(len(data) + 1, np.int64)
    count = np.maximum(sizes - length + 1, 0)
    np.add.at(whole, begins, 1)
    np.add.at(whole, begins + count, -1)
    whole = np.cumsum(whole[:-1]) > 0
    shared = share_prefix(array, length, sums)
    repeated = np.zeros(len(data), bool)
    repeated[array[1:][shared]] = True
    repeated[array[:-1][shared]] = True
    repeated &= whole
    return [repeated[a : a + n] for a, n in zip(begins.tolist(), count.tolist(), strict=True)]
