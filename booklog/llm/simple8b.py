"""Simple-8b: whole numbers packed into 64-bit words, coded and decoded with array operations.

A word holds a selector in its top four bits and, in the other sixty, as many numbers as fit at
the width that the selector names. Numbers of more than sixty bits are escapes: their word
holds a place in a list of raw values. Words never cross blocks of ``BLOCK`` numbers.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: numbers in a word and their width in bits, by selector.
LAYOUTS = (
    (1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8),
    (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1),
)
ESCAPE = 15
BLOCK = 256
_COUNTS = np.array([count for count, _ in LAYOUTS] + [1] * (16 - len(LAYOUTS)))


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value takes, at least one."""
    bits = np.ones(len(values), np.uint8)
    left = values >> np.uint64(1)
    while left.any():
        bits += left > 0
        left = left >> np.uint64(1)
    return bits


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words``, the first word of each block (with an end), and the escaped raw values."""
    size = len(values)
    blocks = -(-size // BLOCK)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    values = np.asarray(values, np.uint64)
    bits = np.full(blocks * BLOCK, 255, np.uint8)
    bits[:size] = widths(values)
    grid = bits.reshape(blocks, BLOCK)
    # The best selector at each place: more numbers need fewer bits, so stop at the first misfit.
    best = np.full(grid.shape, -1, np.int8)
    widest, covered = grid, 1
    for selector, (count, width) in enumerate(LAYOUTS):
        while covered < count:
            step = min(covered, count - covered)
            shifted = np.full_like(grid, 255)
            shifted[:, :-step] = widest[:, step:]
            widest = np.maximum(widest, shifted)
            covered += step
        fits = widest <= width
        if not fits.any():
            break
        best[fits] = selector
    best = best.ravel()
    # Every block takes its next word at the same time.
    at = np.arange(blocks) * BLOCK
    ends = np.minimum(at + BLOCK, size)
    starts, owners = [], []
    active = np.arange(blocks)
    while len(active):
        starts.append(at[active])
        owners.append(active)
        chosen = best[at[active]]
        at[active] += np.where(chosen < 0, 1, _COUNTS[chosen])
        active = active[at[active] < ends[active]]
    start = np.concatenate(starts)
    owner = np.concatenate(owners)
    order = np.argsort(start, kind="stable")
    start, owner = start[order], owner[order]
    selected = best[start].astype(np.int64)
    words = np.zeros(len(start), np.uint64)
    for selector, (count, width) in enumerate(LAYOUTS):
        mine = np.flatnonzero(selected == selector)
        if len(mine):
            place = np.arange(count)
            parts = values[start[mine][:, None] + place] << (place * width).astype(np.uint64)
            words[mine] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(selector << 60)
    escaped = np.flatnonzero(selected < 0)
    words[escaped] = np.uint64(ESCAPE << 60) | np.arange(len(escaped), dtype=np.uint64)
    offsets = np.zeros(blocks + 1, np.uint64)
    offsets[1:] = np.cumsum(np.bincount(owner, minlength=blocks))
    return words, offsets, values[start[escaped]]


def blocks_fit(words: np.ndarray, offsets: np.ndarray, size: int) -> bool:
    """Whether each block's words, from its offset to the next, hold its share of ``size`` values."""
    blocks = -(-size // BLOCK)
    if len(offsets) != blocks + 1 or offsets.max() > len(words) or int(offsets[-1]) != len(words):
        return False
    ends = np.cumsum(np.append(0, _COUNTS[(words >> np.uint64(60)).astype(np.int64)]))
    return bool((ends[offsets.astype(np.int64)] == np.minimum(np.arange(blocks + 1) * BLOCK, size)).all())


def decode(words: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The values of consecutive words, of one block or of many."""
    selected = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selected]
    ends = np.cumsum(counts)
    values = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector, (count, width) in enumerate(LAYOUTS):
        mine = np.flatnonzero(selected == selector)
        if len(mine):
            place = np.arange(count)
            parts = (words[mine][:, None] >> (place * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
            values[(ends[mine] - count)[:, None] + place] = parts
    mine = np.flatnonzero(selected == ESCAPE)
    values[ends[mine] - 1] = raw[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return values
