"""Vectorised word and shingle hashing shared by the corpus operators.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; everything is done on UTF-8
bytes of a whole Arrow batch at once, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every input bit."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers made by rule from a seed."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * _GOLDEN) | np.uint64(1)


_POSITION = multipliers(1024, 17)
_CLASS = np.zeros(256, dtype=bool)
_CLASS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; a null text counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    if data is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, and where each text's words begin (one more offset than texts)."""
    global _POSITION
    data, offsets = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    inside = ~_CLASS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    where = np.flatnonzero(inside)
    firsts = np.searchsorted(where, starts)
    lengths = np.diff(np.append(firsts, len(where)))
    position = np.arange(len(where)) - np.repeat(firsts, lengths)
    if lengths.max() > len(_POSITION):
        _POSITION = multipliers(1 << int(lengths.max()).bit_length(), 17)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((data[where].astype(np.uint64) + np.uint64(1)) * _POSITION[position], firsts)
    return mix64(sums), np.searchsorted(starts, offsets)


_SHINGLE = multipliers(64, 91)


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; a text of 1 to k-1 words has its whole sequence as one."""
    words, offsets = word_hashes(column)
    out = []
    with np.errstate(over="ignore"):
        n = len(words) - k + 1
        grams = mix64(sum(words[i : i + n] * _SHINGLE[i] for i in range(k)) + np.uint64(k)) if n > 0 else words[:0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                out.append(mix64(np.array([(words[a:b] * _SHINGLE[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
            else:
                out.append(words[:0])
    return out
