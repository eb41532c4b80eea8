"""Hashing of Arrow text in numpy, a slice of text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows of about ``max_bytes``.

    Nulls count as empty. A single longer text forms a slice of its own, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(range(9, 14)) + list(range(28, 33))] = True
_PRIME, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        made = []
        with np.errstate(over="ignore"):
            for base in (_PRIME, _INVERSE):
                t = np.full(size, base, np.uint64)
                t[0] = 1
                made.append(np.cumprod(t, dtype=np.uint64))
        if size > 1 << 23:
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of each word between white space, in order, over a slice.

    A prefix sum of byte times power of an odd number gives every word's hash by
    one subtraction, so the whole slice is hashed without a loop over words.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if (raw >= 0x80).any():
        raw = np.frombuffer(_SPACES.sub(lambda m: b" " * len(m.group()), raw.tobytes()), np.uint8)
    word = ~_IS_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[firsts] = word[firsts]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends[lasts] = word[lasts]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _tables(len(raw))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
        hashed = mix((sums[stop] - sums[start]) * inverse[start])
    return np.searchsorted(offsets, start, "right") - 1, hashed


def ngram_hashes(rows: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, index of the first word) of each run of ``n`` words within a row."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    with np.errstate(over="ignore"):
        h = words[at].copy()
        for i in range(1, n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[at + i]
    return rows[at], mix(h), at
