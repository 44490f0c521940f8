"""Words of whole texts as arrays: the shared numpy helper of the operators that run inside tasks.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. The six separators are single bytes in UTF-8, so words
are cut on bytes; letters A-Z may be lowered, other letters stay as they are.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Odd multipliers of the word hash and of the finaliser (splitmix64): any fixed odd values do.
_POWER = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def let_go() -> None:
    """Give memory that a task has freed back to the system: Python workers live on and are reused."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def plain_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array of large strings with empty texts for nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, next row, bytes, offsets)`` of runs of texts of about ``most`` bytes."""
    strings = plain_strings(column)
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(strings):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """Words of a run of texts: ``first[i]:first[i + 1]`` are those of text i in ``hashes``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.bytes = _LOWER[data] if lower else data
        letter = ~_SPACE[data]
        n, size = len(offsets) - 1, len(data)
        before, after = np.zeros(size, bool), np.zeros(size, bool)
        if size:
            before[1:], after[:-1] = letter[:-1], letter[1:]
            before[offsets[:-1][offsets[:-1] < size]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(letter & ~before)
        self.ends = np.flatnonzero(letter & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(n), self.counts)
        lengths = self.ends - self.starts
        if not len(lengths):
            self.hashes = np.zeros(0, np.uint64)
            return
        begin = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        powers = np.full(int(lengths.max()), _POWER, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        values = (self.bytes[letter].astype(np.uint64) + np.uint64(1)) * powers[place]
        self.hashes = mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64) * _MIX2)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes; with fewer words, of the whole sequence as one."""
    if not len(words):
        return words
    width = min(width, len(words))
    last = len(words) - width + 1
    out = np.full(last, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out * _POWER + words[k : k + last])
    return out
