"""Words of Arrow text batches as NumPy arrays; nothing here loops over words in Python.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``; A-Z count as a-z in hashes.
UTF-8 never uses those bytes inside a character, so working on bytes equals working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once: temporary arrays take about 40 times as much.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that close inputs give unrelated outputs (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(count: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * _STEP + np.uint64(seed)) | np.uint64(1)


_BYTE = mixed(np.arange(256, dtype=np.uint64) + np.uint64(77))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans may be empty."""
    lengths = ends - starts
    out = np.zeros(len(starts), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        sizes = lengths[full]
        begin = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(begin, sizes)
        power = np.cumprod(np.full(int(sizes.max()), _BASE, dtype=np.uint64))
        value = _BYTE[data[place + np.repeat(starts[full], sizes)]] * power[place]
        out[full] = np.add.reduceat(value, begin)
    return mixed(out + lengths.astype(np.uint64) * _STEP)


@dataclass
class Words:
    """``data``: bytes of the chunk; word ``k`` is ``data[starts[k]:ends[k]]``; document ``d`` has words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; with ``lower``, A-Z count as a-z."""
        return span_hashes(_LOWER[self.data] if lower else self.data, self.starts, self.ends)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and where each begins (one more offset closes the last); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive documents ``low`` to ``high`` of at most ``most`` bytes together, or one longer document."""
    if not len(column):
        return
    data, offsets = texts(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def find_words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> Words:
    """``apart``: of each byte, does it separate words?"""
    inside = ~apart[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``n`` consecutive words of each document, and where each document's begin.

    A document of fewer words has one, its whole sequence; one without words has none.
    """
    factors = _odd(n + 1, 5)
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], made) + np.repeat(first[:-1], made)
    size = np.repeat(np.minimum(count, n), made)
    total = size.astype(np.uint64) * factors[n]
    last = max(len(hashes) - 1, 0)
    for k in range(n):
        total = total + np.where(size > k, hashes[np.minimum(at + k, last)] * factors[k], np.uint64(0)) if len(at) else total
    return mixed(total), begin


def repeated_in_document(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: is it found again in its document, and was it found there before?"""
    keys = mixed(hashes ^ mixed(owner.astype(np.uint64) + np.uint64(11)))
    _, at, which, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return count[which] > 1, at[which] != np.arange(len(keys))


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between each two offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
