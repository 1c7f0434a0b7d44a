"""Vectorised word scanning of Arrow text columns: words are runs of bytes outside \\x20 and \\x09-\\x0D.

Everything works on the UTF-8 bytes of a slice of documents at once; no Python object is made per word. Word
and window hashes are 64-bit polynomial hashes over a random table, mixed at the end; they depend on the bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


_TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


class _Powers:
    """base**i and base**-i modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n + n // 8
            for name, step in (("up", self.base), ("down", self.inverse)):
                out = np.full(size, U(step), U)
                out[0] = U(1)
                setattr(self, name, np.multiply.accumulate(out))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(0xD6E8FEB86659FD93 | 1), _Powers(0xA0761D6478BD642F | 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


@dataclass
class Scan:
    """Words of documents first..last-1 of a batch; word i is data[starts[i]:ends[i]]."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: document d has the bytes cuts[d] .. cuts[d + 1] - 1
    cuts: np.ndarray
    #: document d (counted from first) has the words bounds[d] .. bounds[d + 1] - 1
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        return self.spans(self.starts, self.ends)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span."""
        if not len(begin):
            return np.zeros(0, U)
        up, down = _BYTE_POWERS.upto(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U)
        np.cumsum(_TABLE[self.data] * up[:-1], out=total[1:])
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U))

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of each run of `width` words within one document, in order."""
        n = np.diff(self.bounds) - width + 1
        keep = n > 0
        count = n[keep]
        if not len(count):
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.repeat(self.bounds[:-1][keep] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        up, down = _WORD_POWERS.upto(len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * up[:-1], out=total[1:])
        return at, mix((total[at + width] - total[at]) * down[at])


def scans(column: pa.Array, lower: bool = False, slice_bytes: int = _SLICE_BYTES) -> Iterator[Scan]:
    """Scans of bounded slices of whole documents (a longer document is a slice of its own)."""
    data, offsets = text_bytes(column)
    first, count = 0, len(offsets) - 1
    while first < count:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slice_bytes, "right")) - 1)
        part, cuts = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if lower:
            part = _LOWER[part]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = ~_SPACE[part]
        begins = inside[1:] & ~inside[:-1]  # also at len(part), where it is False
        stops = inside[:-1] & ~inside[1:]
        border = cuts[1:-1][(cuts[1:-1] > 0) & (cuts[1:-1] < len(part))]
        joined = border[inside[border] & inside[border + 1]]  # a word may not run on into the next document
        begins[joined] = True
        stops[joined] = True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
        yield Scan(first, last, part, starts, ends, cuts, np.searchsorted(starts, cuts).astype(np.int64))
        first = last
