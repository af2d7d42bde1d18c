"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``.  All work is
done with numpy on the UTF-8 buffer of a whole slice of rows, so no Python
object is made per word.  Slices hold about ``slice_bytes`` of text (one row
when a row is longer), which bounds the memory of a task whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64; the longest table is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        table[0] = 1
        have = _POWERS[base] = np.cumprod(table, dtype=np.uint64)
        if size > 4 << 20:
            del _POWERS[base]
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, lower


@dataclass
class Words:
    """The words of rows ``first .. last - 1`` of a batch."""

    first: int
    last: int
    data: np.ndarray  # bytes of the slice
    starts: np.ndarray  # byte offset of each word in data
    ends: np.ndarray
    ptr: np.ndarray  # words of row r: ptr[r - first] .. ptr[r - first + 1]
    row_at: np.ndarray  # byte offset of each row in data, and the end

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (ASCII-lowered on request)."""
        return SpanHashes(_tables()[1][self.data] if lower else self.data)(self.starts, self.ends)


class SpanHashes:
    """Hashes of any byte spans of one buffer."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_BASE_INV, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.back[starts])


def _slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def latin_lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte Latin-1 capitals of UTF-8."""
    out = _tables()[1][data]
    second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[second] += 0x20
    return out


def letter_bytes() -> np.ndarray:
    """ASCII letters and every byte of a longer character."""
    table = np.zeros(256, dtype=bool)
    table[65:91] = table[97:123] = table[128:] = True
    return table


def words(column: pa.Array, slice_bytes: int = 1 << 18, ink_table: np.ndarray | None = None) -> Iterator[Words]:
    """The words of every row; a null row has none.  ``ink_table``: the bytes that make words, if others."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, at, buf = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    inky = ~_tables()[0] if ink_table is None else ink_table
    for first, last in _slices(offsets, slice_bytes):
        data = whole[offsets[first] : offsets[last]]
        row_at = offsets[first : last + 1] - offsets[first]
        ink = inky[data]
        n = len(data)
        begin = np.empty(n, dtype=bool)
        stop = np.empty(n, dtype=bool)
        if n:
            begin[0], begin[1:] = True, ~ink[:-1]
            stop[-1], stop[:-1] = True, ~ink[1:]
            inner = row_at[1:-1][(row_at[1:-1] > 0) & (row_at[1:-1] < n)]
            begin[inner] = True
            stop[inner - 1] = True
        starts = np.flatnonzero(begin & ink)
        ends = np.flatnonzero(stop & ink) + 1
        yield Words(first, last, data, starts, ends, np.searchsorted(starts, row_at), row_at)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive word hashes, by start."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if width <= 8:
        total = hashes[:n].copy()
        for j in range(1, width):
            total = total * np.uint64(_BASE) + hashes[j : j + n]
        return mix64(total)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(_BASE, len(hashes)), out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * powers(_BASE_INV, n))


def inside(ptr: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of ``n`` window starts, those whose window stays in one row."""
    ok = np.ones(max(n, 0), dtype=bool)
    for back in range(1, width):
        edge = ptr[1:-1] - back
        ok[edge[(edge >= 0) & (edge < n)]] = False
    return ok
