"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

White space is ASCII, so words can be found on UTF-8 bytes without decoding. A word's hash is a
polynomial over its bytes, taken from one running sum per slice, then mixed; a window's hash is a
polynomial over its words' hashes. All are 64 bits wide and equal in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text makes a slice of its own.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _STEP = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64, kept for the next slice."""
    if len(_powers["up"]) < n:
        size = max(n, SLICE)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class Texts(NamedTuple):
    """Consecutive texts: their rows in the column, their bytes and where each begins and ends."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


class Words(NamedTuple):
    """One entry a word: index of its text in the slice, byte span in the slice, hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray


def slices(column, limit: int = SLICE) -> Iterator[Texts]:
    """The texts of an Arrow column in order, about `limit` bytes at a time; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield Texts(at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans data[start:end], none of them empty."""
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def spans(texts: Texts, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the maximal runs of bytes that are not in `apart`, a table of 256 flags."""
    data, bounds = texts.data, texts.bounds
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~apart[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[edge] = inside[edge]
    ends[edge[1:] - 1] = inside[edge[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(bounds, start, "right") - 1, start, end


def words(texts: Texts, apart: np.ndarray = WHITE) -> Words:
    """The same runs with their hashes."""
    row, start, end = spans(texts, apart)
    return Words(row, start, end, span_keys(texts.data, start, end) if len(start) else np.zeros(0, np.uint64))


def windows(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window of `length` words that starts at each word, and whether it fits its text."""
    n = len(found.key)
    key, fits = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n >= length:
        m, factor = n - length + 1, 1
        for i in range(length):
            key[:m] += found.key[i : i + m] * np.uint64(factor)
            factor = factor * _STEP % (1 << 64)
        fits[:m] = found.row[:m] == found.row[length - 1 :]
    return mix(key), fits


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and how long it is."""
    if not len(sorted_keys):
        none = np.zeros(0, np.int64)
        return none, none
    at = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return at, np.diff(np.append(at, len(sorted_keys)))
