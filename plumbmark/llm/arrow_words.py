"""Words of Arrow string columns as numpy arrays: where they start and end, and a 64-bit hash of each.

A hash is a polynomial over the bytes of the word, each byte standing for a random number, so it costs a few
vector operations a byte; it is then mixed. A-Z count as a-z.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that end words: space and \t to \r; or all ASCII but letters and digits.
SPACES = tuple(b"\t\n\x0b\x0c\r ")
NOT_WORD = tuple(b for b in range(128) if not chr(b).isalnum())
#: Texts are taken in slices of about so many bytes; a longer text is a slice of its own.
SLICE = 1 << 20

_BASE = 0xD1342543DE82EF95
_STEP, _BACK = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    return values


_VALUES = _byte_values()
_powers = {_STEP: np.ones(1, np.uint64), _BACK: np.ones(1, np.uint64)}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1; kept between calls up to a few slices, so that one very long text leaves no memory behind."""
    if len(_powers[base]) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > 4 * SLICE:
            return out
        _powers[base] = out
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Words:
    """Of a slice of texts: data (bytes), offsets (n + 1), starts and ends of words, bounds (n + 1: the first word of each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: tuple[int, ...]):
        self.data, self.offsets = data, offsets
        is_break = np.zeros(256, bool)
        is_break[list(breaks)] = True
        inner, n = ~is_break[data], len(data)
        first, last = inner.copy(), inner.copy()
        first[1:] &= ~inner[:-1]
        last[:-1] &= ~inner[1:]
        begin = offsets[:-1][offsets[:-1] < n]
        first[begin] = inner[begin]
        end = offsets[1:][offsets[1:] > 0] - 1
        last[end] = inner[end]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Of whole words, or of their first bytes up to longest."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[self.data] * _powers_of(_STEP, n + 1)[:n], out=total[1:])
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return mix((total[ends] - total[self.starts]) * _powers_of(_BACK, n + 1)[self.starts])

    def text_of(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def release() -> None:
    """Gives the memory that the worker has freed back to the system, as a worker lives on after its task."""
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, breaks: tuple[int, ...]) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of consecutive slices of a column."""
    data, offsets = strings(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        to = min(to, n)
        own = offsets[at : to + 1]
        yield at, to, Words(data[own[0] : own[-1]], own - own[0], breaks)
        at = to
