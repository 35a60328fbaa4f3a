"""Whole batches of texts as numpy arrays of bytes: words, hashes, word n-grams.

A word here is a run of bytes other than space and \\x09-\\x0D. Hashes are 64-bit
polynomials over a fixed table of byte values, alike on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (one longer text is taken whole).
SLICE_BYTES = 500_000

_U = np.uint64
_BASE, _STEP, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (a fixed bijection)."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _BASE)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, _U), np.full(n, _INVERSE, _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(SLICE_BYTES, 1 << (n - 1).bit_length() if n > SLICE_BYTES else 1))


class Texts:
    """Some texts in one byte array; text i is buf[offsets[i]:offsets[i + 1]]. Null is empty."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.buf, self.offsets = (_LOWER[buf] if lower else buf), offsets
        self.n = len(offsets) - 1
        self._sums: np.ndarray | None = None

    @staticmethod
    def slices(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, "Texts"]]:
        """(first row, end row, texts) over a string column, each of bounded size."""
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
        if len(column) == 0:
            return
        _, raw, data = column.buffers()
        offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + len(column) + 1]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            own = offsets[at : end + 1]
            yield at, end, Texts(buf[own[0] : own[-1]], own - own[0], lower)
            at = end

    def words(self, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words in buf, and word counts up to each text: text i has words first[i]:first[i + 1].

        between: which bytes stand between words."""
        gap = between[self.buf]
        start, end = ~gap, ~gap
        start[1:] &= gap[:-1]
        end[:-1] &= gap[1:]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(self.buf))]
        start[inner] |= ~gap[inner]
        end[inner - 1] |= ~gap[inner - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each span of buf."""
        if not len(starts):
            return np.zeros(0, _U)
        up, down = powers(len(self.buf) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.buf) + 1, _U)
            np.cumsum(_BYTES[self.buf] * up[: len(self.buf)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + _STEP * (ends - starts).astype(_U))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes."""
    if len(words) < n:
        return np.zeros(0, _U)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * _STEP + words[k : len(words) - n + 1 + k]
    return mix(h)
