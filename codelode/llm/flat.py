"""Texts as flat numpy arrays: a batch of texts is one array and the places where texts end.

Every function works on whole texts; a batch is cut between texts only, never within one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX1, MIX2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


_SYMBOLS = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(BASE))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64, for i below n or more."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for key, b in (("up", BASE), ("down", inverse)):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(pow(b, have, 1 << 64))
                have *= 2
            _POWERS[key] = out
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """64-bit hashes of any stretch of a flat array, equal for equal stretches."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = _powers(len(symbols) + 1)
        if symbols.dtype == np.uint8 or not len(symbols) or int(symbols.max()) < 1 << 16:
            spread = _SYMBOLS[symbols]
        else:
            spread = mix(symbols.astype(np.uint64) + np.uint64(BASE))
        spread *= up[: len(symbols)]
        self.sums = np.empty(len(symbols) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(spread, out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """The hash of every stretch of `size` symbols."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def groups(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to the limit at most, or that are alone."""
    start, total, n = 0, 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
        n = i + 1
    if n > start:
        yield start, n


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows, of at most `most` bytes of the column each, so that
    what is made of them stays small. Python workers serve one stage after the other: after each
    batch, what they have freed goes back to the system."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in groups(sizes, most):
            yield batch.slice(a, b - a)
        del batch
        give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def spread_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges starts[i] .. starts[i] + lengths[i]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
