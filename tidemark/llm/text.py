"""Vectorised work on the bytes of a batch of texts: words, word hashes, shingles, rolling hashes.

A batch is one ``uint8`` array with the texts one after the other and the ``int64`` offsets between them, as Arrow
stores binary columns, so nothing here makes a Python object for each text. Hashes are sums of random 64-bit byte values
times powers of an odd base, taken from running sums, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@lru_cache(None)
def byte_values() -> np.ndarray:
    return np.random.default_rng(20250101).integers(1, 1 << 64, 256, dtype=_U)


@lru_cache(None)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, size: int) -> np.ndarray:
    """base**0 .. base**(size-1) modulo 2**64; sizes are rounded up, so few arrays are ever made."""
    return _powers(base, max(1 << 16, 1 << (size - 1).bit_length()))[:size]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def running(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``between`` takes the hash of any stretch."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(byte_values()[data] * powers(BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of the bytes of each stretch [start, end)."""
    return mixed((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts])


def rolling(sums: np.ndarray, width: int) -> np.ndarray:
    """Mixed hash of every window of ``width`` bytes."""
    if len(sums) <= width:
        return np.zeros(0, _U)
    return mixed((sums[width:] - sums[:-width]) * powers(BASE_INVERSE, len(sums))[:-width])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes together; a longer text is a run of its own."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of every word, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the texts' bounds in that array."""
    data = LOWER[data] if lower else data
    starts, ends, owner = words(data, offsets)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    return between(running(data), starts, ends), bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; a text with fewer words is one shingle."""
    hashes, bounds = word_hashes(data, offsets)
    factors = powers(0xD6E8FEB86659FD93, width + 1)[1:]
    joint = np.zeros(max(len(hashes) - width + 1, 0), _U)
    for k in range(width):
        joint += hashes[k : k + len(joint)] * factors[k]
    joint = mixed(joint)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joint[a : b - width + 1]))
        elif b > a:
            whole = (hashes[a:b] * factors[: b - a]).sum(dtype=_U) + _U(b - a)
            out.append(mixed(mixed(np.array([whole], _U)) + _U(width)))
        else:
            out.append(np.zeros(0, _U))
    return out
