"""Word shingles of Arrow text columns as 64-bit hashes, without a loop over words.

Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased. A word's hash
is a polynomial over a table of random values, a shingle's hash mixes its words in order.
Two shingles of one document of m shingles share a hash with probability m * m / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_random = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of plain words: all of ASCII but letters and digits.
PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _first_powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(2 * SLICE_BYTES, 1 << (n - 1).bit_length()))[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in the bytes) of about SLICE_BYTES each; a
    longer text is a slice of its own. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, rows: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each row the index of its first word (one entry more).
    ``space`` tells of each byte whether it parts words."""
    inside = np.concatenate(([False], ~space[data], [False]))
    begins = np.zeros(len(data) + 1, bool)
    begins[rows] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | begins[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | begins[1:])) + 1
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _first_powers(_BASE, n), out=sums[1:])
    hashes = (sums[end] - sums[start]) * _first_powers(_BASE_INVERSE, n + 1)[start]
    return mix(hashes + (end - start).astype(np.uint64)), np.searchsorted(start, rows)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle in text order. A row with fewer words than ``size`` has
    its whole sequence as one; a row without words has none."""
    factor = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    count = np.diff(first)
    row_of_word = np.repeat(np.arange(len(count)), count)
    total = np.zeros(len(hashes), np.uint64)
    for k in range(min(size, len(hashes))):
        total[: len(hashes) - k] += hashes[k:] * factor[k]
    at = np.flatnonzero(np.arange(len(hashes)) + size <= first[1:][row_of_word])
    out, rows = mix(total[at]), row_of_word[at]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            whole[has] += hashes[first[short[has]] + k] * factor[k]
        whole = mix(whole + count[short].astype(np.uint64))
        order = np.argsort(np.concatenate((rows, short)), kind="stable")
        out, rows = np.concatenate((out, whole))[order], np.concatenate((rows, short))[order]
    return out, rows


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, first index of each row) with each row's distinct
    shingles in ascending order."""
    for at, end, data, offsets in text_slices(column):
        out, rows = shingles(*words(data, offsets), size)
        order = np.lexsort((out, rows))
        out, rows = out[order], rows[order]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
        out, rows = out[keep], rows[keep]
        yield at, end, out, np.searchsorted(rows, np.arange(end - at + 1))
