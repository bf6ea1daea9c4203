"""Words, hashes and shingles of whole Arrow text columns, vectorised over UTF-8 bytes.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D) with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_CODES = _rng.integers(1, 2**64 - 1, 16, dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODE_OF_LOWER = BYTE_CODES[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0..n-1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets (from 0) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and per document the range of its words (len(offsets) entries)."""
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first] = solid[first]
    end[last] = solid[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and per document the range of its words."""
    starts, ends, ranges = words(data, offsets)
    return hashed(data, starts, ends), ranges


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word found by words()."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    solid = data[~SPACE[data]]
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(solid)) - np.repeat(first, lengths)
    codes = CODE_OF_LOWER[solid] * powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(codes, first))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of a document's n-word shingles in order (not distinct); with fewer words, of the whole sequence."""
    m = len(hashes)
    if m == 0:
        return np.zeros(0, np.uint64)
    if m < n:
        return mix((hashes * SHINGLE_CODES[:m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m))
    out = hashes[: m - n + 1] * SHINGLE_CODES[0]
    for k in range(1, n):
        out = out + hashes[k : m - n + 1 + k] * SHINGLE_CODES[k]
    return mix(out + np.uint64(n))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, sorted; taken in small pieces, as workers keep the memory they once had."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets, 1 << 18):
        lo, hi = offsets[i], offsets[j]
        hashes, ranges = word_hashes(data[lo:hi], offsets[i : j + 1] - lo)
        for k in range(j - i):
            yield np.unique(shingles(hashes[ranges[k] : ranges[k + 1]], n))
