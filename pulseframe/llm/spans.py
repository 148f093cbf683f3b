"""Texts of an Arrow batch as one byte array, and the words and hashes in it, without a Python loop over rows.

Every function works on a chunk: the UTF-8 bytes of consecutive rows (``data``) and the offsets of the rows in it
(``bounds``, one more than rows). Chunks hold whole texts and, unless one text alone is larger, at most ``max_bytes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

CHUNK_BYTES = 1 << 20
LONG_RANGE = 256


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE = _mask(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_random = np.random.Generator(np.random.PCG64(20240229))
_TABLES = _random.integers(0, 1 << 64, (2, 256), np.uint64)
_BASES = [int(x) | 1 for x in _random.integers(0, 1 << 63, 2, np.uint64)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, bounds) of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, values = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have at most ``max_bytes`` together; a longer text comes alone."""
    for batch in batches:
        _, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + max_bytes, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(base^i, base^-i) modulo 2^64 for i < n."""
    if seed not in _powers or len(_powers[seed][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (_BASES[seed], pow(_BASES[seed], -1, 1 << 64)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            both.append(np.cumprod(step))
        _powers[seed] = (both[0], both[1])
    return _powers[seed][0][:n], _powers[seed][1][:n]


def prefix_hash(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Running sums from which ``range_hash`` takes the hash of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[seed][data] * powers(len(data), seed)[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
    inverse = powers(len(prefix), seed)[1]
    length = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + length * np.uint64(0x9E3779B97F4A7C15))


def range_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, eight bytes at a time with ``mix`` in between, so that, unlike with ``range_hash``, no text is
    easily built to make two of them equal. A long range goes through xxh3 as a whole."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))
    length = (ends - starts).astype(np.int64)
    out = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    left = np.flatnonzero((length > 0) & (length <= LONG_RANGE))
    at = 0
    while len(left):
        lane, rest = eight[starts[left] + at], length[left] - at
        short = rest < 8
        lane[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
        out[left] = mix(out[left] * np.uint64(0xD1342543DE82EF95) ^ lane)
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(length > LONG_RANGE).tolist():
        out[i] = xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes that are not ``space``; runs never cross rows."""
    solid = ~space[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = bounds[1:-1]
    before[inner[inner < len(data)]] = False
    after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def word_windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of ``width`` consecutive words of one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    out = np.zeros(len(first), np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + hashes[first + i])
    return out, first
