"""Segments of many texts at once as numbers: two substrings have one number if they are equal, whatever stands around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters that are handled at once, unless a single text has more.
CHARS = 1 << 18
#: A substring is the sum of its characters' numbers, each times a power of this odd number, modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15 | 1

#: Lengths and numbers of segments start here, beyond all characters.
_PLACE = 1 << 40


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread over all 64 bits (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, CHARS) + 1, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers


class Pieces:
    """Texts as one row of characters, with the running sum of their numbers."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        powers, self.inverse = _power(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64)) * powers[: len(codes)], out=self.sums[1:])

    @classmethod
    def of(cls, column: pa.Array) -> Iterator[tuple[int, Pieces]]:
        """(first row, texts) of an array of strings, a bounded number of characters at a time. Bytes that are no characters become signs."""
        texts = [t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]
        at = size = 0
        for k, text in enumerate(texts):
            if size and size + len(text) > CHARS:
                yield at, cls(texts[at:k])
                at, size = k, 0
            size += len(text)
        if at < len(texts):
            yield at, cls(texts[at:])

    def number(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the characters from ``first`` up to but not with ``last``, counted through all texts."""
        return (self.sums[last] - self.sums[first]) * self.inverse[first]

    def around(self, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[list[str], list[str]]:
        """What stands before and behind a substring of some of the texts."""
        cut = [(self.texts[r], s, s + n) for r, s, n in zip(row.tolist(), start.tolist(), size.tolist())]
        return [t[:s] for t, s, _ in cut], [t[e:] for t, _, e in cut]


def segments(pieces: Pieces, edits: int, reach: int, gap: int, asks: bool, files: bool, shorter: bool) -> Iterator[tuple]:
    """(row, key, part, start, size, role) of the segments of texts, and of all substrings that can be a segment of a text within
    reach: as ``_filed`` (role 2) and ``_asked`` (role 1) of ``pulseframe.operators.fuzzy`` have them; 3 is a segment that does both.

    All but ``part`` are arrays.
    """
    n, parts = pieces.lengths, edits + 1
    for longer in range(-reach if asks else 0, (reach if asks and not shorter else 0) + 1):
        length = n + longer
        rows = np.flatnonzero(length >= parts + gap * edits)
        if not len(rows):
            continue
        inside = length[rows] - gap * edits
        base, more = inside // parts, inside % parts
        for part in range(parts):
            size = base + (part >= parts - more)
            own = part * (base + gap) + np.maximum(0, part - (parts - more))
            left = edits - part
            # By how much the substring may be shifted: by the edits before it, those behind it, and the insertions and deletions of both.
            least, most = max(-part, -longer - left, -((reach + longer) // 2)), min(part, left - longer, (reach - longer) // 2)
            for shift in range(least, most + 1) if asks else [0]:
                start = own + shift
                fits = (start >= 0) & (start <= n[rows] - size)
                row, at, width = rows[fits], start[fits], size[fits]
                first = pieces.starts[row] + at
                last = first + width
                key = _mixed(pieces.number(first, last) + _mixed((_PLACE + length[row] * parts + part).astype(np.uint64)))
                if not left:
                    key = _mixed(key + pieces.number(last, pieces.starts[row] + n[row]))
                role = (asks and 1) + (2 if files and not longer and not shift else 0)
                yield row, key.view(np.int64), part, at, width, np.full(len(row), role, np.int32)
