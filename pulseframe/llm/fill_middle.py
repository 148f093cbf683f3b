"""Fill-in-middle: cut every text at two places and move its middle to the end.

Places are counted in units (code points, words or lines), and the texts are UTF-8 bytes. A wavelet matrix over the
classes of all bytes of a chunk of texts answers how many bytes of a class stand before an offset, in three steps for
eight classes. The bytes that begin a unit are those of a few classes, so their ranks add up to the number of units
before an offset. A bisection on that sum finds the offset of a unit, for both cuts of all texts of the chunk at once;
no text is decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulseframe.llm import spans
from pulseframe.llm.tables import id_and_text

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts, how many are rearranged, and how many of those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1

#: Classes of bytes: what a byte is (two bits), and whether it begins a line (one bit more).
INSIDE, BLANK, WITHIN, WORD_START = range(4)
LINE_START = 4
UNITS = {
    "chars": (BLANK, WITHIN, WORD_START, BLANK | LINE_START, WITHIN | LINE_START, WORD_START | LINE_START),
    "words": (WORD_START, WORD_START | LINE_START),
    "lines": (BLANK | LINE_START, WITHIN | LINE_START, WORD_START | LINE_START),
}
LEVELS = 3


class BitRanks:
    """Bits with the number of ones before any place: 64 bits a word, and one running count for each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of the symbols of a sequence: one bit vector a level, the highest bit first, zeros moved before ones."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS) -> None:
        self.size, self.levels = len(symbols), []
        for bit in range(levels - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, BitRanks(ones), self.size - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        start, end = np.zeros(1, np.int64), at
        for bit, ranks, zeros in self.levels:
            a, b = ranks.ones(start), ranks.ones(end)
            start, end = (zeros + a, zeros + b) if symbol >> bit & 1 else (start - a, end - b)
        return end - start

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many bytes of these classes stand before each place."""
        total = np.zeros(len(at), np.int64)
        for symbol in symbols:
            total += self.rank(symbol, at)
        return total

    def select(self, symbols: tuple[int, ...], nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place in [low, high) of the nth (from 0, over the whole sequence) byte of these classes; high if it is beyond."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.count(symbols, middle + open_) > nth
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def byte_classes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Class of every byte of a chunk."""
    blank = spans.SPACE[data]
    first = np.zeros(len(data), bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    after_blank = first.copy()
    after_blank[1:] |= blank[:-1]
    out = np.where(blank, BLANK, np.where(after_blank, WORD_START, WITHIN)).astype(np.uint8)
    first[1:] |= data[:-1] == 10
    out[first] |= LINE_START
    out[(data & 0xC0) == 0x80] = INSIDE
    return out


def draws(key: bytes) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from a key."""
    digest = hashlib.sha256(key).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    if form == "spm":
        return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return prefix + middle + suffix


def restored(form: str, output: bytes) -> bytes:
    """The text again, from an output and its form alone: the parts hold no marker, so each stands once."""
    if form == "plain":
        return output
    rest, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = rest[len(PREFIX) :].split(SUFFIX, 1)
    else:
        suffix, prefix = rest[len(SUFFIX) :].split(PREFIX, 1)
    return prefix + middle + suffix


def fill_in_middle(
    docs: DataFrame, unit: str = "chars", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, digests: bool = False, texts: bool = True
) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars and, as asked for, output or output_sha256 and restored_sha256.

    ``n`` is the number of units of the text. Cuts, form and order of the parts follow from ``seed`` and doc_id alone (null:
    no digits), so reruns and retried tasks agree. A first cut at 0 leaves all before the first unit in the middle, and blanks
    before a later unit belong to the part before it. Texts that are empty (also null) or hold a marker stay plain. Repeated
    rows repeat their result; columns besides doc_id and text are not read. A text is one row, whatever its length.
    """
    begins = UNITS[unit]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long" + ", output string" * texts + ", output_sha256 string, restored_sha256 string" * digests
    names = [part.split()[0] for part in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in spans.chunks(batches):
            data, bounds = spans.text_bytes(chunk.column(1))
            whole = data.tobytes()
            matrix = WaveletMatrix(byte_classes(data, bounds))
            start, end = bounds[:-1], bounds[1:]
            earlier = matrix.count(begins, bounds)
            n = np.diff(earlier)
            drawn = np.array([draws(f"{seed}:{'' if i is None else i}".encode()) for i in chunk.column(0).to_pylist()], np.int64).reshape(-1, 4)
            cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], 1)
            places = [np.where(c == 0, start, matrix.select(begins, earlier[:-1] + c, start, end)) for c in cuts.T]
            chars = [matrix.count(UNITS["chars"], at) for at in (start, *places)]
            moved = (end > start) & (drawn[:, 2] % 100 < rate)
            columns: list[list] = [[] for _ in names[2:]]
            for a, p, m, b, move, last, c0, c1, c2 in zip(*(x.tolist() for x in (start, *places, end, moved, drawn[:, 3], *chars)), strict=True):
                text = whole[a:b]
                form = "plain"
                if move and not (PREFIX in text or SUFFIX in text or MIDDLE in text):
                    form = "spm" if last % 100 < suffix_first else "psm"
                output = arranged(form, whole[a:p], whole[p:m], whole[m:b])
                row = [form, *((None, None) if form == "plain" else (c1 - c0, c2 - c1))]
                row += [output.decode("utf-8", "replace")] * texts
                row += [hashlib.sha256(x).hexdigest() for x in (output, restored(form, output))] if digests else []
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (len(names) - 5)]
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(n), *made], names=names)

    return id_and_text(docs).mapInArrow(cut, schema)
