"""SentencePiece BPE with a public model: encoding, decoding and their digests.

A text gets a space in front, spaces count as the mark U+2581, and its characters are the first symbols. The adjacent
pair that makes the piece of best score is merged, the leftmost first among equals, until no pair makes a piece; a character
that the model does not know becomes one piece for each of its bytes.

No merge reaches across two neighbouring characters that no piece of the model has side by side, so a chunk of texts is
cut there, and each distinct word that this leaves is encoded once, all words at the same time:

* symbols of all words lie in one flat array, with the word that each belongs to;
* a round takes the least pair rank of every word (a minimum by segments), merges its places from the left, closes the
  gaps, and looks up the new pairs alone; words without a pair are done and leave the array;
* equal places of a word merge in the same round, but only up to the first merge that makes a neighbouring pair of the same
  or a better rank, because that pair would come before the rest.

Every round merges in each word, so a word of n symbols takes at most n - 1 of them. Words longer than ``LONG_WORD`` go
through the same merges one by one with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulseframe.llm import spans
from pulseframe.llm.tables import id_and_text

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE_MODEL = 2
LONG_WORD = 200
NO_RANK = np.int64(1) << 40


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialized protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        size = varint() if size is None else size
        yield number, message[at : at + size]
        at += size


class PieceModel:
    """What a model file says, as arrays: pieces, pairs that make a piece, ranks, and characters that stand side by side."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        pieces = [dict(_fields(v)) for number, v in parts if number == 1]
        trainer, normalizer = (dict(next((_fields(v) for number, v in parts if number == k), ())) for k in (2, 3))
        self.names = [p[1].decode() for p in pieces]
        kinds = np.array([p.get(3, NORMAL) for p in pieces])
        if trainer.get(3) != BPE_MODEL or not trainer.get(35) or trainer.get(24) or not set(kinds.tolist()) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback and without pieces of a user are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that keep texts as they are, with a space in front, are supported")
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.byte_piece = np.zeros(256, np.int64)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte_piece[int(self.names[i][1:-1], 16)] = i
        normal = {self.names[i]: i for i in np.flatnonzero(kinds == NORMAL).tolist()}
        size = len(pieces)

        # Classes of characters: 0 for those that no piece has. Symbols: piece ids, and from ``size`` on characters without one.
        chars = sorted({c for name in normal for c in name})
        self.known = np.zeros(0x110000, np.int16 if len(chars) < 32_000 else np.int32)
        self.known[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.known[ord(" ")] = self.known[ord(MARK)]
        symbol = {c: size + k for k, c in enumerate(chars, 1)} | normal
        self.symbol_of = np.array([size, *(symbol[c] for c in chars)], np.int64)
        self.size, self.symbols = size, size + len(chars) + 1
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        number = {c: k for k, c in enumerate(chars, 1)}
        sides = {pair for name in normal for pair in zip(name, name[1:], strict=False)}
        if sides:
            self.beside[tuple(np.array([(number[a], number[b]) for a, b in sides]).T)] = True

        # Pieces of equal score share a rank.
        scores = np.array([struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        made = {
            (symbol[name[:k]], symbol[name[k:]]): i
            for name, i in normal.items() for k in range(1, len(name)) if name[:k] in symbol and name[k:] in symbol
        }
        self.table = made
        self.bits = (4 * len(made) + 4).bit_length()
        self.slots = np.full((1 << self.bits, 2), -1, np.int64)
        self._fill(np.array([a * self.symbols + b for a, b in made], np.int64), np.array(list(made.values()), np.int64))
        self.ranks = np.append(rank, NO_RANK)

        surfaces = [
            b"" if kind == CONTROL else bytes([int(name[1:-1], 16)]) if kind == BYTE else name.replace(MARK, " ").encode()
            for name, kind in zip(self.names, kinds.tolist(), strict=True)
        ]
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_ends = np.cumsum([len(s) for s in surfaces])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put (key, value) into an open-addressed table: all at once, those that find their slot taken try the next."""
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at, 0] < 0
            self.slots[at[free]] = np.stack([keys[free], values[free]], 1)
            left = self.slots[at, 0] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) % len(self.slots)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 for none."""
        key = left * self.symbols + right
        at = self._slot(key)
        held = self.slots[at]
        out = np.where(held[:, 0] == key, held[:, 1], -1)
        todo = np.flatnonzero((held[:, 0] != key) & (held[:, 0] >= 0))
        at, key = at[todo], key[todo]
        while len(todo):
            at = (at + 1) % len(self.slots)
            held = self.slots[at]
            same = held[:, 0] == key
            out[todo[same]] = held[same, 1]
            more = ~same & (held[:, 0] >= 0)
            todo, at, key = todo[more], at[more], key[more]
        return out

    def merged(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, word) after all merges. ``word`` is ascending; symbols of one number are one word."""
        done = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        piece = np.full(len(symbols), -1, np.int64)  # what a symbol and the next one make
        joined = np.flatnonzero(word[1:] == word[:-1])
        piece[joined] = self.pairs(symbols[joined], symbols[joined + 1])
        while len(symbols):
            rank = self.ranks[piece]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            going = np.repeat(least < NO_RANK, length)
            if not going.all():
                done.append((symbols[~going], word[~going]))
                symbols, word, piece, rank = symbols[going], word[going], piece[going], rank[going]
                length, least = length[least < NO_RANK], least[least < NO_RANK]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, length))
            # Places in a row overlap: of such a run, every other one merges.
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            at = self._safe(at, symbols, word, piece, rank)
            symbols[at] = piece[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            symbols, word, piece = symbols[keep], word[keep], piece[keep]
            left = new[np.concatenate([new[:1] > 0, new[1:] - new[:-1] > 1])] - 1
            fresh = np.concatenate([new, left])
            beyond = np.minimum(fresh + 1, len(word) - 1)
            inner = (beyond > fresh) & (word[beyond] == word[fresh])
            piece[fresh] = -1
            piece[fresh[inner]] = self.pairs(symbols[fresh[inner]], symbols[fresh[inner] + 1])
        out, of = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(of, kind="stable")
        return out[order], of[order]

    def _safe(self, at: np.ndarray, symbols: np.ndarray, word: np.ndarray, piece: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The merges of a round that come before any pair that they make, for each word from the left."""
        if len(at) < 2 or not (word[at[1:]] == word[at[:-1]]).any():
            return at
        n, new, own = len(symbols), piece[at], rank[at]
        after = np.minimum(at + 2, n - 1)
        right = np.where((at + 2 < n) & (word[after] == word[at]), self.pairs(new, symbols[after]), -1)
        before = np.maximum(at - 1, 0)
        follows = np.concatenate([[False], at[1:] - at[:-1] == 2])
        last = np.where(follows, np.concatenate([[0], new[:-1]]), symbols[before])
        left = np.where((at > 0) & (word[before] == word[at]), self.pairs(last, new), -1)
        early = np.minimum(self.ranks[right], self.ranks[left]) <= own
        if not early.any():
            return at
        # Nothing behind a word's first early merge.
        stops = np.cumsum(early) - early
        begin = np.flatnonzero(np.concatenate([[True], word[at[1:]] != word[at[:-1]]]))
        return at[stops == np.repeat(stops[begin], np.diff(np.append(begin, len(at))))]

    def merged_long(self, symbols: list[int]) -> list[int]:
        """As ``merged`` for one word, a merge at a time, best rank and leftmost first."""
        n = len(symbols)
        symbols, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
        first = self.pairs(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)).tolist()
        heap = [(int(self.ranks[p]), i, p, symbols[i], symbols[i + 1]) for i, p in enumerate(first) if p >= 0]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            p = self.table.get((symbols[i], symbols[j]))
            if p is not None:
                heapq.heappush(heap, (int(self.ranks[p]), i, p, symbols[i], symbols[j]))

        while heap:
            _, i, p, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = p, -1, after[j]
            after[j] = -1
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s >= 0]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts of a chunk, with the ids of begin and end."""
        rows = len(bounds) - 1
        filled = bounds[:-1] < bounds[1:]
        data = np.insert(data, bounds[:-1][filled], ord(" "))
        bounds = bounds + np.concatenate([[0], np.cumsum(filled)])
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        if len(points) != len(starts):
            raise ValueError("texts must be valid UTF-8")
        known = self.known[points]
        begins = np.ones(len(points), bool)
        begins[1:] = ~self.beside[known[:-1], known[1:]]
        begins[np.searchsorted(starts, bounds[:-1][filled])] = True
        first = np.flatnonzero(begins)  # first character of each word
        edges = np.append(starts[first], len(data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
        code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, ends = self._distinct(code, first, known, data, starts)

        size = ends - np.concatenate([[0], ends[:-1]])
        count = size[code]
        n_words = np.bincount(np.searchsorted(bounds, edges[:-1], "right") - 1, minlength=rows)
        word_row = np.repeat(np.arange(rows), n_words)
        total = np.bincount(word_row, weights=count, minlength=rows).astype(np.int64) + 2
        out_bounds = np.concatenate([[0], np.cumsum(total)])
        out = np.empty(out_bounds[-1], np.uint32)
        out[out_bounds[:-1]], out[out_bounds[1:] - 1] = self.begin, self.end
        inner = np.ones(len(out), bool)
        inner[out_bounds[:-1]] = inner[out_bounds[1:] - 1] = False
        out[inner] = ids[_ranges((ends - size)[code], count)]
        return out, out_bounds

    def _distinct(self, code: np.ndarray, first: np.ndarray, known: np.ndarray, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the distinct words, from the place where each stands first."""
        if not len(code):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        seen = np.empty(int(code.max()) + 1, np.int64)
        seen[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        begin, length = first[seen], np.diff(np.append(first, len(known)))[seen]
        where = _ranges(begin, length)
        symbols, word = self.symbol_of[known[where]], np.repeat(np.arange(len(seen)), length)
        long_ = (length > LONG_WORD)[word]
        ids, of = self.merged(symbols[~long_], word[~long_])
        if long_.any():
            tails = [(w, self.merged_long(symbols[word == w].tolist())) for w in np.flatnonzero(length > LONG_WORD).tolist()]
            ids = np.concatenate([ids, *(np.array(s, np.int64) for _, s in tails)])
            of = np.concatenate([of, *(np.full(len(s), w) for w, s in tails)])
            order = np.argsort(of, kind="stable")
            ids, of = ids[order], of[order]
        # A character without a piece is a word or a symbol of its own: its bytes take its place.
        strange = np.flatnonzero(ids >= self.size)
        if len(strange):
            ids, of = self._with_bytes(ids, of, strange, begin, length, known, data, starts)
        return ids, np.cumsum(np.bincount(of, minlength=len(seen)))

    def _with_bytes(self, ids, of, strange, begin, length, known, data, starts):
        """Ids with the byte pieces of unknown characters. Their places: the k-th such symbol of a word is its k-th such character."""
        ends = np.append(starts, len(data))
        chars = _ranges(begin, length)
        own = chars[self.symbol_of[known[chars]] >= self.size]
        if len(own) != len(strange):
            raise ValueError("a character without a piece took part in a merge")
        width = np.ones(len(ids), np.int64)
        width[strange] = ends[own + 1] - ends[own]
        out, of_out = np.repeat(ids, width), np.repeat(of, width)
        place = np.repeat(np.isin(np.arange(len(ids)), strange), width)
        out[place] = self.byte_piece[data[_ranges(ends[own], width[strange])]]
        return out, of_out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds) of the texts of a chunk of ids: their pieces, one after another, without the space in front."""
        ends = self.surface_ends[ids]
        begins = np.where(ids > 0, self.surface_ends[np.maximum(ids.astype(np.int64) - 1, 0)], 0)
        data = self.surface[_ranges(begins, ends - begins)]
        total = np.concatenate([[0], np.cumsum(ends - begins)])
        at = total[bounds]
        blank = np.zeros(len(data) + 1, bool)
        blank[:-1] = data == ord(" ")
        drop = at[:-1][(at[:-1] < at[1:]) & blank[at[:-1]]]
        return np.delete(data, drop), at - np.searchsorted(drop, at, "left")


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [begin, begin + length), one range after another."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - total + length, length)


@lru_cache(maxsize=1)
def model_of(path: str) -> PieceModel:
    """One model for all tasks of a Python worker."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str, digests: bool = False, tokens: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens and, as asked for, ids (array) or ids_sha256 and decoded_sha256.

    ``path`` is a model file that every executor has. Ids include begin and end; a null or empty text has just these. The mark
    U+2581 in a text decodes to a space, everything else to itself. Repeated rows repeat their result; columns besides doc_id
    and text are not read. A text is one row, whatever its length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>" * tokens + ", ids_sha256 string, decoded_sha256 string" * digests

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for chunk in spans.chunks(batches):
            ids, bounds = model.encode(*spans.text_bytes(chunk.column(1)))
            columns = {"doc_id": chunk.column(0), "n_tokens": pa.array(np.diff(bounds))}
            if tokens:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            if digests:
                texts, ends = model.decode(ids, bounds)
                columns |= {"ids_sha256": _digests(ids.astype("<u4"), bounds), "decoded_sha256": _digests(texts, ends)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return id_and_text(docs).mapInArrow(encode, schema)


def _digests(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    whole, size = values.tobytes(), values.itemsize
    at = (bounds * size).tolist()
    return pa.array([hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())
