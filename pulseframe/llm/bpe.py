"""Byte-level BPE with a public vocabulary: encoding, decoding and their digests.

A text is split by the vocabulary's pattern, and the bytes of each distinct piece are folded by ranked merges: the
adjacent pair of lowest rank is merged, the leftmost first, until no pair has a rank. Decoding looks every id up and
concatenates the bytes. Pieces repeat far more often than they differ, so a worker folds each distinct piece once; the memo
is emptied when it holds ``MEMO`` pieces, which bounds memory and changes no result. (README: why this runs in Arrow
batches and not as a fold in Spark's higher-order functions.)
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pulseframe.llm import spans
from pulseframe.llm.tables import id_and_text

MEMO = 300_000
LONG_PIECE = 1_000
NO_RANK = 1 << 40


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token of a vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def unicode_spaces(pattern: str) -> str:
    r"""The pattern with ``\s`` as Unicode's White_Space, which leaves out the separators U+001C to U+001F."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def fold(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merges in order of rank, the leftmost first among equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n > LONG_PIECE:
        return _fold_long(piece, ranks)
    rank = ranks.get
    cuts = list(range(n + 1))
    pairs = [rank(piece[i : i + 2], NO_RANK) for i in range(n - 1)]
    while pairs:
        best = min(pairs)
        if best == NO_RANK:
            break
        i = pairs.index(best)
        del cuts[i + 1], pairs[i]
        if i:
            pairs[i - 1] = rank(piece[cuts[i - 1] : cuts[i + 1]], NO_RANK)
        if i < len(pairs):
            pairs[i] = rank(piece[cuts[i] : cuts[i + 2]], NO_RANK)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``fold``, with a heap, for pieces where searching all pairs for each merge would be quadratic."""
    import heapq

    n = len(piece)
    end = list(range(1, n + 1))  # part at i covers piece[i:end[i]]; 0: merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Memo(dict):
    """Ids of the pieces seen so far; an unknown piece is folded when it is asked for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > MEMO:
            self.clear()
        ids = self[piece] = tuple(fold(piece.encode(), self.ranks))
        return ids


class Codec:
    """Encoder and decoder with the memo of distinct pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pieces = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.pieces}
        self.split = regex.compile(unicode_spaces(pattern)).findall
        self.memo = _Memo(ranks)

    def encode(self, text: str) -> list[int]:
        """Ids of every match of the pattern, one match after another."""
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def written(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=1)
def codec_of(path: str, pattern: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    return Codec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, digests: bool = False, tokens: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens and, as asked for, ids (array) or ids_sha256 and decoded_sha256.

    ``path`` is a vocabulary file that every executor has, ``pattern`` its splitting pattern. Null and empty texts have no
    ids; repeated rows repeat their result; columns besides doc_id and text are not read. Ids of a text are decoded by
    looking each one up, so ``decoded_sha256`` tests the round trip.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>" * tokens + ", ids_sha256 string, decoded_sha256 string" * digests

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for chunk in spans.chunks(batches):
            counts, ids_out, hashes, backs = [], [], [], []
            for text in chunk.column(1).to_pylist():
                ids = codec.encode(text)
                counts.append(len(ids))
                if tokens:
                    ids_out.append(ids)
                if digests:
                    hashes.append(hashlib.sha256(codec.written(ids).encode()).hexdigest())
                    backs.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            columns = {"doc_id": chunk.column(0), "n_tokens": pa.array(counts, pa.int64())}
            if tokens:
                columns["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
            if digests:
                columns |= {"ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(backs, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return id_and_text(docs).mapInArrow(encode, schema)
