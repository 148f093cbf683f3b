"""Edit distances of many texts at once, on numpy words.

``Texts`` holds texts as a matrix of code points. ``distances`` runs one text against all of them: the column of the
distance table is kept as bits (Myers, 1999), 64 rows a machine word and one lane per text. ``swap_distances`` takes pairs;
a swap of neighbours is one edit there, also with edits in between, which bits cannot carry, so it fills a band of the
table, one cell of all pairs at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

WORD = 64
#: Cells of a distance table that are held at once.
CELLS = 1 << 24


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Texts:
    """Texts by length, as a matrix of code points; -1 stands behind the end of a text."""

    def __init__(self, texts: Sequence[str]) -> None:
        points = [_points(t) for t in texts]
        self.lengths = np.array([len(p) for p in points], np.int64)
        self.matrix = np.full((len(points), int(self.lengths.max(initial=0))), -1, np.int64)
        for row, p in zip(self.matrix, points):
            row[: len(p)] = p

    def take(self, rows: np.ndarray) -> Texts:
        out = object.__new__(Texts)
        out.lengths = self.lengths[rows]
        out.matrix = self.matrix[rows, : int(out.lengths.max(initial=0))]
        return out


def distances(text: str, texts: Texts) -> np.ndarray:
    """Levenshtein distance of one text to each of many."""
    own = _points(text)
    m, n = len(own), len(texts.lengths)
    out = texts.lengths.copy() if not m else np.full(n, m, np.int64)
    if not m or not n:
        return out
    words = -(-m // WORD)
    chars, number = np.unique(own, return_inverse=True)
    # Which rows have a character: one bit each. The last entry is that of all other characters.
    rows_of = np.zeros((len(chars) + 1, words), np.uint64)
    at = np.arange(m)
    np.bitwise_or.at(rows_of, (number, at // WORD), np.uint64(1) << (at % WORD).astype(np.uint64))
    found = np.minimum(np.searchsorted(chars, texts.matrix), len(chars) - 1)
    found = np.where(chars[found] == texts.matrix, found, len(chars))

    # Longest texts first, so that those still running are a prefix.
    order = np.argsort(-texts.lengths, kind="stable")
    running = np.searchsorted(-texts.lengths[order], -np.arange(1, found.shape[1] + 1), "right")
    one, last = np.uint64(1), np.uint64((m - 1) % WORD)
    up = np.full((words, n), ~np.uint64(0))
    down = np.zeros((words, n), np.uint64)
    score = np.full(n, m, np.int64)
    for j in range(found.shape[1]):
        k = running[j]
        equal = rows_of[found[order[:k], j]]
        more, less = np.ones(k, np.uint64), np.zeros(k, np.uint64)  # the table's upper edge grows by one a column
        for w in range(words):
            p, d, e = up[w, :k], down[w, :k], equal[:, w]
            down_or = e | d
            e = e | less
            across = (((e & p) + p) ^ p) | e
            plus, minus = d | ~(across | p), p & across
            top = last if w == words - 1 else np.uint64(WORD - 1)
            next_more, next_less = (plus >> top) & one, (minus >> top) & one
            plus, minus = (plus << one) | more, (minus << one) | less
            up[w, :k], down[w, :k] = minus | ~(down_or | plus), plus & down_or
            more, less = next_more, next_less
        score[:k] += more.astype(np.int64) - less.astype(np.int64)
    out[order] = score
    return out


def swap_distances(left: Sequence[str], right: Sequence[str], limit: int | None = None) -> np.ndarray:
    """Edit distance of each pair, in which swapping neighbours is one edit (Lowrance and Wagner, 1975); beyond ``limit``, limit + 1."""
    n = len(left)
    out = np.zeros(n, np.int64)
    longest = np.array([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], np.int64)
    order = np.argsort(longest, kind="stable")
    done = 0
    while done < n:
        # As many pairs of the like length as the table has room for.
        take = done + 1
        while take < n and (take + 1 - done) * (longest[order[take]] + 2) * (2 * _reach(longest[order[take]], limit) + 1) <= CELLS:
            take += 1
        rows = order[done:take]
        out[rows] = _swap_table([left[i] for i in rows], [right[i] for i in rows], _reach(int(longest[rows[-1]]), limit), limit)
        done = take
    return out


def _reach(longest: int, limit: int | None) -> int:
    return int(longest if limit is None else min(limit, longest))


def _swap_table(left: list[str], right: list[str], reach: int, limit: int | None) -> np.ndarray:
    a, b = Texts(left), Texts(right)
    pairs, rows = len(left), a.matrix.shape[1]
    far = np.int32(rows + b.matrix.shape[1] + 2 if limit is None else limit + 1)
    chars, number = np.unique(np.concatenate([a.matrix.ravel(), b.matrix.ravel()]), return_inverse=True)
    # -1 is the filling of both; it must not match, and stands for no row.
    left_of, right_of = (x.reshape(t.matrix.shape) for x, t in zip(np.split(number, [a.matrix.size]), (a, b)))
    filled_a, filled_b = a.matrix >= 0, b.matrix >= 0
    lane = np.arange(pairs)
    last_row = np.zeros((pairs, len(chars)), np.int32)
    # Cell (i, j) stands at [i, j - i + reach].
    table = np.full((rows + 1, 2 * reach + 1, pairs), far, np.int32)
    for j in range(min(reach, b.matrix.shape[1]) + 1):
        table[0, j + reach] = j
    out = np.full(pairs, far, np.int64)

    def settle(i: int) -> None:
        ends = np.flatnonzero((a.lengths == i) & (np.abs(b.lengths - i) <= reach))
        out[ends] = table[i, b.lengths[ends] - i + reach, ends]

    settle(0)
    for i in range(1, rows + 1):
        mine, last_column = left_of[:, i - 1], np.zeros(pairs, np.int32)
        if i <= reach:
            table[i, reach - i] = i
        for k in range(max(0, reach + 1 - i), min(2 * reach, b.matrix.shape[1] - i + reach) + 1):
            j = i + k - reach
            other = right_of[:, j - 1]
            same = (mine == other) & filled_a[:, i - 1] & filled_b[:, j - 1]
            best = table[i - 1, k] + ~same
            if k < 2 * reach:
                best = np.minimum(best, table[i - 1, k + 1] + 1)
            if k:
                best = np.minimum(best, table[i, k - 1] + 1)
            from_row, from_column = last_row[lane, other], last_column
            place = from_column - from_row + reach
            swap = np.flatnonzero((from_row > 0) & (from_column > 0) & (place >= 0) & (place <= 2 * reach))
            if len(swap):
                r, c = from_row[swap], from_column[swap]
                best[swap] = np.minimum(best[swap], table[r - 1, place[swap], swap] + (i - r - 1) + 1 + (j - c - 1))
            table[i, k] = np.minimum(best, far)
            last_column = np.where(same, np.int32(j), last_column)
        known = filled_a[:, i - 1]
        last_row[lane[known], mine[known]] = i
        settle(i)
    return out if limit is None else np.minimum(out, limit + 1)
