"""Duplicate and near-duplicate suppression within a series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions.edits import Texts, distances
from pulseframe.model import SERIES_LENGTH
from pulseframe.operators.scale import BLOCK_ROWS, HOT_ROWS, consecutive_blocks, newest, split_hot_keys
from pulseframe.session import ensure_checkpoint_dir


def unique_timestamps(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], n: int | None = None) -> DataFrame:
    """The first row of every (key, timestamp); with ``n`` only the newest that many per key.

    An aggregate, so copies of one instant collapse before they are shuffled.
    """
    rest = [c for c in df.columns if c not in keys and c != ts]
    first = df.groupBy(*keys, ts).agg(F.min_by(F.struct(*rest), F.struct(*tie)).alias("__r")).select(*keys, ts, "__r.*")
    return first if n is None else newest(first, keys, [ts], n).drop("__rn")


Fold = Callable[[Sequence, list], tuple[np.ndarray, list]]
#: Rows that are looked at together.
CHUNK = 512
#: Texts of at most so many characters are compared through an index of their one-character deletions.
SHORT = 64
#: Texts that share such an index.
TEXT_CHUNK = 2048


def _fold(prepare: Callable[[list], Any], refuses: Callable[[Any, Any], np.ndarray], size: int) -> Fold:
    """The sequential rule: a value goes if one of the last ``size`` kept values refuses it.

    ``refuses(kept, prepared)`` tells which values of a chunk a kept one refuses. Each value of the chunk only has to know
    the newest kept value that refuses it: it goes as long as that one is among the last ``size``. So work falls on
    kept values, for a whole chunk at a time, and rows that go cost a comparison.
    """

    def fold(values: Sequence, state: list) -> tuple[np.ndarray, list]:
        kept = np.zeros(len(values), dtype=bool)
        state = list(state)
        for low in range(0, len(values), CHUNK):
            chunk = values[low : low + CHUNK]
            number: dict = {}
            which = [number.setdefault(v, len(number)) for v in chunk]
            prepared = prepare(list(number))
            newest = np.full(len(number), -1, np.int64)
            for at, held in enumerate(state):
                newest[refuses(held, prepared)] = at
            for i, (v, k) in enumerate(zip(chunk, which)):
                if newest[k] < max(0, len(state) - size):
                    kept[low + i] = True
                    newest[refuses(v, prepared)] = len(state)
                    state.append(v)
            state = state[-size:]
        return kept, state

    return fold


def _tolerance_fold(q: float, size: int) -> Fold:
    """Refuse a number inside the error band of a kept one; keep at most ``size`` numbers."""

    def refuses(held: float, values: np.ndarray) -> np.ndarray:
        half = held * q / 2
        return (min(held - half, held + half) <= values) & (values <= max(held - half, held + half))

    return _fold(lambda values: np.array(values, dtype=float), refuses, size)


class _OneEdit:
    """Kept texts by their deletions, to find the newest one that equals a text or is one edit away.

    Texts of one length are a substitution apart if they agree without the character at one place; else the longer one agrees
    with the shorter one without some character. So a text meets its like in dictionaries, and nothing is compared.
    """

    def __init__(self, kept: Sequence[str]) -> None:
        self.whole: dict[str, int] = {}
        self.longer: dict[str, int] = {}
        self.substituted: dict[tuple[int, str], int] = {}
        for at, text in enumerate(kept):
            self.add(at, text, self.deletions(text))

    @staticmethod
    def deletions(text: str) -> list[str]:
        return [text[:i] + text[i + 1 :] for i in range(len(text))]

    def add(self, at: int, text: str, without: list[str]) -> None:
        self.whole[text] = at
        self.longer.update(dict.fromkeys(without, at))
        self.substituted.update(dict.fromkeys(enumerate(without), at))

    def newest(self, text: str, without: list[str]) -> int:
        found = max(self.whole.get(text, -1), self.longer.get(text, -1))
        for place in enumerate(without):
            found = max(found, self.substituted.get(place, -1), self.whole.get(place[1], -1))
        return found


def _similarity_fold(q: int, size: int, near: bool) -> Fold:
    """``near=False``: keep a text at least ``q`` edits from every kept one.
    ``near=True``: keep a text less than ``q`` edits from all kept ones."""

    def refuses(held: str, texts: Texts) -> np.ndarray:
        apart = distances(held, texts)
        return apart >= q if near else apart < max(q, 1)

    compared = _fold(Texts, refuses, size)
    if near or q != 2:
        return compared

    def indexed(values: Sequence[str], state: list) -> tuple[list[bool], list]:
        kept, state = [], list(state)
        index, refuser = _OneEdit(state), {}
        for text in values:
            first = max(0, len(state) - size)
            goes = refuser.get(text, -1) >= first
            if not goes:
                without = index.deletions(text)
                refuser[text] = index.newest(text, without)
                goes = refuser[text] >= first
                if not goes:
                    refuser[text] = len(state)
                    index.add(len(state), text, without)
                    state.append(text)
            kept.append(not goes)
        return kept, state[-size:]

    def fold(values: Sequence[str], state: list) -> tuple[np.ndarray, list]:
        kept = np.zeros(len(values), dtype=bool)
        for low in range(0, len(values), TEXT_CHUNK):
            chunk = values[low : low + TEXT_CHUNK]
            by = indexed if max(map(len, [*chunk, *state])) <= SHORT else compared
            kept[low : low + TEXT_CHUNK], state = by(chunk, state)
        return kept, list(state)

    return fold


def _equal(a: list, b: list) -> bool:
    """Whether two states are one; a NaN equals a NaN."""
    return len(a) == len(b) and all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _suppress(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, fold: Fold, size: int, hot_rows: int | None, block_rows: int
) -> DataFrame:
    rows = df.where(F.col(value).isNotNull())
    schema = rows.schema

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, []
        for batch in batches:
            names = list(zip(*(batch[k] for k in keys)))
            starts = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]]
            values = batch[value].tolist()
            mask = np.zeros(len(batch), dtype=bool)
            for start, stop in zip(starts, [*starts[1:], len(batch)]):
                if names[start] != current:
                    current, state = names[start], []
                mask[start:stop], state = fold(values[start:stop], state)
            yield batch[mask]

    def whole(df: DataFrame) -> DataFrame:
        """Sorted rows stream through, so a task holds one batch and the state of one key."""
        return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(in_order, schema)

    if hot_rows is None:
        return whole(rows)
    cold, hot, total = split_hot_keys(rows, keys, hot_rows)
    done = whole(cold)
    if hot is None:
        return done
    blocks = consecutive_blocks(hot, keys, order, 0, block_rows, total).drop("__carry")
    return done.unionByName(_suppress_in_blocks(blocks, schema, list(keys), list(order), value, fold, size))


def _suppress_in_blocks(
    blocks: DataFrame, schema: T.StructType, keys: list[str], order: list[str], value: str, fold: Fold, size: int
) -> DataFrame:
    """The sequential rule over a series cut into blocks, with all blocks at work at once."""
    at = [*keys, "__block"]
    named = [f"__g_{c}" for c in at]

    def emit(pdf: pd.DataFrame, guesses: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        mask = fold(pdf[value].tolist(), list(guesses["guess"].iloc[0]))[0]
        return pdf.loc[mask, schema.names]

    states, _ = settled_states(blocks, schema, keys, order, value, fold, size)
    known = states.select(*[F.col(c).alias(n) for c, n in zip(at, named)], "guess")
    return blocks.groupBy(*at).cogroup(known.groupBy(*named)).applyInPandas(emit, schema)


def settled_states(
    blocks: DataFrame, schema: T.StructType, keys: list[str], order: list[str], value: str, fold: Fold, size: int
) -> tuple[DataFrame, int]:
    """(keys, __block, guess): the values that count at the start of each block; and after how many rounds they settled.

    What a block keeps depends on the values kept before it. That state (at most ``size`` values) is guessed per block, the
    blocks run in parallel, and the states they leave behind correct the guesses. A block that replaced its whole state leaves
    its own values, whatever it started from: the next block starts from them. A block that kept fewer leaves what it added
    itself, put after the state before it. Blocks with a corrected guess run again. What a block does not know of its start
    gets less with every block behind it, so rounds depend on how many blocks fill a state a few times, not on the length of
    the series. Every round settles at least the first unsettled block, so this ends, and when no
    guess changes every state is the one the uncut series has. Rounds are few unless nearly all values are refused by
    values that are replaced all the time. States stream by in order, so no task gathers the blocks of a key.
    """
    ensure_checkpoint_dir(blocks.sparkSession)
    kept_type = schema[value].dataType
    at = [*keys, "__block"]
    id_fields = [schema[k] for k in keys] + [T.StructField("__block", T.LongType())]
    state = T.ArrayType(kept_type)
    states_type = T.StructType([*id_fields, T.StructField("guess", state), T.StructField("left", state), T.StructField("kept", T.LongType())])
    guess_type = T.StructType([*id_fields, T.StructField("guess", state), T.StructField("changed", T.BooleanType())])

    def run(pdf: pd.DataFrame, guesses: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or guesses.empty:
            return pd.DataFrame(columns=states_type.names)
        pdf = pdf.sort_values(order, kind="stable")
        guess = list(guesses["guess"].iloc[0])
        mask, left = fold(pdf[value].tolist(), guess)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in at), guess, left, int(mask.sum())]], columns=states_type.names)

    def correct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, before = None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                name, (guess, left, kept) = row[: len(keys)], row[len(at) :]
                if name != current:
                    current, before = name, []
                guess, left = list(guess), list(left)
                changed = not _equal(guess, before)
                out.append([*row[: len(at)], before, changed])
                before = left if not changed or kept >= size else fold(left[len(left) - kept :], before)[1]
            yield pd.DataFrame(out, columns=guess_type.names)

    named = [f"__g_{c}" for c in at]

    def renamed(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(n) for c, n in zip(at, named)], "guess")

    def matching(df: DataFrame, todo: DataFrame, how: str) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(at, named)]
        return df.join(todo.select(*named), reduce(lambda a, b: a & b, same), how)

    narrow = blocks.select(*dict.fromkeys([*at, *order, value]))
    empty = F.array().cast(state)
    todo, states, rounds = renamed(narrow.select(*at).distinct().withColumn("guess", empty)), None, 0
    while True:
        rounds += 1
        again = matching(narrow, todo, "left_semi")
        ran = again.groupBy(*at).cogroup(todo.groupBy(*named)).applyInPandas(run, states_type)
        settled = ran if states is None else matching(states, todo, "left_anti").unionByName(ran)
        states = settled.checkpoint()
        in_turn = states.select(*states_type.names).repartition(*keys).sortWithinPartitions(*at)
        guesses = in_turn.mapInPandas(correct, guess_type).checkpoint()
        todo = renamed(guesses.where("changed"))
        if todo.isEmpty():
            return guesses, rounds


def tolerance_dedup(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, q: float, size: int = SERIES_LENGTH,
    hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows whose number lies outside the error band of every number kept before (of the last ``size``)."""
    return _suppress(df, keys, order, value, _tolerance_fold(q, size), size, hot_rows, block_rows)


def similarity_dedup(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, q: int, near: bool = False,
    size: int = SERIES_LENGTH, hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows whose text differs from every kept text by ``q`` edits or more.

    ``near=True`` is the opposite gate: only texts less than ``q`` edits from all kept ones.
    """
    return _suppress(df, keys, order, value, _similarity_fold(q, size, near), size, hot_rows, block_rows)


def stream_unique_timestamps(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Unique (key, timestamp) of a stream; the watermark bounds the state."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])
