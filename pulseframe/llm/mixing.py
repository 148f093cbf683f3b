"""Mixing sources to target weights by a splitting tree of multivariate hypergeometric draws.

1. Targets: sources share ``epochs`` times all words by weight; a target stops at ``cap`` times its source's words, and the
   excess is reshared by weight until none is above.
2. Blocks: a source's documents stand in a fixed pseudo-random order, cut into blocks of equal words. A source's quota is
   the number of block draws that comes nearest to its target. Whole rounds draw every block once; the last round draws
   the first blocks of a permutation, so draws of a round are disjoint.
3. Splitting tree: the quotas of all sources are divided between the two halves of the output shards by one multivariate
   hypergeometric draw, and so on down to single shards. A shard then owns consecutive draws of each source.
4. Documents are taken whole where their blocks are drawn; only those on the edge of a drawn block are cut.

All randomness comes from ``seed``, so reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import spans
from pulseframe.llm.positions import running_start
from pulseframe.llm.tables import free_name, id_and_text

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 1.5
CAP = 2.0
SHARDS = 16
BLOCKS = 1_024
MIN_BLOCK, MAX_BLOCK = 1, 65_536
#: Pieces of a shard that are sorted apart.
PARTS = 8


@dataclass(frozen=True)
class Mix:
    """What a source contributes."""

    source: str | None
    size: int
    target: float
    block: int
    blocks: int
    draws: int
    key: int
    shard_ends: tuple[int, ...]


def targets(sizes: list[int], weights: list[float], epochs: float = EPOCHS, cap: float = CAP) -> list[float]:
    """Words of each source, in the order given."""
    limit = [cap * s for s in sizes]
    out = [0.0] * len(sizes)
    left, active = epochs * sum(sizes), set(range(len(sizes)))
    while active:
        total = sum(weights[i] for i in active)
        over = {i for i in active if left * weights[i] / total > limit[i]}
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in sorted(over):
            out[i] = limit[i]
            left -= limit[i]
        left = max(left, 0.0)
        active -= over
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """[source, shard] block draws: each node of the tree splits its quotas in proportion to the shards on its two sides."""
    out = np.zeros((len(quotas), shards), np.int64)

    def split(own: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = own
            return
        middle = (first + last) // 2
        n = int(own.sum()) * (middle - first) // (last - first)
        rng = np.random.default_rng([seed, first, last])
        # The marginal method has no limit on the size of the urn.
        left = _draw(rng, own, n)
        split(left, first, middle)
        split(own - left, middle, last)

    split(np.array(quotas, np.int64), 0, shards)
    return out


def _draw(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    if colors.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(colors, n, method="marginals")
    # Beyond numpy's range the draw is replaced by its expectation, rounded to the exact total.
    share = colors * (n / colors.sum())
    out = np.floor(share).astype(np.int64)
    out[np.argsort(out - share, kind="stable")[: n - int(out.sum())]] += 1
    return out


def permuted(block: np.ndarray, blocks: int, key: int) -> np.ndarray:
    """Rank of each block in a keyed permutation of range(blocks): a Feistel network, walked until it is in range."""
    half = max(1, (max(blocks - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = block.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            f = spans.mix(right + np.uint64((key * 4 + r) & ((1 << 64) - 1))) & mask
            left, right = right, left ^ f
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= blocks]
    return out.astype(np.int64)


def plan_mix(sizes: DataFrame, shards: int = SHARDS, seed: int = 11, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, cap: float = CAP) -> list[Mix]:
    """The mix of a table (source, source_size) with one row per source, which is what reaches the driver."""
    rows = sizes.orderBy(F.col("source").isNull(), "source").collect()
    words = [r["source_size"] for r in rows]
    wanted = targets(words, [weights[i % len(weights)] for i in range(len(rows))], epochs, cap)
    blocks, draws, lengths = [], [], []
    for n, t in zip(words, wanted, strict=True):
        length = min(max(n // BLOCKS, MIN_BLOCK), MAX_BLOCK)
        count = -(-n // length)
        lengths.append(length)
        blocks.append(count)
        draws.append(min(int(cap * count), round(t * count / n)) if n else 0)
    ends = np.cumsum(split_quotas(draws, shards, seed), axis=1)
    return [
        Mix(r["source"], words[i], wanted[i], lengths[i], blocks[i], draws[i], seed * 1_000_003 + i, tuple(ends[i].tolist()))
        for i, r in enumerate(rows)
    ]


def runs_of(start: np.ndarray, size: np.ndarray, mix: Mix) -> list[list[tuple[int, int, int, int, int]]]:
    """(round, from_word, to_word, shard, place) of the pieces taken of each document, which stand at ``start`` of one source."""
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in start]
    full = np.flatnonzero(size)
    if not len(full):
        return out
    start, size = start[full], size[full]
    low = start // mix.block
    count = (start + size - 1) // mix.block + 1 - low
    doc, first = np.repeat(np.arange(len(full)), count), np.cumsum(count) - count
    block = low[doc] + np.arange(len(doc)) - first[doc]
    begin = np.maximum(block * mix.block, start[doc]) - start[doc]
    end = np.minimum((block + 1) * mix.block, start[doc] + size[doc]) - start[doc]
    opens, closes = np.zeros((2, len(doc)), dtype=bool)
    opens[first], closes[first + count - 1] = True, True
    for turn in range(-(-mix.draws // mix.blocks)):
        draw = turn * mix.blocks + permuted(block, mix.blocks, mix.key * 97 + turn)
        taken = draw < mix.draws
        a = np.flatnonzero(taken & (opens | ~np.concatenate([[False], taken[:-1]])))
        b = np.flatnonzero(taken & (closes | ~np.concatenate([taken[1:], [False]])))
        shard = np.searchsorted(mix.shard_ends, draw[a], "right")
        for i, *piece in zip(full[doc[a]].tolist(), begin[a].tolist(), end[b].tolist(), shard.tolist(), draw[a].tolist(), strict=True):
            out[i].append((turn, *piece))
    return out


def _runs(source: list, start: np.ndarray, size: np.ndarray, plan: dict[str | None, Mix]) -> list[list[tuple[int, int, int, int, int]]]:
    """``runs_of`` documents of several sources."""
    out: list = [None] * len(source)
    places: dict[str | None, list[int]] = {}
    for i, s in enumerate(source):
        places.setdefault(s, []).append(i)
    for s, at in places.items():
        for i, found in zip(at, runs_of(start[at], size[at], plan[s]), strict=True):
            out[i] = found
    return out


def sized_documents(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, source, size (words) of every whole text, and further columns; a null text has none."""
    rows = id_and_text(docs, F.col("source").cast("string").alias("__source"), *carried)
    types = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "text"}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in spans.chunks(batches):
            data, bounds = spans.text_bytes(chunk.column(1))
            n = np.bincount(spans.words(data, bounds)[2], minlength=chunk.num_rows)
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), *chunk.columns[2:], pa.array(n.astype(np.int64))], names=[*types, "size"]
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in types.items()) + ", size long"
    return rows.mapInArrow(count, schema).withColumnRenamed("__source", "source")


RUNS = "array<struct<turn:int,from_word:long,to_word:long,shard:int,place:long>>"


def _placed(docs: DataFrame, shards: int, seed: int, *carried: str) -> tuple[dict[str | None, Mix], DataFrame]:
    """What each source contributes, and the documents with their places in their source's order."""
    sizes = sized_documents(docs).groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    plan = {m.source: m for m in plan_mix(sizes, shards, seed)}
    sized = sized_documents(docs, *carried)
    return plan, running_start(sized, ["source"], ["doc_id", "size"], F.col("size"), "start", seed=seed)


def mix_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, runs.

    ``runs`` are the pieces taken: round, first word, word behind the last, output shard, and the place of its first block
    in the source's draws. ``taken`` is their words. A null source is a source of its own, last in order; documents
    without words are kept with nothing taken; repeated rows are documents of their own. Columns besides doc_id, text and
    source are not read. A source that holds most rows is ordered in pieces (``running_start``).
    """
    plan, placed = _placed(docs, shards, seed)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            source = batch["source"].astype(object).where(batch["source"].notna(), None)
            mixes = [plan[s] for s in source]
            runs = _runs(source.tolist(), batch["start"].to_numpy(np.int64), batch["size"].to_numpy(np.int64), plan)
            names = ("turn", "from_word", "to_word", "shard", "place")
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "source": source, "size": batch["size"],
                "source_size": [m.size for m in mixes], "target": [float(m.target) for m in mixes],
                "taken": [sum(b - a for _, a, b, _, _ in r) for r in runs],
                "runs": [[dict(zip(names, x, strict=True)) for x in r] for r in runs],
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.select("doc_id", "source", "size", "start").mapInPandas(
        take, f"doc_id {kind}, source string, size long, source_size long, target double, taken long, runs {RUNS}"
    )


def mixed_texts(docs: DataFrame, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """The mix itself: a row for each piece taken, with the columns of ``docs``, in shards that are shuffled locally.

    A document taken whole keeps its text as it is; of one that is cut, the text from the first to the last word taken
    stays. ``n_chars``, if there is one, is that of the row's text. A document of two rounds comes twice; one without
    words not at all.
    """
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("__row"), "doc_id", "text", "source")
    plan, placed = _placed(whole, shards, seed, "__row")
    at = names.index("text")
    shard_name, order_name, part_name = (free_name(docs, n) for n in ("shard", "place_in_shard", "part_of_shard"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                source, size, start = (part.column(i).to_pylist() for i in (1, 2, 3))
                row = part.column(0)
                fields = row.flatten()
                texts = fields[at].to_pylist()
                index, cut, shard, order = [], [], [], []
                found = _runs(source, np.array(start, np.int64), np.array(size, np.int64), plan)
                for i, (n, pieces) in enumerate(zip(size, found, strict=True)):
                    for turn, a, b, to, place in pieces:
                        index.append(i)
                        cut.append(texts[i] if b - a == n else _words_of(texts[i], a, b))
                        shard.append(to)
                        order.append(place * 1_009 + turn)
                columns = [f.take(pa.array(index, pa.int32())) for f in fields]
                columns[at] = pa.array(cut, fields[at].type)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(shard, pa.int32()), pa.array(order, pa.int64())], names=[*names, shard_name, order_name]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {shard_name} int, {order_name} long"
    pieces = placed.select("__row", "source", "size", "start").mapInArrow(take, schema)
    if "n_chars" in names:
        pieces = pieces.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    # A shard is one or more partitions; within it the order is by a hash, i.e. shuffled, and repeatable.
    mixed = F.xxhash64(F.lit(seed), order_name, "doc_id")
    dealt = pieces.withColumn(part_name, F.pmod(mixed, F.lit(PARTS)))
    local = dealt.repartition(shard_name, part_name).sortWithinPartitions(shard_name, mixed)
    return local.select(*names)


def _words_of(text: str, first: int, last: int) -> str:
    """The text from its word ``first`` to the one before ``last``."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = spans.words(data, np.array([0, len(data)]))
    return data[starts[first] : ends[last - 1]].tobytes().decode()
