"""Exact self-join of documents on word shingles (Jaccard at least 0.8), as components of linked documents.

Prefix filter: the shingles of a set stand in one global order, and two sets that link share one of the first
n - ceil(0.8 n) + 1 of each. The order puts shingles that are frequent in the corpus last (by a count sketch over all
documents) and is by hash otherwise, so index lists stay short.

Set relations, after Wang et al. (2017), save most of the rest:

* Index level: an entry of a list carries its set's size and its position there. Sizes beyond 1.25 times a set's and positions
  at which too few shingles are left to reach the overlap are skipped.
* Answer level: sets of one list are mostly copies of each other. Each is first compared with the list's leader only (the
  same one in all lists that it is in). What links to a leader has its answer from it: it needs no further comparison
  with the leader's other answers. Lists that are still in several components then get other leaders, first of all their
  most central set: the one in most of these lists. A near copy has new shingles, which are rare, in front of its order and
  so stands in fewer shared lists than what it was made from. Only pairs of a list that are in different components even
  then are looked at in the last round, which makes the result exact.
* There, a set is known by a signature of 512 bits, the parity of its shingles in each of 512 cells. Two signatures differ in at most
  as many bits as two sets in shingles, so a pair whose signatures differ in more than links allow is passed over before it
  is a row. Lists of more than ``LIST`` sets are dealt out: blocks of a list meet pairwise in units of their own.
* In all rounds a pair's texts are only fetched if it shares enough lists (``least_shared``). How many lists each leader shares
  with a set is counted once, so leaders, and with them all lists of two sets, are settled after the first round; later
  rounds hold only the others of a list, and add that count for pairs that meet there.
* Which texts are wanted is known by a filter of bits before they move, however many they are.

The answer of a set is its component; sets of answers are not listed, so the incremental derivation is that of
components. Equal sets are one node, named by 64 bits of a hash; another 64 tell apart sets whose names are equal by chance.
Texts move to the leader they are compared with, in portions, and a task holds one leader's set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import spans
from pulseframe.llm.graph import connected_components
from pulseframe.llm.tables import free_name
from pulseframe.session import scratch_path

WIDTH = 5
#: Linked if NUMERATOR * union <= DENOMINATOR * intersection.
NUMERATOR, DENOMINATOR = 4, 5
SKETCH = 1 << 18
SKETCH_BLOCK = 1 << 12
PORTION = 256
#: Sets of a list that meet in one unit of the last round, at most twice as many.
LIST = 4_096
SIGNATURE = 512
#: Bits of the filter of wanted texts: so many for each, in blocks, up to a limit beyond which more texts move than are wanted.
FILTER_BITS = 16
FILTER_BLOCK = 1 << 17
FILTER_MOST = 1 << 26
#: Documents of one set are dealt among so many pieces where they meet its answer.
CELLS = 64


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each row, by row; a row of fewer than five words has one, of all of them."""
    low = spans.LOWER[data]
    starts, ends, row = spans.words(low, bounds)
    hashes = spans.range_names(low, starts, ends)
    out, at = spans.word_windows(hashes, row, WIDTH)
    found, rows = [spans.mix(out + np.uint64(WIDTH))], [row[at]]
    count = np.bincount(row, minlength=len(bounds) - 1)
    for width in range(1, WIDTH):
        short = count[row] == width
        if short.any():
            out, at = spans.word_windows(hashes[short], row[short], width)
            found.append(spans.mix(out + np.uint64(width)))
            rows.append(row[short][at])
    hashes, rows_ = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((hashes, rows_))
    hashes, rows_ = hashes[order], rows_[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows_[1:] != rows_[:-1])
    return hashes[new], rows_[new]


def set_names(hashes: np.ndarray, row: np.ndarray, rows: int, twins: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, second name, size) of each row's set; names do not depend on order. Sets whose name is in ``twins`` are named
    by both names."""
    size = np.bincount(row, minlength=rows)
    ends = np.cumsum(size)

    def summed(salt: int) -> np.ndarray:
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(spans.mix(hashes ^ np.uint64(salt)), out=total[1:])
        return spans.mix(total[ends] - total[ends - size] + size.astype(np.uint64))

    name, second = summed(0xA5A5A5A55A5A5A5A), summed(0x3C3C3C3CC3C3C3C3)
    if twins:
        shared = np.isin(name.view(np.int64), list(twins))
        name[shared] = spans.mix(name[shared] ^ spans.mix(second[shared]))
    return name.view(np.int64), second.view(np.int64), size


def signatures(hashes: np.ndarray, row: np.ndarray, rows: int) -> list[bytes]:
    """Parity of each row's shingles in each of ``SIGNATURE`` cells."""
    cell = (spans.mix(hashes) & np.uint64(SIGNATURE - 1)).astype(np.int64)
    cuts = np.searchsorted(row, np.arange(rows + 1))
    out: list[bytes] = []
    for low in range(0, rows, 4_096):
        high = min(rows, low + 4_096)
        part = slice(cuts[low], cuts[high])
        odd = np.bincount((row[part] - low) * SIGNATURE + cell[part], minlength=(high - low) * SIGNATURE) & 1
        packed = np.packbits(odd.astype(np.uint8)).tobytes()
        out += [packed[i : i + SIGNATURE // 8] for i in range(0, len(packed), SIGNATURE // 8)]
    return out


def _ints(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], names=list(columns))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def describe_sets(rows: DataFrame) -> DataFrame:
    """(doc_id, check, n, node, second, sign, cell) of every document, and (block, counts) of the shingle sketch, in one pass."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "check", "n", "node", "second", "sign", "cell", "block", "counts"]
        sketch = np.zeros(SKETCH, np.int32)
        id_type, done = None, 0
        for chunk in spans.chunks(batches):
            hashes, row = shingles(*spans.text_bytes(chunk.column(1)))
            node, second, size = set_names(hashes, row, chunk.num_rows)
            sign = pa.array(signatures(hashes, row, chunk.num_rows), pa.binary())
            np.add.at(sketch, (hashes >> np.uint64(46)).astype(np.int64), 1)
            id_type = chunk.column(0).type
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), chunk.column(2), pa.array(size.astype(np.int64)), pa.array(node), pa.array(second), sign, pa.array(((done + np.arange(len(node))) % CELLS).astype(np.int32)), pa.nulls(len(node), pa.int32()), pa.nulls(len(node), pa.binary())],
                names=names,
            )
            done += len(node)
        if id_type is None:
            return
        for block in range(SKETCH // SKETCH_BLOCK):
            counts = sketch[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK]
            if counts.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([block], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=names
                )

    return rows.select("doc_id", "text", "check").mapInArrow(
        read, f"doc_id {kind}, check long, n long, node long, second long, sign binary, cell int, block int, counts binary"
    )


def _sketch(described: DataFrame) -> np.ndarray:
    """Counts of all tasks, added block by block as they stream by; ``SKETCH`` numbers come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals.setdefault(block, np.zeros(SKETCH_BLOCK, np.int64))
                totals[block] += np.frombuffer(counts, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros(SKETCH, np.int64)
    parts = described.where("block is not null").select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary")
    for row in parts.collect():
        out[row["block"] * SKETCH_BLOCK : (row["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(row["counts"], np.int64)
    return out


def frequency_classes(sketch: np.ndarray) -> np.ndarray:
    """Class of each sketch cell, 0 for ordinary ones, one more for each doubling beyond twice the mean load."""
    mean = max(1.0, float(sketch.mean()))
    return np.clip(np.ceil(np.log2(np.maximum(sketch, 1) / (2 * mean))), 0, 15).astype(np.uint64)


def ordered(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Ranks of shingles in the global order."""
    return (classes[(hashes >> np.uint64(46)).astype(np.int64)] << np.uint64(60)) | (hashes >> np.uint64(4))


def least_overlap(n: np.ndarray) -> np.ndarray:
    return -(-NUMERATOR * n // DENOMINATOR)


def pair_overlap(n, m):
    """The least intersection with which sets of sizes n and m link."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def index_entries(rows: DataFrame, classes: np.ndarray, twins: frozenset[int]) -> DataFrame:
    """(token, node, size, place) of the prefix of every set; a task indexes a set that it has seen once only."""
    classes = classes.astype(np.uint8)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = classes.astype(np.uint64)
        seen: set[int] = set()
        for chunk in spans.chunks(batches):
            hashes, row = shingles(*spans.text_bytes(chunk.column(0)))
            node, _, size = set_names(hashes, row, chunk.num_rows, twins)
            fresh = np.zeros(len(node), bool)
            for i, name in enumerate(node.tolist()):
                if name not in seen:
                    seen.add(name)
                    fresh[i] = True
            if len(seen) > 1_000_000:  # forgetting only repeats entries
                seen.clear()
            rank = ordered(hashes, wide)
            keep = fresh[row]
            rank, row = rank[keep], row[keep]
            order = np.lexsort((rank, row))
            rank, row = rank[order], row[order]
            held = np.where(fresh, size, 0)
            place = np.arange(len(row)) - (np.cumsum(held) - held)[row]
            n = size[row]
            inside = place <= n - least_overlap(n)
            yield _ints({"token": rank[inside], "node": node[row[inside]], "at": (n[inside] << 32) | place[inside]})

    return rows.select("text").mapInArrow(make, "token long, node long, at long")


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(tokens[1:] != tokens[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(tokens)]])


def least_shared(size_a, place_a, size_b, place_b):
    """How many prefix tokens two sets have to share in order to link; 0 if they cannot, given a shared one at these places.

    Of the two prefixes, let one end first in the global order. All that the sets share up to there is in both prefixes,
    and behind it that set has ceil(0.8 n) - 1 tokens left. So the overlap is at most the shared prefix tokens plus that.
    """
    need = pair_overlap(size_a, size_b) - np.maximum(least_overlap(size_a), least_overlap(size_b)) + 1
    return np.where(possible(size_a, place_a, size_b, place_b), np.maximum(need, 1), 0)


def shared_lists(entries: DataFrame) -> DataFrame:
    """(token, node, at, leader, need, more): lists with more than one set, without repeats.

    The leader is the list's least node; ``need``: the least number of lists that a set has to share with it. A list of two
    sets is not ``more``, unless it ends where a batch does.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_token = last_node = leader = leader_at = None
        held: np.ndarray | None = None  # the first row of a list whose next row has not come yet
        for batch in batches:
            token, node, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held is not None:
                token, node, at = (np.concatenate([h, c]) for h, c in zip(held, (token, node, at), strict=True))
                last_token = last_node = None
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            new[0] = token[0] != last_token or node[0] != last_node or last_token is None
            last = int(token[-1]), int(node[-1])
            token, node, at = token[new], node[new], at[new]
            held = None
            if not len(token):
                continue
            first, end = _runs(token)
            lead, lead_at = (np.repeat(c[first], end - first) for c in (node, at))
            count = np.repeat(end - first, end - first)
            more = count > 2
            more[first[-1] :] = True
            going_on = last_token is not None and token[0] == last_token
            if going_on:
                lead[: end[0]], lead_at[: end[0]] = leader, leader_at
                count[: end[0]] = 2
                more[: end[0]] = True
            if count[-1] == 1:  # may get company
                held = (token[-1:], node[-1:], at[-1:])
            else:
                leader, leader_at = lead[-1], lead_at[-1]
            out = count > 1
            last_token, last_node = (None, None) if held is not None else last
            if out.any():
                need = least_shared(at >> 32, at & 0xFFFFFFFF, lead_at >> 32, lead_at & 0xFFFFFFFF)
                yield _ints({"token": token[out], "node": node[out], "at": at[out], "leader": lead[out], "need": need[out], "more": more[out]})

    return entries.repartition("token").sortWithinPartitions("token", "node").mapInArrow(
        make, "token long, node long, at long, leader long, need long, more boolean"
    )


def possible(size_a, place_a, size_b, place_b):
    """Whether sets can link that share a token at these places of their orders and none before it."""
    need = pair_overlap(size_a, size_b)
    left = np.minimum(size_a - place_a, size_b - place_b)
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return (NUMERATOR * large <= DENOMINATOR * small) & (left + np.minimum(place_a, place_b) >= need)


def led_pairs(lists: DataFrame) -> DataFrame:
    """(a, b, need, lists): in how many lists a leads b, and how many the two have to share."""
    led = lists.where("leader <> node and need > 0").select(F.col("leader").alias("a"), F.col("node").alias("b"), "need")
    return led.groupBy("a", "b", "need").agg(F.count("*").alias("lists"))


def frequent(pairs: DataFrame, led: DataFrame) -> DataFrame:
    """The pairs (a, b) that share at least ``need`` lists, of one row for each list in which neither leads, and of the counts of
    those in which a does. Pairs that the latter alone find are left out."""
    none = F.lit(0).cast("long")
    met = pairs.select("a", "b", "need", F.lit(1).cast("long").alias("lists"), none.alias("led"))
    both = met.unionByName(led.select("a", "b", "need", none.alias("lists"), F.col("lists").alias("led")))
    counted = both.groupBy("a", "b", "need").agg(F.sum("lists").alias("lists"), F.sum("led").alias("led"))
    return counted.where("lists > 0 and led < need and lists + led >= need").select("a", "b")


def split_lists(lists: DataFrame, component: DataFrame) -> DataFrame:
    """(token, node, at, component) of the lists that are in several components; a set without links is its own."""
    now = lists.join(component, "node", "left").select("token", "node", "at", F.coalesce("component", "node").alias("component"))
    mixed = now.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return now.join(mixed.select("token"), "token", "left_semi")


def led_again(lists: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a list's sets with two others of it, its most central one and one taken by a hash, that are in another
    component. ``lists``: token, node, at, component of the lists that are in several components; ``counts``: ``led_pairs``."""
    # In how many of the lists a set is.
    votes = lists.groupBy("node").agg(F.count("*").alias("votes"))
    one = F.struct("node", "at", "component")
    leaders = F.array(F.max_by(one, F.struct("votes", F.xxhash64("node"))), F.min_by(one, F.xxhash64(F.lit(1), "node")))
    led = lists.join(votes, "node").groupBy("token").agg(F.array_distinct(leaders).alias("leaders"))
    pairs = lists.join(led, "token").select("node", "at", "component", F.explode("leaders").alias("other"))
    n, m = (F.shiftright(at, 32) for at in (F.col("at"), F.col("other.at")))
    i, j = (at.bitwiseAND(F.lit(0xFFFFFFFF)) for at in (F.col("at"), F.col("other.at")))
    # As in ``pair_overlap``, ``least_overlap``, ``possible`` and ``least_shared``.
    overlap = F.ceil(NUMERATOR * (n + m) / (NUMERATOR + DENOMINATOR))
    can = (NUMERATOR * F.greatest(n, m) <= DENOMINATOR * F.least(n, m)) & (F.least(n - i, m - j) + F.least(i, j) >= overlap)
    need = F.greatest(overlap - F.ceil(NUMERATOR * F.greatest(n, m) / DENOMINATOR) + 1, F.lit(1))
    apart = pairs.where((F.col("component") != F.col("other.component")) & can)
    return frequent(apart.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b"), need.alias("need")), counts)


def dealt_lists(lists: DataFrame) -> DataFrame:
    """The entries of each list, with the unit in which they meet and their block of the list.

    A list of at most ``LIST`` sets is one unit. A longer one is cut into blocks by a hash, and every two of its blocks, and
    every block alone, are a unit, so no task holds more than two blocks.
    """
    blocks = lists.groupBy("token").agg(F.ceil(F.count("*") / LIST).cast("int").alias("blocks"))
    own = lists.join(blocks, "token").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = own.withColumn("partner", partner)
    unit = F.least("block", "partner") * F.col("blocks") + F.greatest("block", "partner")
    return met.select("token", unit.cast("long").alias("unit"), "at", "node", "component", "block", (F.col("block") != F.col("partner")).alias("across"))


def cross_pairs(lists: DataFrame, signs: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that can link. ``lists``: token, at, node, component; ``signs``: node, sign;
    ``counts``: ``led_pairs``.

    Within a unit, ordered by size and place, sets are compared with those 1, 2, 3 ... places behind, all at once; a set
    drops out where its unit ends or sizes go beyond what it can link to. What is left are pairs of signatures that differ
    in no more bits than two sets that link can differ in shingles.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def pairs(token, unit, at, node, component, block, across, sign) -> Iterator[pa.RecordBatch]:
            size, place = at >> 32, at & 0xFFFFFFFF
            first, end = _units(token, unit)
            end = np.repeat(end, end - first)
            left, step = np.arange(len(token)), 1
            while True:
                left = left[left + step < end[left]]
                left = left[NUMERATOR * size[left + step] <= DENOMINATOR * size[left]]
                if not len(left):
                    return
                i = left[(component[left] != component[left + step]) & (~across[left] | (block[left] != block[left + step]))]
                j = i + step
                need = least_shared(size[i], place[i], size[j], place[j])
                i, j, need = i[need > 0], j[need > 0], need[need > 0]
                apart = np.bitwise_count(sign[i] ^ sign[j]).sum(1, dtype=np.int64)
                near = apart <= size[i] + size[j] - 2 * pair_overlap(size[i], size[j])
                i, j, need = i[near], j[near], need[near]
                if len(i):
                    yield _ints({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "need": need})
                step += 1

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
            columns.append(np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(-1, SIGNATURE // 64))
            if held:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            last = _units(columns[0], columns[1])[0][-1]
            if last:
                yield from pairs(*(c[:last] for c in columns))
            held = [c[last:] for c in columns]
        if held and len(held[0]):
            yield from pairs(*held)

    signed = dealt_lists(lists).join(signs, "node").select("token", "unit", "at", "node", "component", "block", "across", "sign")
    found = signed.repartition("token", "unit").sortWithinPartitions("token", "unit", "at")
    return frequent(found.mapInArrow(make, "a long, b long, need long"), counts)


def _units(token: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero((token[1:] != token[:-1]) | (unit[1:] != unit[:-1])) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(token)]])


def key_filter(keys: DataFrame, name: str = "key") -> np.ndarray:
    """Bits of a Bloom filter of a column of hashes, with two probes each; at most ``FILTER_MOST`` bits come to the driver."""
    bits = FILTER_BLOCK
    while bits < min(FILTER_MOST, FILTER_BITS * keys.count()):
        bits *= 2
    cells = F.array(F.col(name).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(name, 32).bitwiseAND(F.lit(bits - 1)))
    probes = keys.select(F.explode(cells).alias("cell")).select("cell", F.expr(f"cell div {FILTER_BLOCK}").alias("block"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, block = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for b in np.unique(block).tolist():
                blocks.setdefault(b, np.zeros(FILTER_BLOCK, bool))[cell[block == b] % FILTER_BLOCK] = True
        packed = [np.packbits(held).tobytes() for held in blocks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(packed, pa.binary())], names=["block", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in probes.repartition("block").mapInArrow(mark, "block long, bits binary").collect():
        at = row["block"] * FILTER_BLOCK // 8
        out[at : at + FILTER_BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each key may be one that ``key_filter`` was given; true for all that were."""
    key, last = key.view(np.uint64), np.uint64(8 * len(bits) - 1)
    probes = ((key & last).astype(np.int64), ((key >> np.uint64(32)) & last).astype(np.int64))
    first, second = ((bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 for p in probes)
    return (first & second).astype(bool)


def packed_texts(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(key, check, packed) of the rows whose key, the hash of doc_id and check, passes the filter. Only these leave their task."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            chosen = batch.filter(pa.array(passes(bits, batch.column(0).to_numpy(zero_copy_only=False))))
            for chunk in spans.chunks(iter([chosen])):
                data, bounds = spans.text_bytes(chunk.column(2))
                whole = data.tobytes()
                bodies = [compress(whole[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*chunk.columns[:2], pa.array(bodies, pa.binary())], names=["key", "check", "packed"])

    return rows.select(F.xxhash64("doc_id", "check").alias("key"), "check", "text").mapInArrow(squeeze, "key long, check long, packed binary")


def compare(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Each b's text goes to a portion of a's pairs, with a's text.

    ``nodes``: (node, least, check), the row of ``rows`` (doc_id, text, check) that has a set's text. Where the texts are
    wanted is written first; texts that are not wanted stay where they are.
    """
    portions = pairs.groupBy("a").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    dealt = pairs.join(portions, "a").withColumn("portion", F.pmod(F.xxhash64("b"), F.col("portions")))
    leaders = dealt.select("a", "portion").distinct().select("a", "portion", F.lit(0).alias("role"), F.col("a").alias("b"))
    meeting = dealt.select("a", "portion", F.lit(1).alias("role"), "b").unionByName(leaders)
    known = nodes.select(F.col("node").alias("b"), F.xxhash64("least", "check").alias("key"), "check")
    wanted = _stored(meeting.join(known, "b"), "wanted")
    # Repeated rows give a set several equal texts; one is enough.
    texts = packed_texts(rows, key_filter(wanted.select("key").distinct())).dropDuplicates(["key", "check"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        leader, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found_a, found_b = [], []
            for a, role, b, packed in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                data = np.frombuffer(unpack(packed), np.uint8)
                hashes, _ = shingles(data, np.array([0, len(data)]))
                if not role:
                    leader, own = a, hashes
                    continue
                if a != leader:
                    raise ValueError("a pair without its leader's text")
                common = len(np.intersect1d(own, hashes, assume_unique=True))
                if NUMERATOR * (len(own) + len(hashes) - common) <= DENOMINATOR * common:
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    sent = texts.join(wanted, ["key", "check"]).select("a", "portion", "role", "b", "packed")
    both = sent.repartition("a", "portion").sortWithinPartitions("a", "portion", "role")
    return both.mapInArrow(test, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs of other than ASCII white space, A-Z in lower case. The set of a text (null: empty) has its distinct
    5-word shingles, or all words as one if there are fewer; a text without words has an empty set, which links to nothing
    and is a component of its own. Two documents link if 100 x intersection >= 80 x union. ``component_id`` is the least
    doc_id reachable by links. Repeated rows and copies are one node. A null doc_id is never a component's name unless all
    of its documents have none. Columns besides doc_id and text are not read.
    """
    return _components(docs).select("doc_id", "n_shingles", "component_id")


def _told_apart(sets: DataFrame, twins: frozenset[int]) -> DataFrame:
    """The sets, those whose name is shared by chance under the name that ``set_names`` gives them."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, second = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            shared, name = np.isin(node, list(twins)), node.copy()
            name[shared] = spans.mix(node[shared].view(np.uint64) ^ spans.mix(second[shared].view(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(name), *batch.columns[4:]], names=batch.schema.names)

    return sets.mapInArrow(rename, sets.schema)


def _components(docs: DataFrame) -> DataFrame:
    """``jaccard_components`` with ``check``, the hash of the text, and ``component``, a node of the component: a name of
    its own even where doc_ids are null or repeat (null: a text without words)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("check", F.xxhash64("text"))
    described = _stored(describe_sets(rows), "sets")
    classes = frequency_classes(_sketch(described))
    sets = described.where("block is null").select("doc_id", "check", "n", "node", "second", "sign", "cell")

    def nodes_of(sets: DataFrame) -> DataFrame:
        named = sets.where("n > 0").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "check")).alias("of"), F.first("sign").alias("sign"),
            (F.min("second") != F.max("second")).alias("twins"),
        )
        return _stored(named.select("node", F.col("of.doc_id").alias("least"), F.col("of.check").alias("check"), "sign", "twins"), "nodes")

    nodes = nodes_of(sets)
    # Different sets with one name of 64 bits: about one for 10^19 pairs of sets, so what reaches the driver is next to nothing.
    twins = frozenset(r["node"] for r in nodes.where("twins").select("node").collect())
    if twins:
        sets = _told_apart(sets, twins)
        nodes = nodes_of(sets)

    lists = _stored(shared_lists(index_entries(rows, classes, twins)), "lists")

    counts = _stored(led_pairs(lists), "led")
    stars = counts.where("lists >= need").select("a", "b")
    links = _stored(compare(stars, nodes, rows), "links")
    component = connected_components(links)

    # What links to a leader is answered. Lists whose other sets are still in several components get other leaders,
    mixed = _stored(split_lists(lists.where("leader <> node and more"), component), "mixed")
    again = _stored(led_again(mixed, counts), "again")
    if not again.isEmpty():
        links = _stored(links.unionByName(compare(again, nodes, rows)), "links")
        component = connected_components(links)
        mixed = _stored(split_lists(mixed.drop("component"), component), "mixed")
    # and in the end every pair of a list that is in two components and was not compared yet.
    pairs = cross_pairs(mixed, nodes.select("node", "sign"), counts)
    rest = _stored(pairs.join(again, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = _stored(compare(rest, nodes, rows), "more-links")
        if not more.isEmpty():
            component = connected_components(links.unionByName(more))
    roots = component.join(nodes, "node").groupBy("component").agg(F.min("least").alias("root"))
    answer = nodes.join(component, "node", "left").join(roots, "component", "left").select(
        "node", F.coalesce("root", "least").alias("name"), F.coalesce("component", "node").alias("component")
    )
    full = F.col("n") > 0
    # A set may be that of very many documents: they and its answer are dealt among cells.
    answers = sets.select("node", "cell").distinct().join(answer, "node")
    return sets.join(answers, ["node", "cell"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(full, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"),
        "check", F.when(full, F.col("component")).alias("component"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the least doc_id (null last), then of the least text hash.

    A row is known by its doc_id and text. Of rows equal in both, one stays, also of those whose text has no words.
    """
    found = _components(docs).groupBy("doc_id", "check", "component").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "check", "rows")).alias("of")
    named = found.where("component is not null").groupBy("component").agg(first).select("of.doc_id", "of.check", "of.rows")
    text, kept_id, kept_text, repeated = (free_name(docs, n) for n in ("hash_of_text", "kept_id", "kept_text", "repeated"))
    kept = named.unionByName(found.where("component is null").select("doc_id", "check", "rows")).select(
        F.col("doc_id").alias(kept_id), F.col("check").alias(kept_text), (F.col("rows") > 1).alias(repeated)
    )
    keyed = docs.withColumn(text, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[kept_id]) & (keyed[text] == kept[kept_text]))
    # Only repeated rows are grouped; within a task they shrink before they meet.
    once = rows.where(~F.col(repeated)).select(docs.columns)
    return once.unionByName(rows.where(repeated).dropDuplicates(["doc_id", text]).select(docs.columns))
