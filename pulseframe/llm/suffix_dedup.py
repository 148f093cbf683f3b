"""Exact removal of repeated byte strings, by bucket-pointer refinement over content-defined suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere. Strings are sorted into buckets as a
bucket-pointer suffix sort does: initial buckets by q-gram, then each bucket is refined by sorting on the identifiers of
buckets at later offsets, and the refined identifiers are what the next refinement starts from. Three things fit it to a
cluster:

* Identifiers are 64-bit hashes of the bucket's common bytes instead of ranks, so any task can name a bucket. Two with
  independent tables make up the name of a whole string (128 bits); no decision rests on a single one.
* Not all suffixes are sorted. Each string belongs to one of its q-grams: that of the least hash, the leftmost among
  equals. Equal strings choose the same q-gram at the same offset, so they meet in its bucket, and neighbouring strings
  mostly share theirs. A bucket entry is such a run of strings (some 80 bytes of text to an entry).
* A refinement settles an entry as soon as another has the same extent (all its strings repeat) or no other is left in its
  bucket (none does). Only the rest goes on, with a witness of the settled ones in the bucket: from q-grams to cells of ``CELL`` strings with 185 common bytes, then to
  single strings. Only the rest needs its bytes again, so text moves once for it, and once to cut the spans.

No bucket is held anywhere: entries stream in sorted order and look at their neighbours. Buckets with a large share of all
entries are dealt out by extent as well; their entries skip the test for being alone and go on to finer buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import spans
from pulseframe.session import scratch_path

LENGTH = 200
GRAM = 32
CELL = 16
#: A bucket is dealt out when it has this share of all entries, and at least so many.
HOT_SHARE = 1e-4
HOT_ENTRIES = 1_000
SKETCH = 1 << 20

# An entry's place in one number: first string, strings behind it, offset of the q-gram from the first string, three marks.
# Marks: dealt out by extent; known to repeat, as its own chunk has its extent twice; settled, as it does and another entry
# of the chunk stands for it in the bucket.
START, EXTRA, OFFSET, SETTLED, KNOWN, HOT = 19, 11, 3, 2, 1, 0
# A document is named by hashes of its doc_id and text (``doc``) and of its text (``twin``): doc_ids may be null or repeat.
NAME = ["doc", "twin"]
ENTRY = "core long, whole long, doc long, twin long, place long, home long"
COLUMNS = ["core", "whole", *NAME, "place", "home"]


def pack(start: np.ndarray, extra: np.ndarray, offset: np.ndarray, hot: np.ndarray | int = 0) -> np.ndarray:
    wide = [np.asarray(x, np.int64) for x in (start, extra, offset, hot)]
    return (wide[0] << START) | (wide[1] << EXTRA) | (wide[2] << OFFSET) | (wide[3] << HOT)


def marked_copies(core: np.ndarray, whole: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places with the marks of entries whose extent comes twice in the chunk; the first of them stands for the others.

    So a passage with very many copies sends one entry of each chunk to its bucket.
    """
    if not len(core):
        return place
    order = np.lexsort((whole, core))
    same = (core[order][1:] == core[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    later, first = np.zeros(len(core), bool), np.zeros(len(core), bool)
    later[order[1:][same]] = True
    first[order[:-1][same]] = True
    return place | np.where(later, (1 << SETTLED) | (1 << KNOWN), np.where(first, 1 << KNOWN, 0))


def first_of(place: np.ndarray) -> np.ndarray:
    return place >> START


def extra_of(place: np.ndarray) -> np.ndarray:
    return (place >> EXTRA) & 0xFF


def offset_of(place: np.ndarray) -> np.ndarray:
    return (place >> OFFSET) & 0xFF


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, in log2(width) passes."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def entries(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first string, last string, q-gram) of the runs of strings that share their q-gram; positions in the chunk."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    at = np.arange(n - GRAM + 1)
    prefix = spans.prefix_hash(data)
    rank = spans.range_hash(prefix, at, at + GRAM) >> np.uint64(32) << np.uint64(32)
    chosen = (least_in_windows(rank | at.astype(np.uint64), LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = bounds[1:]
    string = np.arange(n - LENGTH + 1)
    row = np.searchsorted(bounds, string, "right") - 1
    inside = string + LENGTH <= ends[row]
    string, row, chosen = string[inside], row[inside], chosen[inside]
    if not len(string):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    cut = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(row) != 0)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut - 1, [len(string) - 1]])
    return row[first], string[first], string[last], chosen[first]


def _sketch_cell(core: np.ndarray) -> np.ndarray:
    return (core >> np.uint64(44)).astype(np.int64)


def _whole(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Identifier of an entry's whole extent; ``salt`` tells where the bucket's common bytes lie in it."""
    return spans.mix(spans.range_hash(prefix, start, end, 1) + (salt.astype(np.uint64) << np.uint64(20)))


def _numbers(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


def crowded_buckets(texts: DataFrame) -> np.ndarray:
    """Sketch cells of q-gram buckets with a large share of all entries: at most 1 / ``HOT_SHARE`` of them.

    A task reports the cells with half that share of its own entries; a cell above the share overall is above it in some
    task. All documents are counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SKETCH, np.int64)
        for chunk in spans.chunks(batches):
            data, bounds = spans.text_bytes(chunk.column(0))
            _, _, _, gram = entries(data, bounds)
            core = spans.range_hash(spans.prefix_hash(data), gram, gram + GRAM)
            np.add.at(n, _sketch_cell(core), 1)
        total = int(n.sum())
        cells = np.flatnonzero(n >= max(1, total * HOT_SHARE / 2)) if total else np.empty(0, np.int64)
        cells = cells[n[cells] > 1]
        yield _numbers(np.append(cells, -1), np.append(n[cells], total), names=["cell", "n"])

    counts = _stored(texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "crowded")
    total = counts.where("cell = -1").first()
    least = max(HOT_ENTRIES, HOT_SHARE * (total["n"] if total else 0))
    return np.array(sorted(r["cell"] for r in counts.where((F.col("cell") >= 0) & (F.col("n") >= least)).collect()), np.int64)


def first_buckets(texts: DataFrame, crowded: np.ndarray) -> DataFrame:
    """Entries of the initial q-gram buckets of every whole text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_cells = np.zeros(SKETCH, bool)
        hot_cells[crowded] = True
        for chunk in spans.chunks(batches):
            data, bounds = spans.text_bytes(chunk.column(0))
            row, first, last, gram = entries(data, bounds)
            core = spans.range_hash(spans.prefix_hash(data), gram, gram + GRAM)
            hot = hot_cells[_sketch_cell(core)]
            whole = _whole(spans.prefix_hash(data, 1), first, last + LENGTH, gram - first)
            doc, twin = (chunk.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            place = marked_copies(core, whole, pack(first - bounds[row], last - first, gram - first, hot))
            yield _numbers(core, whole, doc[row], twin[row], place, place, names=COLUMNS)

    return texts.select("text", *NAME).mapInArrow(make, ENTRY).drop("home")


def refine(entries_: DataFrame) -> DataFrame:
    """Entries that repeat (``repeats``), and entries to refine further (``open``); those of which nothing repeats are gone.

    Open are the entries that share their bucket with another extent, and of equal extents a witness or two. Sorted by bucket and extent, an entry only looks at the ones beside it, so no bucket is held in memory.
    """
    names = entries_.columns[2:]
    settled = F.col("place").bitwiseAND(F.lit(1 << SETTLED)) != 0
    dealt = F.when(F.col("place").bitwiseAND(F.lit(1 << HOT)) != 0, F.col("whole"))
    bucket = F.when(settled, F.xxhash64(*NAME, "place")).otherwise(F.xxhash64("core", dealt))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        same_core = same_whole = False  # of the kept row and the one before it

        def settle(rows: list[np.ndarray], core_next: np.ndarray, whole_next: np.ndarray) -> pa.RecordBatch:
            nonlocal same_core, same_whole
            n = len(core_next)
            core_before = np.concatenate([[same_core], core_next[: n - 1]])
            whole_before = np.concatenate([[same_whole], whole_next[: n - 1]])
            done = (rows[4][:n] >> SETTLED) & 1 > 0
            repeats = whole_before | whole_next | ((rows[4][:n] >> KNOWN) & 1 > 0)
            dealt_out = (rows[4][:n] >> HOT) & 1 > 0
            # Of equal extents, those beside another extent of the bucket go on for the sake of that one.
            beside = (core_before & ~whole_before) | (core_next & ~whole_next)
            open_ = ~done & (beside | (dealt_out & ~whole_before))
            out = np.flatnonzero(repeats | open_)
            same_core, same_whole = bool(core_next[-1]), bool(whole_next[-1])
            return pa.RecordBatch.from_arrays([*[pa.array(c[:n][out]) for c in rows[2:]], pa.array(repeats[out]), pa.array(open_[out])], names=[*names, "repeats", "open"])

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(kept, rows, strict=True)]
            if len(rows[0]) > 1:
                core = (rows[0][1:] == rows[0][:-1]) & ((rows[4][1:] | rows[4][:-1]) >> SETTLED & 1 == 0)
                yield settle(rows, core, core & (rows[1][1:] == rows[1][:-1]))
            kept = [c[-1:] for c in rows] if len(rows[0]) else None
        if kept is not None:
            yield settle(kept, np.zeros(1, bool), np.zeros(1, bool))

    fields = ", ".join(f"{n} long" for n in names)
    return (
        entries_.repartition(bucket).sortWithinPartitions(settled, "core", "whole")
        .mapInArrow(judge, f"{fields}, repeats boolean, open boolean")
    )


def _segments(open_: DataFrame, packed: DataFrame) -> DataFrame:
    """(doc, twin, place, bytes): the bytes of the strings of entries that are not settled."""
    wanted = open_.groupBy(*NAME).agg(F.collect_set("place").alias("places"))
    names = [*NAME, "place", "bytes"]

    def rows(*columns: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            docs, twins, places, pieces = [], [], [], []
            held = 0
            for doc, twin, body, wanted_here in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = unpack(body)
                for place in wanted_here:
                    first = place >> START
                    piece = text[first : first + ((place >> EXTRA) & 0xFF) + LENGTH]
                    docs.append(doc)
                    twins.append(twin)
                    places.append(place)
                    pieces.append(piece)
                    held += len(piece)
                if held > 4 * spans.CHUNK_BYTES:
                    yield rows(docs, twins, places, pieces)
                    docs, twins, places, pieces, held = [], [], [], [], 0
            yield rows(docs, twins, places, pieces)

    return packed.select(*NAME, "packed").join(wanted, NAME).select(*NAME, "packed", "places").mapInArrow(
        cut, "doc long, twin long, place long, bytes binary"
    )


def _pieces(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column(column).to_pylist()
    bounds = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=bounds[1:])
    return np.frombuffer(b"".join(values), np.uint8), bounds


def _cells(segments: DataFrame) -> DataFrame:
    """Entries of the buckets of ``CELL`` strings, for q-gram entries that are not settled."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                data, bounds = _pieces(part, 3)
                doc, twin, place = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
                back_most, extra = offset_of(place), extra_of(place)
                back_least = back_most - extra
                low, high = back_least // CELL, back_most // CELL
                row = np.repeat(np.arange(len(doc)), high - low + 1)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
                # Strings of a cell start between ``most`` and ``least`` bytes before the q-gram.
                least = np.maximum(back_least[row], cell * CELL)
                most = np.minimum(back_most[row], cell * CELL + CELL - 1)
                gram = bounds[row] + back_most[row]
                prefixes = (spans.prefix_hash(data), spans.prefix_hash(data, 1))
                common = gram - cell * CELL
                core = spans.mix(spans.range_hash(prefixes[0], common, common - CELL + 1 + LENGTH) + cell.astype(np.uint64))
                whole = _whole(prefixes[1], gram - most, gram - least + LENGTH, cell * CELL + least)
                start = first_of(place)[row] + back_most[row] - most
                own = marked_copies(core, whole, pack(start, most - least, np.zeros_like(start)))
                yield _numbers(core, whole, doc[row], twin[row], own, place[row], names=COLUMNS)

    return segments.mapInArrow(make, ENTRY)


def _strings(open_: DataFrame, segments: DataFrame) -> DataFrame:
    """Entries of single strings, for cells that are not settled."""
    cells = open_.groupBy(*NAME, F.col("home").alias("place")).agg(F.collect_set("place").alias("cells"))
    joined = segments.join(cells, [*NAME, "place"]).select(*NAME, "place", "bytes", "cells")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                data, bounds = _pieces(part, 3)
                doc, twin, home = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
                lists = part.column(4)
                count = np.array([len(x) for x in lists.to_pylist()], np.int64)
                place = lists.flatten().to_numpy(zero_copy_only=False)
                segment = np.repeat(np.arange(len(doc)), count)
                n = extra_of(place) + 1
                row = np.repeat(np.arange(len(place)), n)
                start = first_of(place)[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = bounds[segment[row]] + start - first_of(home)[segment[row]]
                core = spans.range_hash(spans.prefix_hash(data), at, at + LENGTH)
                whole = spans.range_hash(spans.prefix_hash(data, 1), at, at + LENGTH, 1)
                zero = np.zeros_like(start)
                own = marked_copies(core, whole, pack(start, zero, zero))
                of = segment[row]
                yield _numbers(core, whole, doc[of], twin[of], own, home[of], names=COLUMNS)

    return joined.mapInArrow(make, ENTRY).drop("home")


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated_strings(texts: DataFrame, packed: DataFrame) -> DataFrame:
    """(doc, twin, place): runs of strings that also start elsewhere. Every string of every text is in one run at most."""
    buckets = _stored(refine(first_buckets(texts, crowded_buckets(texts))), "buckets")
    segments = _stored(_segments(buckets.where("open"), packed), "segments")
    cells = _stored(refine(_cells(segments)), "cells")
    strings = refine(_strings(cells.where("open"), segments))
    return (
        buckets.where("repeats").select(*NAME, "place")
        .unionByName(cells.where("repeats").select(*NAME, "place"))
        .unionByName(strings.where("repeats").select(*NAME, "place"))
    )


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the ranges; ranges that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut - 1, [len(starts) - 1]])
    return list(zip(starts[first].tolist(), ends[last].tolist(), strict=True))


def remove_repeats(docs: DataFrame, texts_out: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts_out`` also spans and kept.

    Every byte of a text (null: empty) covered by a string of 200 bytes that also starts elsewhere, in another document or
    in the same one, is removed; of copies, none stays. Documents shorter than 200 bytes keep all. Repeated rows are
    documents of their own: equal ones share a name, and so one result. Rows of one doc_id (or of none) with different
    texts do not. ``kept`` is binary, since a cut may split a character. A document must be below 2^44 bytes.
    Columns besides doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("doc"),
        F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("bigint").alias("twin"),
        "text",
    )

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for chunk in spans.chunks(batches):
            data, bounds = spans.text_bytes(chunk.column(3))
            whole = data.tobytes()
            bodies = [compress(whole[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*chunk.columns[:3], pa.array(bodies, pa.binary())], names=["doc_id", *NAME, "packed"])

    packed = rows.mapInArrow(squeeze, f"doc_id {kind}, doc long, twin long, packed binary")
    found = repeated_strings(rows, packed)
    per_doc = found.groupBy(*NAME).agg(F.collect_set("place").alias("places"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                out: list[tuple] = []
                for body, places in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text = unpack(body)
                    place = np.array(places or [], np.int64)
                    first = first_of(place)
                    runs = merged(first, first + extra_of(place) + LENGTH) if len(place) else []
                    kept, done = [], 0
                    for a, b in runs:
                        kept.append(text[done:a])
                        done = b
                    left = b"".join([*kept, text[done:]])
                    out.append((len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), runs, left))
                columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if texts_out:
                    columns.append(pa.array([[x for run in o[4] for x in run] for o in out], pa.list_(pa.int64())))
                    columns.append(pa.array([o[5] for o in out], pa.binary()))
                    names += ["spans", "kept"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<long>, kept binary" * texts_out
    return packed.join(per_doc, NAME, "left").select("doc_id", "packed", "places").mapInArrow(finish, schema)
