"""Pairs of texts within an edit distance, for texts of any length and tables of any size.

A text is cut into more segments than there can be edits, so a text that near has one of them unchanged, at nearly the
same place (the segment index of Li, Deng, Wang and Feng, 2011, with their bounds on the shift). One side files its
segments by length, number and content, the other asks for the few substrings that can be one, and pairs meet in an
equi-join.

A segment that many texts share (a common beginning) would bring all of them together. The segment through which a pair
meets is the first that is unchanged with as many edits before it as its number. So what stands behind it has only the
edits that are left: in a group of many texts it is cut into segments in turn, of which one is unchanged, and so on. When
no edit is left, all behind has to be equal, and the parts passed over are looked at. Parts only become shorter and edits
fewer, so a text has few such paths, and every group ends small or with texts that differ in a few characters.

Where swapping neighbours is one edit, a character is left out between segments: an edit then reaches no more segments than
it counts, and as many segments do as without swaps.

Nearly all segments belong to one text. So the keys of a text are made twice: first they are only counted, then those that
can bring two texts together are joined. No text is moved but to find equal ones and to be compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.segments import Pieces, segments
from pulseframe.functions.text import damerau
from pulseframe.session import ensure_checkpoint_dir, scratch_path

#: A group with more texts than this on both sides is cut again.
LARGE = 256
#: So many keys at most are broadcast to pick the rows that have one of them. Of more, a few bits each are, up to so many in all.
BROADCAST_KEYS, MOST_BITS = 100_000, 1 << 31
#: Up to this length, a text may stand for itself in the pairs of texts that are one edit apart.
SHORT = 64
#: Up to this length, a part with one edit left is looked up by all that it leaves when a character goes.
LEAF = 12


#: A text on its way: the group that it is in, the part that is cut next with the edits it may have, what was passed over with
#: the edits in there, and by how much the part's length may differ.
ROW = ["id", "group", "body", "edits", "passed", "passed_edits", "reach"]


def _layout(length: Column, parts: Column, part: Column, gap: int = 0) -> tuple[Column, Column]:
    """(start, size) of a segment: all have one size but for the last ones, which may have one character more. ``gap`` characters
    are left out between two segments."""
    inside = length - gap * (parts - 1)
    base, longer = F.floor(inside / parts).cast("int"), inside % parts
    return part * (base + gap) + F.greatest(F.lit(0), part - (parts - longer)), base + (part >= parts - longer).cast("int")


def _fewest(edits: Column | int, gap: int) -> Column | int:
    """Characters of the shortest text whose segments have one each."""
    return edits + 1 + gap * edits


def _cut(length: Column, part: Column, start: Column, size: Column) -> Column:
    """The key of a segment of ``body``, and what is to be cut next: all behind it, or else what was passed over."""
    body, left = F.col("body"), F.col("edits") - part
    segment, behind = F.substring(body, start + 1, size), F.substring(body, start + size + 1, F.length(body))
    passed, edits = F.concat("passed", F.substring(body, F.lit(1), start)), F.col("passed_edits") + part
    done = left == 0
    return F.struct(
        F.xxhash64("group", length, F.col("edits"), part, segment, F.when(done, behind)).alias("key"),
        F.when(done, passed).otherwise(behind).alias("body"), F.when(done, edits).otherwise(left).alias("edits"),
        F.when(done, F.lit("")).otherwise(passed).alias("passed"), F.when(done, F.lit(0)).otherwise(edits).alias("passed_edits"),
    )


def _numbers(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _filed(rows: DataFrame, gap: int = 0) -> DataFrame:
    """(id, key, ...) of the segments of each text that has enough characters."""
    length, parts = F.length("body"), F.col("edits") + 1
    one = lambda part: _cut(length, part, *_layout(length, parts, part, gap))
    return rows.where(length >= _fewest(F.col("edits"), gap)).select("id", F.inline(F.transform(_numbers(F.lit(0), F.col("edits")), one)))


def _asked(rows: DataFrame, shorter: bool = False, gap: int = 0) -> DataFrame:
    """(id, key, ...) of all substrings that can be a segment of a text within reach.

    If the first ``part`` segments took that many edits, then this one is shifted by no more than that, and seen from the end by
    no more than the edits that are left. Both shifts together take no more than ``reach`` insertions and deletions. With
    ``shorter`` only texts are asked for that are no longer than this one.
    """
    n, parts = F.length("body"), F.col("edits") + 1

    def of_length(length: Column) -> Column:
        def of_part(part: Column) -> Column:
            start, size = _layout(length, parts, part, gap)
            shift, left = n - length, F.col("edits") - part
            nearest, furthest = F.ceil((shift - F.col("reach")) / 2).cast("int"), F.floor((shift + F.col("reach")) / 2).cast("int")
            first = F.greatest(F.lit(0), start - part, start + shift - left, start + nearest)
            last = F.least(n - size, start + part, start + shift + left, start + furthest)
            return F.transform(_numbers(first, last), lambda at: _cut(length, part, at, size))

        return F.flatten(F.transform(_numbers(F.lit(0), F.col("edits")), of_part))

    lengths = _numbers(F.greatest(_fewest(F.col("edits"), gap), n - F.col("reach")), n if shorter else n + F.col("reach"))
    return rows.select("id", F.inline(F.flatten(F.transform(lengths, of_length))))


def _shortened(texts: Column) -> Column:
    """Every text of an array with each single character left out."""

    def one(t: Column) -> Column:
        at = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    return F.flatten(F.transform(texts, one))


def _variants(text: Column, edits: Column, most: int) -> Column:
    """The text with up to ``edits`` characters left out, which is at most ``most``."""
    found = step = F.array(text)
    for k in range(1, most + 1):
        step = F.when(edits >= k, F.array_distinct(_shortened(step))).otherwise(F.array().cast("array<string>"))
        found = F.concat(found, step)
    return F.array_distinct(found)


def _short(rows: DataFrame, extra: Column, most: int, gap: int = 0) -> DataFrame:
    """(id, key, ...) of parts with too few characters for segments: two of them reach a common one by leaving characters out."""
    edits = F.col("edits")
    few = rows.where(F.length("body") < _fewest(edits, gap) + extra)
    return few.select("id", F.explode(_variants(F.col("body"), edits, most)).alias("variant"), "group", "edits", "passed", "passed_edits").select(
        "id", F.xxhash64("group", F.lit("few"), "edits", "variant").alias("key"), F.col("passed").alias("body"),
        (F.col("passed_edits") + edits).alias("edits"), F.lit("").alias("passed"), F.lit(0).alias("passed_edits"),
    )


#: Roles of a row: it asks, or it is filed, or both.
ASKS, FILES = 1, 2


def _cut_texts(texts: DataFrame, edits: int, reach: int, gap: int, role: int, shorter: bool, only: np.ndarray | None = None) -> DataFrame:
    """The segments of whole texts (id, body) as numbers, with all of ``_asked`` and ``_filed``: (id, key, role). With the sorted
    keys ``only``, the rows with one of these, and what is to be cut next as well: (id, group, body, edits, passed, passed_edits, role)."""
    fat = "group bigint, body string, edits int, passed string, passed_edits int" if only is not None else "key bigint"
    wanted = None if only is None else texts.sparkSession.sparkContext.broadcast(only)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, pieces in Pieces.of(batch.column(1)):
                ids = batch.column(0).slice(at, len(pieces.lengths))
                for row, key, part, start, size, roles in segments(pieces, edits, reach, gap, role & ASKS > 0, role & FILES > 0, shorter):
                    if wanted is None:
                        yield pa.record_batch([ids.take(pa.array(row)), pa.array(key), pa.array(roles)], ["id", "key", "role"])
                        continue
                    near = np.searchsorted(wanted.value, key)
                    row, key, start, roles, size = (x[wanted.value[np.minimum(near, len(wanted.value) - 1)] == key] for x in (row, key, start, roles, size))
                    if not len(row):
                        continue
                    before, behind = pieces.around(row, start, size)
                    whole = part == edits
                    yield pa.record_batch([
                        ids.take(pa.array(row)), pa.array(key), pa.array(before if whole else behind, pa.string()), pa.array(np.full(len(row), edits if whole else edits - part, np.int32)),
                        pa.array([""] * len(row) if whole else before, pa.string()), pa.array(np.full(len(row), 0 if whole else part, np.int32)), pa.array(roles),
                    ], ["id", "group", "body", "edits", "passed", "passed_edits", "role"])

    return texts.select("id", "body").mapInArrow(rows, f"id {texts.schema['id'].dataType.simpleString()}, {fat}, role int")


def _stored(df: DataFrame) -> DataFrame:
    """The same rows from Parquet, packed more closely than in a checkpoint."""
    path = scratch_path(df.sparkSession, "fuzzy")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _met(keyed: DataFrame, among: bool) -> DataFrame:
    """(key, large) of the keys that bring two texts together, from (id, key, role, open). A key behind which nothing is left to
    cut is not large. ``among`` says that an id is that of one text on both sides, which does not meet itself."""
    asks, files = F.col("role").bitwiseAND(ASKS) > 0, F.col("role").bitwiseAND(FILES) > 0
    ids = [F.min("id").alias("lo"), F.max("id").alias("hi")] if among else []
    groups = keyed.groupBy("key").agg(F.bit_or("role").alias("roles"), F.count_if(asks & F.col("open")).alias("n"), F.count_if(files & F.col("open")).alias("m"), *ids)
    groups = groups.where(F.col("roles") == ASKS | FILES)
    return (groups.where("lo <> hi") if among else groups).select("key", (F.least("n", "m") > LARGE).alias("large")).checkpoint()


def _marked(rows: DataFrame, number: Column, numbers: DataFrame) -> DataFrame:
    """The rows with one of the numbers (value), picked where they are by a bit for each number."""
    bits = numbers.select(F.bitmap_bucket_number("value").alias("bucket"), F.bitmap_bit_position("value").alias("bit"))
    bits = F.broadcast(bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.getbit(byte, (at % 8).cast("int")) == 1
    return rows.withColumn("bucket", F.bitmap_bucket_number(number)).join(bits, "bucket").where(has).drop("bucket", "bits")


def _having(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with one of the keys. If the keys are many, most other rows are left out by some bits of theirs, and the rest is moved."""
    n = keys.count()
    if n <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), "key", "left_semi")
    number = F.col("key").bitwiseAND(F.lit(min(MOST_BITS, 1 << (16 * n).bit_length()) - 1)) + 1
    return _marked(rows, number, keys.select(number.alias("value"))).join(keys, "key", "left_semi")


def near_pairs(left: DataFrame, right: DataFrame, edits: int, distance: int, among: bool = False, gap: int = 0) -> DataFrame:
    """Candidate pairs (a, b) of ids among texts (id, body), with all that are within ``edits`` single edits of which at most
    ``distance`` insert or delete; a pair may come several times. ``among`` says that both tables are one: only the longer text
    of a pair then asks for the other. With a ``gap`` of 1, swapping neighbours is a single edit as well."""
    start = [F.lit(0).cast("bigint"), F.col("body"), F.lit(edits), F.lit(""), F.lit(0), F.lit(distance)]
    a, b = (t.select("id", *[c.alias(n) for n, c in zip(ROW[1:], start)]) for t in (left, right))

    def whole(only: np.ndarray | None = None) -> DataFrame:
        cut = lambda t, role: _cut_texts(t, edits, distance, gap, role, among, only)
        return cut(left, ASKS | FILES) if among else cut(left, ASKS).unionByName(cut(right, FILES))

    found, texts = None, True
    while True:
        parts = [(_short(a, F.col("reach"), edits, gap), ASKS), (_short(b, F.lit(0), edits, gap), FILES)]
        if not texts:
            parts += [(_asked(a, False, gap), ASKS), (_filed(b, gap), FILES)]
        keyed = [t.select("id", "key", F.lit(role).alias("role"), (F.col("body") != "").alias("open")) for t, role in parts]
        if texts:
            keyed.append(whole().withColumn("open", F.lit(True)))
        every = keyed[0]
        for more in keyed[1:]:
            every = every.unionByName(more)
        met = _met(every, among)
        meeting = _stored(_having(every.select("id", "key", "role"), met.where("not large").select("key")))
        sides = [meeting.where(F.col("role").bitwiseAND(role) > 0).select(F.col("id").alias(n), "key") for role, n in ((ASKS, "a"), (FILES, "b"))]
        pairs = sides[0].join(sides[1], "key").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        large = met.where("large").select("key")
        if large.isEmpty():
            return found
        # What stands behind a segment may be longer in either text, so from now on both ask for all lengths.
        again = [F.col("id"), F.col("key").alias("group"), *ROW[2:6], F.lit(0).alias("role")]
        rows = [_having(t, large).select(*again[:-1], F.lit(role).alias("role")) for t, role in parts]
        if texts:
            rows.append(whole(np.sort(np.array([r[0] for r in large.collect()], np.int64))))
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        every = every.withColumn("reach", F.col("edits")).distinct().checkpoint()
        a, b = (every.where(F.col("role").bitwiseAND(role) > 0).drop("role") for role in (ASKS, FILES))
        texts = False


def _halves(rows: DataFrame, lengths: Callable[[Column, Column], list[tuple[Column, Column]]]) -> DataFrame:
    """(key, text, own, body, ended) of the halves of each body as they are in a text of its own length, or of one character less."""
    body, n = F.col("body"), F.length("body")

    def cut(length: Column, own: Column) -> list[Column]:
        first = F.floor(length / 2).cast("int")
        rest = length - first
        at = n - rest
        key = lambda part, half: F.xxhash64("group", length, F.lit(part), half).alias("key")
        return [
            F.struct(key(0, F.substring(body, F.lit(1), first)), own.alias("own"), F.substring(body, first + 1, n).alias("body"), F.col("ended")),
            F.struct(key(1, F.substring(body, at + 1, rest)), own.alias("own"), F.substring(body, F.lit(1), at).alias("body"), F.lit(True).alias("ended")),
        ]

    return rows.select("text", F.inline(F.array(*[c for length, own in lengths(n, F.col("own")) for c in cut(length, own)]))).where("body is not null")


def _left_out(rows: DataFrame) -> DataFrame:
    """(key, text, own) of short bodies: with a character left out at a place, for those of one length, or just left out, for the body that it leaves."""
    body, n, own = F.col("body"), F.length("body"), F.col("own")
    without = lambda i: F.concat(F.substring(body, F.lit(1), i - 1), F.substring(body, i + 1, n))
    places = _numbers(F.lit(1), n)
    # Of equal characters in a row only the first is left out, and none that could be the one between both halves: that pair is found in the first half's group.
    first = lambda i: ((i == 1) | (F.substring(body, i - 1, F.lit(1)) != F.substring(body, i, F.lit(1)))) & ~(F.col("ended") & F.startswith(body, without(i)))
    of_own = F.concat(F.transform(places, lambda i: F.xxhash64("group", i, without(i))), F.array(F.xxhash64("group", F.lit(0), body)))
    of_longer = F.transform(F.filter(places, first), lambda i: F.xxhash64("group", F.lit(0), without(i)))
    return rows.select("text", "own", F.explode(F.when(own, of_own).otherwise(of_longer)).alias("key"))


def _edit_apart(rows: DataFrame, kept: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(left_text, right_text) among rows (key, text, own, ...) with one key, of which one is an own one, that are one edit apart."""
    # Both sides are one shuffle: a condition on one of them alone would be moved below it, and make it two.
    rows = rows.withColumn("own", F.when(F.col("own"), 1).otherwise(2)).repartition("key")
    x, y = (rows.select("key", *[F.col(c).alias(f"{n}_{c}") for c in rows.columns if c != "key"]) for n in "xy")
    roles = F.col("x_own") * 2 + F.col("y_own")
    apart = ((roles == 5) | ((roles == 3) & (F.col("x_text") < F.col("y_text")))) & (F.levenshtein("x_text", "y_text", 1) == 1)
    if kept is not None:
        apart &= kept(F.col("x_body"), F.col("y_body"))
    return x.join(y, "key").where(apart).select(F.least("x_text", "y_text").alias("left_text"), F.greatest("x_text", "y_text").alias("right_text"))


def one_edit_pairs(texts: DataFrame) -> DataFrame:
    """All pairs (left_text, right_text) of different texts (body) that are one single edit apart, each once.

    One half of the shorter text is unchanged at the beginning or end of the other, and the other halves are one edit apart; a large group
    is cut again, by what is left. A text asks with its halves as those of a text with one character less, and is filed under its ``own`` ones.
    Texts of one length share one half only. Otherwise both may be shared, if the character left out can be the one between them: such a pair
    counts in the group of the first half, so in an ``ended`` body that is the rest of the other one with characters behind it, it does not.
    """
    rows = texts.select(F.lit(0).cast("bigint").alias("group"), F.col("body").alias("text"), F.lit(True).alias("own"), "body", F.lit(False).alias("ended"))
    lengths = lambda n, own: [(n, F.lit(True)), (F.when(n > 0, n - 1), F.lit(False))]
    once = lambda x, y: ~(F.col("x_ended") & (F.length(x) != F.length(y)) & F.startswith(x, y))
    found = None
    while True:
        halves = _halves(rows, lengths)
        groups = halves.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("m")).where("n > 1 and m > 0")
        met = groups.select("key", (F.col("n") * F.col("m") > LARGE * LARGE).alias("large")).checkpoint()
        pairs = _edit_apart(_having(halves, met.where("not large").select("key")), once)
        found = pairs if found is None else found.unionByName(pairs)
        large = met.where("large").select("key")
        if large.isEmpty():
            return found
        again = _stored(_having(halves, large).withColumnRenamed("key", "group"))
        length = F.length("body") - F.when(F.col("own"), 0).otherwise(1)
        found = found.unionByName(_edit_apart(_left_out(again.where(length <= LEAF))))
        rows = again.where(length > LEAF)
        lengths = lambda n, own: [(n - F.when(own, 0).otherwise(1), own)]


def _only_in(texts: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """The texts whose id a column of ``pairs`` has."""
    return _marked(texts, F.col("id"), pairs.select(F.col(column).alias("value")))


def fuzzy_join(left: DataFrame, right: DataFrame | None, left_text: str, right_text: str | None, distance: int = 1, metric: str = "levenshtein") -> DataFrame:
    """Pairs of distinct texts within an edit distance: (left_text, right_text, distance).

    ``metric`` "levenshtein" counts single edits; "damerau" also counts a swap of neighbours as one, and pairs are then
    complete in that metric. No pair is missed, and texts only meet if they share a segment that few others have. Without
    ``right`` the table is joined with itself and each pair comes once. Null texts have no pairs.
    """
    ensure_checkpoint_dir(left.sparkSession)

    def named(df: DataFrame, text: str, sign: int) -> DataFrame:
        texts = df.select(F.col(text).alias("body")).where(F.col("body").isNotNull()).distinct()
        return _stored(texts.select(((F.monotonically_increasing_id() + 1) * sign).alias("id"), "body"))

    a = named(left, left_text, 1)
    b = a if right is None else named(right, right_text or left_text, -1)
    one = right is None and distance == 1 and metric == "levenshtein"
    among = a.where(F.length("body") >= SHORT) if one else a
    found = near_pairs(among, among if right is None else b, distance, distance, right is None, int(metric == "damerau"))
    if right is None:
        found = found.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = found.distinct().checkpoint()
    texts = [_only_in(t, found, n).select(F.col("id").alias(n), F.col("body").alias(f"{n}_text")) for t, n in ((a, "a"), (b, "b"))]
    pairs = found.join(texts[0], "a").join(texts[1], "b")
    if one:
        pairs = pairs.where(F.greatest(F.length("a_text"), F.length("b_text")) > SHORT)
    if right is None:
        pairs = pairs.select(F.least("a_text", "b_text").alias("left_text"), F.greatest("a_text", "b_text").alias("right_text"))
    else:
        pairs = pairs.select(F.col("a_text").alias("left_text"), F.col("b_text").alias("right_text"))
    if metric == "damerau":  # a swap is at most two single edits, which few of the candidates are within
        pairs = pairs.where(F.levenshtein("left_text", "right_text", 2 * distance) >= 0)
    measure = damerau(F.col("left_text"), F.col("right_text"), distance) if metric == "damerau" else F.levenshtein("left_text", "right_text", distance)
    pairs = pairs.withColumn("distance", measure).where(F.col("distance").between(0, distance))
    if not one:
        return pairs
    return pairs.unionByName(one_edit_pairs(a.where(F.length("body") <= SHORT)).withColumn("distance", F.lit(1)))
