"""Edit distances of many texts at once, and the fuzzy join on them, against the plain table."""

import random

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from pulseframe.functions.edits import Texts, distances, swap_distances
from pulseframe.operators import fuzzy


def edits(a, b, swaps=False):
    """The table of distances, a cell at a time."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    rows = {}
    for i, ca in enumerate(a, 1):
        column = 0
        for j, cb in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (ca != cb))
            r, c = rows.get(cb, 0), column
            if swaps and r and c:
                d[i, j] = min(d[i, j], d[r - 1, c - 1] + (i - r - 1) + 1 + (j - c - 1))
            if ca == cb:
                column = j
        rows[ca] = i
    return d[len(a), len(b)]


def some(dice, longest, n, letters="abcé日🙂"):
    return ["".join(dice.choices(letters, k=dice.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("length", [0, 1, 9, 63, 64, 65, 129])
def test_one_against_many(length):
    dice = random.Random(length)
    many = some(dice, length + 5, 25)
    one = "".join(dice.choices("abcé日🙂", k=length))
    assert distances(one, Texts(many)).tolist() == [edits(one, t) for t in many]
    assert distances(one, Texts([])).tolist() == []


@pytest.mark.parametrize("a,b,n", [("ab", "ba", 1), ("kitten", "sitting", 3), ("", "abc", 3), ("ca", "abc", 2), ("", "", 0), ("abxxcd", "baxxdc", 2)])
def test_swaps(a, b, n):
    assert swap_distances([a], [b]).tolist() == [n]


@pytest.mark.parametrize("limit", [None, 0, 1, 2, 4])
def test_swaps_by_the_table(limit):
    dice = random.Random(7)
    a = some(dice, 11, 300)
    b = [t[1:2] + t[:1] + t[2:] if i % 3 else t[1:] + t[:1] for i, t in enumerate(a)][:200] + some(dice, 11, 100)
    want = [edits(x, y, True) for x, y in zip(a, b)]
    assert swap_distances(a, b, limit).tolist() == [n if limit is None else min(n, limit + 1) for n in want]


def pairs(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("metric,distance,large", [("levenshtein", 2, 3), ("damerau", 1, 3), ("damerau", 2, 64)])
def test_join_by_brute_force(spark, monkeypatch, metric, distance, large):
    """Short and long texts, with common beginnings and ends; also where nearly every segment is a common one."""
    monkeypatch.setattr(fuzzy, "LARGE", large)
    dice = random.Random(distance)
    texts = set(some(dice, 6, 40, "abc")) | {f"Customer#{k:06d}" for k in range(20)}
    long_ = "".join(dice.choices("abcdefgh ", k=120))
    for _ in range(20):
        t = list(long_)
        for _ in range(dice.randint(0, 3)):
            i = dice.randrange(len(t) - 1)
            if dice.random() < 0.4:
                t[i], t[i + 1] = t[i + 1], t[i]
            else:
                t[i : i + dice.randint(0, 1)] = dice.choice(["", "x", "yz"])
        texts.add("".join(t))
    texts = sorted(texts)
    df = spark.createDataFrame([(t,) for t in [*texts, None, texts[0]]], "t string")
    near = [(a, b, edits(a, b, metric == "damerau")) for a in texts for b in texts if abs(len(a) - len(b)) <= distance]
    near = [p for p in near if p[2] <= distance]
    assert pairs(fuzzy.fuzzy_join(df, None, "t", None, distance, metric)) == sorted(p for p in near if p[0] < p[1])
    if large == 3:
        return
    other = df.withColumnRenamed("t", "u").where("length(u) % 2 = 0")
    want = sorted(p for p in near if len(p[1]) % 2 == 0)
    assert pairs(fuzzy.fuzzy_join(df, other, "t", "u", distance, metric)) == want


def test_nothing_to_join(spark):
    df = spark.createDataFrame([], "t string")
    assert fuzzy.fuzzy_join(df, None, "t", None, 2).count() == 0


def test_a_common_beginning_brings_few_together(spark):
    """Thousands of names with one beginning: candidates stay near the number of pairs."""
    df = spark.range(3_000).selectExpr("unhex(md5(cast(id as string))) as id", "concat('Customer#', lpad(cast(id * 7919 % 1000000 as string), 9, '0')) as body")
    fuzzy.ensure_checkpoint_dir(spark)
    assert fuzzy.near_pairs(df, df, 1, 1).distinct().count() < 800_000


def test_only_the_longer_text_asks(spark):
    """Rows of the index per text: a self join asks for texts that are no longer, shifted by the insertions there can be."""
    row = ("x" * 40,)
    t = spark.createDataFrame([row], "body string").selectExpr("1L as id", "0L as group", "body", "4 as edits", "'' as passed", "0 as passed_edits", "2 as reach")
    assert fuzzy._asked(t, shorter=True).count() == 28 < fuzzy._asked(t).count()


def test_a_swap_is_one_edit_of_the_index(spark, monkeypatch):
    """Two swaps anywhere, also over the ends of segments, leave one of three segments as it is."""
    text = "abcdefghijklmnopq"
    swapped = lambda t, i: t[:i] + t[i + 1] + t[i] + t[i + 2 :]
    near = {swapped(swapped(text, i), j) for i in range(16) for j in range(16)} | {swapped(text[:i] + text[i + 1 :], j) for i in range(17) for j in range(15)}
    near = sorted(near - {text})
    asked, kept = [], fuzzy.near_pairs
    monkeypatch.setattr(fuzzy, "near_pairs", lambda left, right, edits, *more: asked.append(edits) or kept(left, right, edits, *more))
    one, many = (spark.createDataFrame([(t,) for t in texts], "t string") for texts in ([text], near))
    assert sorted(p[1] for p in pairs(fuzzy.fuzzy_join(one, many, "t", "t", 2, "damerau"))) == near
    assert sorted(p[0] for p in pairs(fuzzy.fuzzy_join(many, one, "t", "t", 2, "damerau"))) == near
    assert asked == [2, 2]


@pytest.mark.parametrize("edits_,reach,gap,shorter", [(2, 2, 1, True), (2, 2, 0, False), (4, 2, 0, True), (1, 1, 1, False), (0, 0, 1, True)])
def test_segments_as_numbers(spark, edits_, reach, gap, shorter):
    """The keys of whole texts bring those together that the expressions for parts do."""
    dice = random.Random(edits_)
    texts = sorted(set(some(dice, 9, 150) + some(dice, 40, 30, "ab")))
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, body string")
    rows = df.selectExpr("id", "0L as group", "body", f"{edits_} as edits", "'' as passed", "0 as passed_edits", f"{reach} as reach")

    def groups(found):
        by = {}
        for role, table in found:
            for r in table.select("id", "key").collect():
                by.setdefault(r["key"], []).append((role, r["id"]))
        return sorted(map(sorted, by.values()))

    want = groups([("asks", fuzzy._asked(rows, shorter, gap)), ("files", fuzzy._filed(rows, gap))])
    both = fuzzy._cut_texts(df, edits_, reach, gap, fuzzy.ASKS | fuzzy.FILES, shorter)
    assert groups([("asks", both.where("role in (1, 3)")), ("files", both.where("role in (2, 3)"))]) == want
    apart = [(name, fuzzy._cut_texts(df, edits_, reach, gap, role, shorter)) for name, role in (("asks", fuzzy.ASKS), ("files", fuzzy.FILES))]
    assert groups(apart) == want


def test_only_texts_of_pairs_are_moved(spark):
    texts = spark.range(-70_000, 70_000).selectExpr("id", "'t' as body")
    found = spark.createDataFrame([(-69_999, 5), (-32_768, 32_768), (-1, 32_769), (-1, 65_536)], "a bigint, b bigint")
    assert sorted(r[0] for r in fuzzy._only_in(texts, found, "a").collect()) == [-69_999, -32_768, -1]
    assert sorted(r[0] for r in fuzzy._only_in(texts, found, "b").collect()) == [5, 32_768, 32_769, 65_536]


def test_one_text_per_key_brings_nothing_together(spark):
    """Of texts that have no other near, no row but the count of its keys is kept."""
    rows = [(1, 5, 3, True), (1, 5, 1, True), (2, 6, 1, True), (3, 6, 1, True), (2, 7, 3, True), (3, 7, 1, True)]
    keyed = spark.createDataFrame(rows, "id bigint, key bigint, role int, open boolean")
    assert [tuple(r) for r in fuzzy._met(keyed, True).collect()] == [(7, False)]


@pytest.mark.parametrize("large,leaf", [(0, 12), (3, 2)])
def test_pairs_one_edit_apart_come_once(spark, monkeypatch, large, leaf):
    """Without a step that makes pairs distinct: a character left out between halves, or of several equal ones, counts in one group only."""
    monkeypatch.setattr(fuzzy, "LARGE", large)
    monkeypatch.setattr(fuzzy, "LEAF", leaf)
    dice = random.Random(large)
    texts = set(some(dice, 7, 120, "ab")) | set(some(dice, 9, 30, "aé🙂")) | {f"name {k:04d}" for k in range(0, 120, 3)} | {"a" * k for k in range(12)} | {""}
    texts |= {t[:i] + t[i + 1 :] for t in ["name 0001", "aaaabbbbaaaa"] for i in range(len(t))} | {"aaaabbbbaaaa"}
    texts = sorted(texts)
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    want = sorted((a, b) for a in texts for b in texts if a < b and abs(len(a) - len(b)) < 2 and edits(a, b) == 1)
    assert pairs(fuzzy.one_edit_pairs(df)) == want


def test_short_and_long_texts_one_edit_apart(spark, monkeypatch):
    """A text of the greatest length that is short meets short ones and long ones."""
    monkeypatch.setattr(fuzzy, "SHORT", 8)
    texts = sorted({"abcdefghij"[:k] for k in range(4, 11)} | {"abcdefgX", "abcdefgXi", "abcdefghX"})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = sorted((a, b, 1) for a in texts for b in texts if a < b and edits(a, b) == 1)
    assert pairs(fuzzy.fuzzy_join(df, None, "t", None, 1)) == want


def test_many_keys_leave_most_rows_in_place(spark, monkeypatch):
    """Where keys are too many to broadcast, bits of them keep nearly all other rows out of the join that follows."""
    monkeypatch.setattr(fuzzy, "BROADCAST_KEYS", 100)
    rows = spark.range(40_000).selectExpr("id", "xxhash64(id) as key")
    keys = rows.where("id % 100 = 7").select("key")
    assert sorted(r["id"] for r in fuzzy._having(rows, keys).collect()) == list(range(7, 40_000, 100))
    moved, join = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, other, on, how="inner": how == "left_semi" and moved.append(self.count()) or join(self, other, on, how))
    assert fuzzy._having(rows, keys).count() == 400 <= moved[0] < 6_000


def test_join_with_many_keys(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "BROADCAST_KEYS", 0)
    texts = sorted({"".join(random.Random(k % 40).choices("abcdefgh", k=30))[: 30 - k // 40] for k in range(120)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = sorted((a, b, edits(a, b)) for a in texts for b in texts if a < b and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2)
    assert len(want) == 120 and pairs(fuzzy.fuzzy_join(df, None, "t", None, 2)) == want
