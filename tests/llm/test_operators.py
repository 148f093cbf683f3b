"""Operators against plain versions, on a test table and on a fixture of awkward rows, and on no rows at all."""

from __future__ import annotations

import base64
import hashlib
import math
import time
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from awkward import EDGE

from pulseframe.llm import bpe, fingerprints, jaccard_join, licenses, mixing, ordinal, pii, quality_rules, sharding, suffix_dedup

PAIRS = [(i, t) for i, t, _, _ in EDGE]
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_repeats(spark, small, edge, empty):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    df, plain = small
    assert rows(suffix_dedup.remove_repeats(df), *names) == Counter(brute.repeats(plain))
    out = suffix_dedup.remove_repeats(edge, texts_out=True).cache()
    assert rows(out, *names) == Counter(brute.repeats(PAIRS))
    for r in out.where("doc_id in (9, 10)").collect():
        assert bytes(r["kept"]) == (b"start " if r["doc_id"] == 9 else b" end")
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_crowded_buckets_give_the_same(small, monkeypatch):
    df, plain = small
    monkeypatch.setattr(suffix_dedup, "HOT_ENTRIES", 2)
    assert rows(suffix_dedup.remove_repeats(df), "doc_id", "n_removed", "kept_sha256") == Counter((i, r, k) for i, _, r, _, k in brute.repeats(plain))


def test_repeats_without_ids(spark):
    """Different texts that share a doc_id, or have none, are documents of their own."""
    shared = "".join(f"shared {i} " for i in range(40))
    docs = []
    for i in range(1_000):
        own = "".join(f"{i}x{k * 7919 % 101} " for k in range(30))
        docs.append((None if i % 4 else 5, own[: i % 150] + shared + own if i % 3 == 0 else own))
    docs += docs[:20]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(suffix_dedup.remove_repeats(df), *names) == Counter(brute.repeats(docs))


def test_components(small, edge, empty):
    names = ("doc_id", "n_shingles", "component_id")
    df, plain = small
    assert rows(jaccard_join.jaccard_components(df), *names) == Counter(brute.components(plain))
    assert rows(jaccard_join.jaccard_components(edge), *names) == Counter(brute.components(PAIRS))
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = [r["doc_id"] for r in jaccard_join.one_of_each(edge).collect()]
    assert sorted(kept, key=str) == sorted({i for i, _, c in brute.components(PAIRS) if i == c}, key=str)


def test_components_of_a_chain(spark):
    """Neighbours link, the ends do not; the leader of a list links to few of it."""
    words = [f"w{i}" for i in range(400)]
    docs = [(100 - k, " ".join(words[8 * k : 8 * k + 150])) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard_join.jaccard_components(df), "doc_id", "n_shingles", "component_id") == Counter(brute.components(docs))


def prose(seed, n=60):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10_000, n))


def test_lists_of_two_sets_do_not_come_back(spark, monkeypatch):
    """Two sets that alone share lists are settled when their leader was looked at; the later rounds have none of their lists."""
    docs = [(2 * k + i, f"{prose(k)} {prose(1_000 + 2 * k + i)}") for k in range(60) for i in range(2)]
    seen = []
    for name in ("led_again", "cross_pairs"):
        real = getattr(jaccard_join, name)
        monkeypatch.setattr(jaccard_join, name, lambda lists, *rest, real=real: (seen.append(lists.count()), real(lists, *rest))[1])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(jaccard_join.jaccard_components(df), "doc_id", "n_shingles", "component_id") == Counter(brute.components(docs))
    assert seen == [0, 0]


def test_lists_that_a_third_set_leads(spark):
    """Two sets that link with no shared list to spare, and some of these lists are led by one of them, the others by a third set.

    The 40 common shingles stand in three sets each and so behind the 5 own ones: a prefix of 10 has the same 5 of them, and 5
    are needed.
    """
    docs = []
    for k in range(60):
        both = prose(10 * k, 44)
        docs += [(4 * k, f"{both} {prose(10 * k + 1, 5)}"), (4 * k + 1, f"{both} {prose(10 * k + 2, 5)}")]
        docs += [(4 * k + 2, " ".join(both.split()[:24])), (4 * k + 3, " ".join(both.split()[20:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute.components(docs)
    assert len({c for *_, c in want}) == 180
    assert rows(jaccard_join.jaccard_components(df), "doc_id", "n_shingles", "component_id") == Counter(want)


def test_only_wanted_texts_are_moved(spark, monkeypatch):
    """Of all texts, those of the wanted rows pass, and next to no others; an overfull filter lets more pass and loses none."""
    docs = [(k if k % 3 else None, prose(k)) for k in range(3_000)] + [(1, None), (1, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as check")
    wanted = df.where("check % 50 = 0 or text = ''").selectExpr("xxhash64(doc_id, check) as key", "check")
    want = {tuple(r) for r in wanted.collect()}
    assert len(want) > 20
    for most in (jaccard_join.FILTER_MOST, 1 << 6):
        monkeypatch.setattr(jaccard_join, "FILTER_MOST", most)
        monkeypatch.setattr(jaccard_join, "FILTER_BLOCK", min(most, jaccard_join.FILTER_BLOCK))
        moved = jaccard_join.packed_texts(df, jaccard_join.key_filter(wanted.select("key"))).collect()
        found = {(r["key"], r["check"]) for r in moved}
        assert want <= found
        assert (len(moved) <= len(want) + 10) == (most > 1 << 6)
    edges = [(2 * k + i, prose(k) + " tail" * i) for k in range(40) for i in range(2)]
    pairs = spark.createDataFrame(edges, "doc_id long, text string")
    assert rows(jaccard_join.jaccard_components(pairs), "doc_id", "n_shingles", "component_id") == Counter(brute.components(edges))


def test_one_row_of_each_component(spark):
    """Rows without a doc_id, or with a reused one, stay or go by themselves; of equal rows one stays."""
    near = lambda seed: prose(seed) + " tail"
    docs = [(None, prose(k)) for k in range(30)] + [(None, near(k)) for k in range(20)]  # 30 components of null ids only
    docs += [(3, near(0)), (7, prose(100)), (7, prose(101)), (7, near(100)), (7, prose(100)), (7, prose(100)), (8, near(101))]
    docs += [(None, ""), (None, " "), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(df).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(docs)
    groups = defaultdict(list)
    for i, t in set(kept):
        groups[t.removesuffix(" tail") or t].append(i)
    want = {prose(k): [3 if k == 0 else None] for k in range(30)} | {prose(100): [7], prose(101): [7], "": [None], " ": [None]}
    assert groups == want


def test_fingerprints(small, edge, empty):
    df, plain = small
    text = dict(plain)
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(df).collect()}
    ids = [i for i, _ in plain]
    by_text = defaultdict(set)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text[i]), sha(brute.edited(text[i], text[j])))
        parts = [r["fingerprint"].split("-"), r["edited_fingerprint"].split("-"), out[j]["fingerprint"].split("-")]
        assert math.isclose(r["near_edited"], np.mean([a == b for a, b in zip(parts[0], parts[1], strict=True)]))
        assert math.isclose(r["near_next"], np.mean([a == b for a, b in zip(parts[0], parts[2], strict=True)]))
        by_text[text[i]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert len(set.union(*by_text.values())) > 0.8 * len(by_text)
    awkward = fingerprints.fingerprint_documents(edge).collect()
    ordered = sorted(PAIRS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter(
        (i, len(t or ""), sha(brute.edited(t or "", ordered[(k + 1) % len(ordered)][1] or ""))) for k, (i, t) in enumerate(ordered)
    )
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in awkward) == want
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprints_in_small_buckets(small, monkeypatch):
    df, plain = small
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 7)
    text, ids = dict(plain), [i for i, _ in plain]
    found = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprint_documents(df).collect()}
    assert found == {i: sha(brute.edited(text[i], text[j])) for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards(edge, empty, shards):
    out = sharding.shard_documents(edge, shards).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), brute.jump(i or 0, shards), brute.jump(i or 0, shards + 1)) for i, t in PAIRS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, shards).count() == 0


def test_tokens(small, edge, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df, plain in (small, (edge, PAIRS)):
        want = Counter()
        for i, t in plain:
            ids = theirs.encode_ordinary(t or "")
            want[i, len(ids), sha(",".join(map(str, ids))), sha(t or "")] += 1
        assert rows(bpe.encode_documents(df, PATH, public_tokenizers.PATTERN, digests=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_pieces_of_any_kind():
    ranks = bpe.read_ranks(PATH)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(chr(c) for c in rng.choice([*range(32, 127), 9, 10, 28, 31, 133, 160, 0x3000, 0xE9, 0x4E2D, 0x1F642, 0x300, 0xB2, 0x661], 80))
        assert codec.encode(text) == theirs.encode_ordinary(text), text
        assert codec.decode(codec.encode(text)) == text.encode()
    for piece in (b"ab" * 3_000, bytes(rng.integers(97, 100, 4_000, np.uint8)), b"a" * 1_500):
        short, long_ = bpe.LONG_PIECE, 1 << 30
        bpe.LONG_PIECE = long_
        plain = bpe.fold(piece, ranks)
        bpe.LONG_PIECE = short
        assert bpe._fold_long(piece, ranks) == plain


def test_personal_data(small, edge, empty):
    kinds = ("email", "ip", "card", "phone")
    for df, plain in (small, (edge, PAIRS)):
        want, base = Counter(), {}
        for i, t in plain:
            found = brute.personal(t)
            n = Counter(k for k, _, _ in found)
            want[(i, *(n[k] for k in kinds), sha(",".join(f"{k}:{a}:{b}" for k, a, b in found)))] += 1
            base[i] = {f"{k}:{a}:{b}" for k, a, b in found}
        out = pii.find_pii(df).collect()
        assert Counter((r["doc_id"], *(r[f"n_{k}"] for k in kinds), r["base_sha256"]) for r in out) == want
        for r in out:
            every = r["spans"].split(",") if r["spans"] else []
            assert base[r["doc_id"]] <= set(every)
            assert every == sorted(every, key=lambda s: (kinds.index(s.split(":")[0]), int(s.split(":")[1])))
    assert pii.find_pii(empty).count() == 0
    masked = {r["doc_id"]: r for r in pii.mask_documents(edge).collect()}
    assert masked[1]["text"] is None and masked[4]["text"] == "word"
    assert masked[None]["text"].endswith("mail [EMAIL]") and masked[None]["n_chars"] == len(masked[None]["text"])


def test_skip_edges_carry_a_label(spark):
    """A bare number that is a phone number elsewhere in the document is found; one that stands alone is not."""
    known = [(i, f"word +1 (743) 555-{3000 + i} word and again 743-555-{3000 + i} end") for i in range(200)]
    other = [(1_000 + i, f"there were 1{i} of them in 19{10 + i % 80}") for i in range(200)]
    df = spark.createDataFrame(known + other, "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert not any(out[i] for i, _ in other)
    field = pii.train_field(df)
    assert field.edges[1][4, 4] >= field.edges[1][4, 1]
    shape = pii.shape("743-555-3000")
    strong = (pii.shape("+17435553000"), shape)
    assert field.marginals(list(strong), [(0, 1, 1)])[1, 4] >= field.marginals([shape], [])[0, 4]


def test_missed_mentions_are_found(spark):
    """All mentions that the patterns miss are added, however often and far off; numbers of the same form alone are not."""
    known = [(i, f"word +1 (743) 555-{3000 + i} word and again 743-555-{3000 + i} end") for i in range(200)]
    other = [(1_000 + i, f"there were 1{i} of them in 19{10 + i % 80}") for i in range(200)]
    forms = [(2_000 + i, f"part 212-867-{4000 + i} of series 743 in box {i}") for i in range(2_000)]
    often = (5_000, "743-555-9999 and " * 40 + "+1 (743) 555-9999, 743-555-9999 of 743 people in 2023-12-01")
    df = spark.createDataFrame([*known, *other, *forms, often], "doc_id long, text string")
    for docs in (df.where("doc_id < 2000"), df):
        out = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in pii.find_pii(docs).collect()}
        for i, text in known:
            a, b = text.index("743-"), text.index(" end")
            assert out[i] == [f"phone:{text.index('+')}:{text.index(' word and')}", f"phone:{a}:{b}"], (i, out[i])
        assert not any(out[i] for i, _ in other)
    assert not any(out[i] for i, _ in forms)
    assert len(out[5_000]) == 42 and out[5_000][-1].endswith(f":{often[1].index(' of 743')}")


def test_very_long_parts_of_addresses():
    """A part of thousands of digits is no number that a machine has to convert."""
    text = f"a 1.2.3.{'0' * 5_000}1 b 10.0.0.{'9' * 5_000} c {'1' * 6_000}.2.3.4 d 1.2.3.0256"
    start = time.perf_counter()
    found = pii.base_spans(text)
    assert [s for s in found if s[0] == 1] == [(1, 2, 2 + 6 + 5_001)]
    assert time.perf_counter() - start < 1
    pii.shape(f"{'1' * 6_000}.2.3.4")


def test_many_tags_in_one_text():
    text = b"".join(b"SPDX-License-Identifier: MIT OR Apache-2.0 AND (GPL-2.0 WITH x%d)\n" % k for k in range(10_000))
    scanner = licenses.Scanner()
    start = time.perf_counter()
    found = scanner.scan(text)
    assert time.perf_counter() - start < 1
    assert found[5] == "apache,gpl,mit" and found[6] == 1.0


def test_columns_with_clashing_names_stay(edge):
    """Whatever a user calls a column, it comes back as it was."""
    own = ["__text", "__body", "__shard", "Body", "shard", "kept_id", "repeated"]
    labels = edge.sparkSession.createDataFrame([(6, 1)], "doc_id long, quality int")
    for out in (pii.mask_documents(edge), mixing.mixed_texts(edge), jaccard_join.one_of_each(edge), quality_rules.keep_documents(edge, labels)):
        assert out.columns == edge.columns
        assert {tuple(r) for r in out.select(own).collect()} == {("t", "b", "d", "B", 3, 4, "r")}


def test_licenses(small, edge, empty):
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    for df, plain in (small, (edge, PAIRS)):
        out = licenses.scan_licenses(df).cache()
        assert rows(out, *names) == Counter((i, *brute.licenses(t)) for i, t in plain)
        for r in out.collect():
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    tagged = licenses.scan_licenses(edge).where("doc_id = 14").first()
    assert tagged["labels"] == "apache,bsd,cc-by,gpl,mit"
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "free"),
    [("mit", True), ("gpl-2.0 or mit", True), ("gpl-2.0 and mit", False), ("gpl-2.0 and mit or mit", True), ("gpl-2.0 and (mit or mit)", False), ("gpl-3.0 with exception or mit", True)],
)
def test_expressions(text, free):
    assert licenses.evaluate(licenses.tokens_of(text.encode())).permissive is free


@pytest.mark.parametrize("text", ["", "or mit", "mit or", "(mit", "mit)", "mit mit", "() and mit"])
def test_not_expressions(text):
    with pytest.raises(ValueError):
        licenses.evaluate(licenses.tokens_of(text.encode()))


def test_targets():
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200.0, 500 / 3, 250 / 3])
    assert mixing.targets([1, 1000], [5, 2]) == pytest.approx([2.0, 1499.5])


def test_mixing(small, edge, empty):
    df, plain = small
    out = mixing.mix_documents(df).collect()
    size = {i: len(brute.WORD.findall(t)) for i, t in plain}
    by_source = defaultdict(list)
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        by_source[r["source"]].append(r)
    sources = sorted(by_source)
    want = mixing.targets([sum(r["size"] for r in by_source[s]) for s in sources], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sources))])
    for s, t in zip(sources, want, strict=True):
        assert all(r["target"] == pytest.approx(t) for r in by_source[s])
        assert abs(sum(r["taken"] for r in by_source[s]) - t) <= 2 * mixing.MIN_BLOCK + 0.01 * t
    again = mixing.mix_documents(df.repartition(5)).collect()
    assert sorted(r["taken"] for r in again) == sorted(r["taken"] for r in out) and {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in out}
    awkward = mixing.mix_documents(edge).collect()
    assert len(awkward) == len(EDGE) and {r["source"] for r in awkward} == {"s1", "s2", "s3", None}
    assert sum(r["taken"] for r in awkward if r["doc_id"] in (1, 2, 3)) == 0
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0
    words = Counter()
    for r in mixing.mixed_texts(edge).collect():
        words[r["doc_id"], r["source"]] += len(brute.WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["place"] == "p"
    taken = Counter()
    for r in awkward:
        taken[r["doc_id"], r["source"]] += r["taken"]
    assert +words == +taken


def test_small_sources_meet_their_targets(spark):
    sizes = {"a": 1, "b": 5, "c": 33, "d": 40, "e": 100, "f": 700, "g": 9_000}
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    for r in mixing.mix_documents(df).collect():
        assert abs(r["taken"] - r["target"]) <= 1 + 0.01 * r["target"], r


def test_splitting_tree():
    quotas = [1_000, 3, 0, 250, 7_777]
    out = mixing.split_quotas(quotas, 16, 1)
    assert out.sum(1).tolist() == quotas and out.min() >= 0
    assert out.sum(0).max() - out.sum(0).min() <= 16
    assert (out == mixing.split_quotas(quotas, 16, 1)).all()
    big = np.array([3_000_000_000, 1_000_000_000, 5], np.int64)
    draw = mixing._draw(np.random.default_rng(1), big, 1_500_000_000)
    assert draw.sum() == 1_500_000_000 and (draw <= big).all()


@pytest.mark.parametrize("blocks", [1, 2, 3, 64, 1_000])
def test_permutation(blocks):
    assert sorted(mixing.permuted(np.arange(blocks), blocks, 17).tolist()) == list(range(blocks))


def test_quality_metrics(small, edge, empty):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    labels = edge.sparkSession.createDataFrame([(6, 1, 0), (9, 0, 1), (5, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for df, plain in (small, (edge, PAIRS)):
        out = quality_rules.judge_documents(df, labels).cache()
        assert rows(out, *names) == Counter((i, *brute.quality(t)) for i, t in plain)
        assert not out.where("kept and base_failed").count()
        assert not out.where("not kept and not base_failed").count()  # far too few labels to certify a cutoff
    assert quality_rules.judge_documents(empty, labels).count() == 0
    kept = quality_rules.keep_documents(edge, labels)
    assert kept.columns == edge.columns and kept.count() == sum(not brute.quality(t)[-1] for _, t in PAIRS)


def test_rows_of_one_id_are_judged_apart(spark):
    docs = [(i, t, "en") for i in (None, 7) for t in (prose(1), prose(2), "too short", "", "again and again " * 20, prose(1))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert rows(quality_rules.keep_documents(df, labels), "doc_id", "text", "lang") == Counter(d for d in docs if not brute.quality(d[1])[-1])


def test_binomial_tail_is_exact():
    for k, n, p in ((0, 50, 0.1), (3, 80, 0.1), (20, 1_000, 0.03)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules._log_binomial_tail(k, n, p) == pytest.approx(math.log(want))


def test_certified_cutoffs_reject_bad_ones_only(spark):
    """Junk with many symbols is rejected where labels suffice, and the good documents stay."""
    def text(i, junk):
        return " ".join(f"{'%' * 3 if junk else ''}w{i}x{k}" for k in range(20))

    docs = [(i, text(i, i % 4 == 0), "en") for i in range(8_000)] + [(8_000 + i, text(i, i % 4 == 0), "xx") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _, _ in docs if i % 2 == 0 or i >= 8_000], "doc_id long, quality int")
    out = quality_rules.judge_documents(df, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in out if r["doc_id"] < 8_000)
    assert all(r["kept"] for r in out if r["doc_id"] >= 8_000)


def test_grades_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rated = ordinal.grades(spark.read.parquet(f"{folder}/labels.parquet"))
    model = ordinal.fit_grades(docs, rated.where("doc_id % 4 <> 1"), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    held = ordinal.score_grades(docs, model).join(rated.where("doc_id % 4 = 1"), "doc_id").collect()
    good = [r["kept"] for r in held if r["grade"] == 2]
    bad = [r["kept"] for r in held if r["grade"] < 2]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5
    means = [np.mean([r["expected_grade"] for r in held if r["grade"] == g]) for g in (0, 2)]
    assert means[0] < means[1]


def test_grades_of_awkward_rows(edge, empty):
    rated = edge.sparkSession.createDataFrame([(6, 2), (9, 0), (5, None), (99, 1), (13, 7)], "doc_id long, grade int")
    model = ordinal.fit_grades(edge, rated, 3)
    out = ordinal.score_grades(edge, model).collect()
    assert len(out) == len(EDGE)
    for r in out:
        assert 0 <= r["expected_grade"] <= 2 and r["tails"][0] >= r["tails"][1]
    assert ordinal.score_grades(empty, ordinal.fit_grades(empty, rated, 3)).count() == 0
