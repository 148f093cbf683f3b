"""Resampling, fill-in-middle and pieces against plain versions and the library, on plain and on awkward rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from awkward import EDGE

from pulseframe.llm import fill_middle, pieces, resampling, spans

PAIRS = [(i, t) for i, t, _, _ in EDGE]
PATH = public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("doc_id", "n_features", "weight", "score", "rank")


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def unranked(counted):
    """Rows without their ranks, for rows that may swap them."""
    return Counter({k[:-1] + (k[-1] is not None,): 0 for k in counted}) + Counter(k[:-1] + (k[-1] is not None,) for k in counted.elements())


def test_resampling(spark, small, edge, empty):
    df, plain = small
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    wanted = [r["text"] for r in target.collect()]
    assert rows(resampling.resample_documents(df, target), *NAMES) == Counter(brute.resampled(plain, wanted))
    texts = [SOME, None, "", "İstanbul 日本 a1"]
    to = spark.createDataFrame([(t,) for t in texts], "text string")
    for percent in (25, 60, 100):
        found = rows(resampling.resample_documents(edge, to, percent, 2), *NAMES)
        assert unranked(found) == unranked(Counter(brute.resampled(PAIRS, texts, 2, percent)))
        ranks = sorted(k[-1] for k in found.elements() if k[-1])
        assert ranks == list(range(1, len(ranks) + 1))
    nothing = spark.createDataFrame([], "text string")
    assert unranked(rows(resampling.resample_documents(edge, nothing), *NAMES)) == unranked(Counter(brute.resampled(PAIRS, [])))
    assert resampling.resample_documents(empty, to).count() == 0


SOME = "one two three four five, ONE two"


def test_resampling_with_one_hot_id(spark, monkeypatch):
    """A third of all rows repeat one row: they get consecutive ranks, over several ranges."""
    monkeypatch.setattr(resampling, "RANGE_ROWS", 40)
    long_ = " ".join(f"w{k}" for k in range(25))
    docs = [(7, long_)] * 200 + [(i, f"{long_} {i} {i % 7}") for i in range(100, 500)] + [(None, long_)] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    to = spark.createDataFrame([(f"w1 w2 {i % 7}",) for i in range(5)], "text string")
    found = rows(resampling.resample_documents(df, to), *NAMES)
    assert found == Counter(brute.resampled(docs, [f"w1 w2 {i % 7}" for i in range(5)]))


def test_fill_in_middle(small, edge, empty):
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    marked = [(100 + k, f"some {m} text {m}") for k, m in enumerate(("<P>", "<S>", "<M>", "<P", "S>", "<S<", "<<M"))]
    df, plain = small
    more = edge.sparkSession.createDataFrame([(1_000 + i, f"日本{i}\n🙂 <S <P> "[: i % 13]) for i in range(300)] + marked, "doc_id long, text string")
    for table, own in ((df, plain), (edge, PAIRS), (more, [tuple(r) for r in more.collect()])):
        out = fill_middle.fill_in_middle(table, digests=True).cache()
        assert rows(out, *names) == Counter((i, *brute.filled(i, t)) for i, t in own)
        assert rows(out, "output_sha256", "restored_sha256") == Counter((sha(brute.filled(i, t)[-1]), sha(t or "")) for i, t in own)
    assert fill_middle.fill_in_middle(empty).count() == 0


@pytest.mark.parametrize(("unit", "pattern"), [("words", r"[^\x20\x09-\x0D]+"), ("lines", r"[^\n]*\n|[^\n]+$")])
def test_cuts_of_other_units(edge, unit, pattern):
    """Both cuts stand at the start of a unit, or at an end of the text, and the text comes back."""
    import re

    for r in fill_middle.fill_in_middle(edge, unit).collect():
        texts = [t or "" for i, t in PAIRS if i == r["doc_id"]]
        found = [m.start() for m in re.finditer(pattern, texts[0])]
        assert r["n"] == len(found)
        if r["form"] != "plain":
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= {0, len(texts[0]), *found}
        assert fill_middle.restored(r["form"], r["output"].encode()).decode() in texts


def test_wavelet_ranks():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1_000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(symbols)
        at = np.arange(n + 1)
        for s in range(8):
            want = np.concatenate([[0], np.cumsum(symbols == s)])
            assert (matrix.rank(s, at) == want).all()
        places = np.flatnonzero(np.isin(symbols, (1, 4)))
        nth = np.arange(len(places) + 1)
        got = matrix.select((1, 4), nth, np.zeros_like(nth), np.full_like(nth, n))
        assert got.tolist() == [*places.tolist(), n]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_pieces(small, edge, empty, library):
    for df, plain in (small, (edge, PAIRS)):
        want = Counter()
        for i, t in plain:
            ids = library.encode(t or "", add_bos=True, add_eos=True)
            want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids))] += 1
        assert rows(pieces.encode_pieces(df, PATH, digests=True, tokens=False), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    out = {r["doc_id"]: r["ids"] for r in pieces.encode_pieces(edge, PATH).collect()}
    assert out[1] == out[2] == [1, 2] and out[4] == library.encode("word", add_bos=True, add_eos=True)
    assert pieces.encode_pieces(empty, PATH).count() == 0


def agree(library, texts):
    model = pieces.model_of(PATH)
    ids, bounds = model.encode(*spans.text_bytes(pa.array(texts, pa.string())))
    back, ends = model.decode(ids, bounds)
    for k, text in enumerate(texts):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want, text[:200]
        assert back[ends[k] : ends[k + 1]].tobytes().decode() == library.decode(want), text[:200]


def test_pieces_of_any_text(library):
    dice = random.Random(1)
    chars = [chr(c) for c in [*range(127), 133, 160, 0x3000, 0xE9, 0x4E2D, 0x1F642, 0x300, 0xB2, 0x661, 0x2581, 0x65E5]] + [" "] * 60 + list("etaoinshrdlu" * 5)
    agree(library, ["".join(dice.choices(chars, k=dice.randint(0, 300))) for _ in range(1_500)])


def test_pieces_of_equal_rank(library):
    """Runs of blanks: their pieces share one score, so a pair that a merge makes may come before the next merge."""
    agree(library, [" " * k for k in range(0, 420, 7)] + ["a" + " " * k + "b" for k in range(30)] + ["▁" * k + " " for k in range(40)])


@pytest.mark.parametrize("limit", [10, 100_000])
def test_long_words(library, monkeypatch, limit):
    monkeypatch.setattr(pieces, "LONG_WORD", limit)
    dice = random.Random(2)
    texts = ["".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (1, 5, 50, 199, 201, 800)] * 5
    agree(library, texts + ["".join(dice.choices("ab ", k=300)) for _ in range(30)] + ["a" * 120, "ab" * 90])


def test_a_very_long_word_ends(library):
    dice = random.Random(3)
    agree(library, ["".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), " " * 50_000, "日本" * 30_000])
