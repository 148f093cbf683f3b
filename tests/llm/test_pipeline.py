"""The pipeline against plain versions of its stages, each on what the one before kept."""

from __future__ import annotations

from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest

import corpus_pipeline
from pulseframe.llm import bpe, mixing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage, written and read again between them."""
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality_rules(stages):
    want = sorted(r["doc_id"] for r in stages[0].collect() if not brute.quality(r["text"])[-1])
    assert ids(stages[1]) == want


def test_near_duplicates(stages):
    plain = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert ids(stages[2]) == sorted(i for i, _, c in brute.components(plain) if i == c)


def test_personal_data(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        found = brute.personal(text)
        assert after[i] == text or not found or "[" in after[i]
        assert not brute.personal(after[i])


def test_mixing(stages):
    size, taken = defaultdict(int), defaultdict(int)
    for r in stages[3].collect():
        size[r["source"]] += len(brute.WORD.findall(r["text"]))
    for r in stages[4].collect():
        taken[r["source"]] += len(brute.WORD.findall(r["text"]))
    sources = sorted(size)
    want = mixing.targets([size[s] for s in sources], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sources))])
    for s, t in zip(sources, want, strict=True):
        assert abs(taken[s] - t) <= 2 * mixing.MIN_BLOCK + 0.01 * t


def test_encoding(stages):
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], r["text"]) for r in stages[4].collect())
    assert Counter((r["doc_id"], codec.decode(r["ids"]).decode()) for r in stages[5].collect()) == want


def test_run_agrees_with_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).count() == stages[-1].count()
