"""Registered queries of the subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.bpe import encode_documents
from pulseframe.llm.fill_middle import fill_in_middle
from pulseframe.llm.fingerprints import fingerprint_documents
from pulseframe.llm.jaccard_join import jaccard_components
from pulseframe.llm.licenses import scan_licenses
from pulseframe.llm.mixing import mix_documents
from pulseframe.llm.ordinal import fit_grades, grades, score_grades
from pulseframe.llm.pieces import encode_pieces
from pulseframe.llm.pii import find_pii
from pulseframe.llm.quality_rules import judge_documents
from pulseframe.llm.resampling import resample_documents
from pulseframe.llm.sharding import shard_documents
from pulseframe.llm.suffix_dedup import remove_repeats
from pulseframe.llm.tables import benchmark, documents, labels

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
SHARDS = 40


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), SHARDS)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_grades(docs, fit_grades(docs, grades(labels(spark, sf_dir)), levels=3))
    return scored.select("doc_id", "expected_grade", F.get("tails", F.lit(0)).alias("p_not_toxic"), F.get("tails", F.lit(1)).alias("p_good"), "kept")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(
        documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, digests=True, tokens=False
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir)).drop("runs")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_documents(documents(spark, sf_dir), benchmark(spark, sf_dir))


#: CRC-32 of every distinct feature is a fold over its bytes with the table of the polynomial.
OP11_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS place, 'source' AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
  UNION ALL
  SELECT row_number() OVER (), 'target', NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
split AS (SELECT place, side, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT place, side, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM split),
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
named AS (
  SELECT feature, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(len(hex(feature)) // 2), lambda k: ('0x' || substr(hex(feature), 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM features), crc_table),
found AS (SELECT place, side, bucket FROM features JOIN named USING (feature)),
counts AS (SELECT bucket, count(*) FILTER (side = 'source') AS s, count(*) FILTER (side = 'target') AS t FROM found GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (
  SELECT place, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM found JOIN gains USING (bucket) WHERE side = 'source' GROUP BY place),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (place) WHERE side = 'source'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf_dir), digests=True, texts=False)


OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
numbers AS (
  SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d
  FROM drawn),
parts AS (
  SELECT doc_id, text, n, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
cut AS (
  SELECT *, substring(text, 1, p) AS prefix, substring(text, p + 1, m) AS middle, substring(text, p + m + 1) AS suffix FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(documents(spark, sf_dir), public_tokenizers.path(PIECES), digests=True, tokens=False)


QUERIES = {
    "op1_suffix_dedup": (op1_suffix_dedup, None),
    "op2_jaccard": (op2_jaccard, None),
    "op3_fingerprints": (op3_fingerprints, None),
    "op4_sharding": (op4_sharding, None),
    "op5_quality_classifier": (op5_quality_classifier, None),
    "op6_bpe": (op6_bpe, None),
    "op7_pii": (op7_pii, None),
    "op8_licenses": (op8_licenses, None),
    "op9_mixing": (op9_mixing, None),
    "op10_quality": (op10_quality, None),
    "op11_resampling": (op11_resampling, OP11_SQL),
    "op12_fill_middle": (op12_fill_middle, OP12_SQL),
    "op13_pieces": (op13_pieces, None),
}
