"""Text, grok and log category queries, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions.grok import Grok, grok_coverage, grok_extract, grok_lines
from pulseframe.functions.text import (
    explode_lines, grep_lines, map_lines, token_frequencies, token_kinds, tokenize, word_counts,
)
from pulseframe.operators.bayes import accuracy, model_table, train
from pulseframe.plans.gateway import categorise_logs
from pulseframe.plans.tables import table
from pulseframe.sources.training import labelled

LINES_SQL = r"""
    SELECT doc_id, i - 1 AS line_no, l AS line FROM (
        SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (
            SELECT doc_id, list_transform(string_split(regexp_replace(text, '\r?\n$', ''), chr(10)),
                       lambda x: regexp_replace(regexp_replace(replace(x, chr(9), ' '), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')) AS ls
            FROM documents))"""
URL_FIELDS = {"kind": r"%{WORD:proto}://%{NOTSLASH:host}/%{WORD:lang}/%{POSINT:number}"}
URL_EXTRA = {"NOTSLASH": r"[^/\s]+"}
URL_SQL = r"'\b\w+\b://[^/\s]+/\b\w+\b/\b[1-9][0-9]*\b'"
URL_GROUPS = r"'(\b\w+\b)://([^/\s]+)/(\b\w+\b)/(\b[1-9][0-9]*\b)'"
TRAIN_SQL = r"""
    WITH w AS (SELECT lang AS label, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents WHERE lang IS NOT NULL),
         c AS (SELECT label, token, count(*) AS n FROM w GROUP BY ALL),
         t AS (SELECT label, sum(n)::BIGINT AS label_tokens FROM c GROUP BY label),
         v AS (SELECT count(DISTINCT token) AS vocabulary FROM c)"""
SCORE_SQL = r"""
    , known AS (SELECT DISTINCT token FROM c),
    q AS (SELECT id, token, count(*) AS n FROM (
        SELECT {id} AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS token FROM {table}) GROUP BY ALL),
    prior AS (SELECT lang AS label, ln(count(*) / (SELECT count(*) FROM documents WHERE lang IS NOT NULL)) AS p
              FROM documents WHERE lang IS NOT NULL GROUP BY lang),
    s AS (SELECT q.id, prior.label, any_value(p) + sum(q.n * ln((coalesce(c.n, 0) + 1) / (label_tokens + vocabulary))) AS score
          FROM q JOIN known USING (token) CROSS JOIN prior JOIN t USING (label) CROSS JOIN v
          LEFT JOIN c ON c.label = prior.label AND c.token = q.token GROUP BY q.id, prior.label),
    best AS (SELECT id, arg_max(label, score) AS category FROM s GROUP BY id),
    fallback AS (SELECT arg_max(label, p) AS label FROM prior)"""


def text_lines(spark, d):
    return explode_lines(table(spark, d, "documents"), "text", ["doc_id"]).select("doc_id", "line")


def grep(spark, d):
    return grep_lines(table(spark, d, "documents"), "text", r"(^|[^0-9])[0-9]{3}([^0-9]|$)", ["doc_id"]).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


def mapped_lines(spark, d):
    """Length of each line that has one of two letters, added up per text."""
    sizes = map_lines(F.col("text"), lambda l: F.when(l.rlike("[qz]"), F.length(l)))
    return table(spark, d, "documents").select("doc_id", F.explode(sizes).alias("size")).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum("size").cast("bigint").alias("characters")
    )


def grok_urls(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url")
    return grok_extract(rows, "url", URL_FIELDS["kind"], ["proto", "host", "lang", "number"], URL_EXTRA).drop("url")


def coverage(spark, d):
    patterns = {"article": URL_FIELDS["kind"], "query": r"\?%{WORD}=%{NOTSPACE:rest}", "secure": r"^https://", "bad": "%{NOSUCH}"}
    return grok_coverage(table(spark, d, "pages"), "url", patterns, URL_EXTRA)


def grok_document_lines(spark, d):
    found = grok_lines(table(spark, d, "documents"), "text", r"%{WORD:key} = \"%{NOTQUOTE:value}\"", ["doc_id"], ["key", "value"], {"NOTQUOTE": r"[^\"]+"})
    return found.select(
        "doc_id", F.try_element_at("captures", F.lit("key")).alias("key"), F.try_element_at("captures", F.lit("value")).alias("value"),
        F.size("captures").cast("bigint").alias("fields"),
    )


def grok_is_match(spark, d):
    grok = Grok(URL_FIELDS["kind"] + r"(?:\?%{NOTSPACE:rest})?", URL_EXTRA)
    return table(spark, d, "pages").select("page_id", grok.matches(F.col("url")).alias("matches"), grok.is_match(F.col("url")).alias("complete"))


def frequencies(spark, d):
    return token_frequencies(table(spark, d, "documents"), "text")


def tokens_of_props(spark, d):
    """Property texts, with quotes, split into tokens."""
    return tokenize(table(spark, d, "events"), "props", ["event_id"]).select(
        "event_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", "|").alias("tokens")
    )


def kinds(spark, d):
    return token_kinds(table(spark, d, "documents"), "text", []).groupBy("kind").agg(
        F.count("*").alias("n"), F.sum(F.length("value")).alias("characters")
    )


def words_by_language(spark, d):
    return word_counts(table(spark, d, "documents"), "text", ["lang"])


def bad_patterns(spark, d):
    """A pattern that cannot be compiled gives no rows, and the columns of one that can."""
    pages = table(spark, d, "pages")
    url = pages.select("page_id", F.col("url").alias("text"))
    grok = grok_extract(url, "text", "%{NOSUCH:proto}", ["proto"]).select("page_id", F.col("proto").alias("found"))
    odd = grok_extract(url, "text", "(%{WORD:proto}", ["proto"]).select("page_id", F.col("proto").alias("found"))
    by_line = grok_lines(url, "text", "%{WORD:k}[", ["page_id"], ["k"]).select("page_id", F.col("captures")["k"].alias("found"))
    grep_ = grep_lines(url, "text", "(unclosed", ["page_id"]).select("page_id", F.col("line").alias("found"))
    good = grok_extract(url, "text", "^%{WORD:proto}:", ["proto"]).select("page_id", F.col("proto").alias("found"))
    return grok.unionByName(odd).unionByName(by_line).unionByName(grep_).unionByName(good)


def nb_model(spark, d):
    model = model_table(labelled(table(spark, d, "documents"), "lang", "text"))
    return model.select("label", "token", "n", "label_tokens", "vocabulary", F.round("log_prob", 6).alias("log_prob"))


def log_category(spark, d):
    model = train(labelled(table(spark, d, "documents"), "lang", "text"))
    done = model.categorize(table(spark, d, "conversations"), "text")
    return done.select("conv_id", "turn", "role", "category")


def gateway_log_categories(spark, d):
    """Documents as log records whose ids repeat or are missing; a record's category depends on its text alone."""
    docs = table(spark, d, "documents")
    number = F.col("doc_id") % 3
    logs = docs.select(
        "doc_id", F.when(number == 0, F.lit("ID7")).when(number == 1, F.col("doc_id").cast("string")).alias("id"),
        F.col("text").cast("variant").alias("data"),
    )
    done = categorise_logs(logs, train(labelled(docs, "lang", "text")))
    return done.select("doc_id", F.col("analytical_data.category").alias("category"))


def log_category_accuracy(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    done = train(labelled(docs, "lang", "text")).categorize(docs.select("doc_id", "lang", "text"), "text")
    return accuracy(done, "lang")


QUERIES = {
    "text_lines": (text_lines, f"SELECT doc_id, line FROM ({LINES_SQL}) WHERE line <> ''"),
    "grep_lines": (grep, f"SELECT * FROM ({LINES_SQL}) WHERE regexp_matches(line, '(^|[^0-9])[0-9]{{3}}([^0-9]|$)')"),
    "map_lines": (
        mapped_lines,
        f"""SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS characters FROM ({LINES_SQL})
            WHERE line <> '' AND regexp_matches(line, '[qz]') GROUP BY doc_id""",
    ),
    "grok_extract": (
        grok_urls,
        f"""SELECT page_id, regexp_extract(url, {URL_GROUPS}, 1) AS proto, regexp_extract(url, {URL_GROUPS}, 2) AS host,
                   regexp_extract(url, {URL_GROUPS}, 3) AS lang, regexp_extract(url, {URL_GROUPS}, 4) AS number
            FROM pages WHERE regexp_matches(url, {URL_SQL})""",
    ),
    "grok_coverage": (
        coverage,
        rf"""SELECT 'article' AS pattern, count(*) FILTER (regexp_matches(url, {URL_SQL})) AS matched, count(*) AS total FROM pages
             UNION ALL SELECT 'query', count(*) FILTER (regexp_matches(url, '\?\w+=\S+')), count(*) FROM pages
             UNION ALL SELECT 'secure', count(*) FILTER (starts_with(url, 'https://')), count(*) FROM pages
             UNION ALL SELECT 'bad', 0, count(*) FROM pages""",
    ),
    "grok_lines": (
        grok_document_lines,
        rf"""SELECT doc_id, nullif(k, '') AS key, nullif(v, '') AS value, CASE WHEN k = '' THEN 0 ELSE 2 END::BIGINT AS fields FROM (
             SELECT doc_id, regexp_extract(line, '\b(\w+)\b = "([^"]+)"', 1) AS k, regexp_extract(line, '\b(\w+)\b = "([^"]+)"', 2) AS v
             FROM ({LINES_SQL}))""",
    ),
    "grok_is_match": (
        grok_is_match,
        rf"""SELECT page_id, regexp_matches(url, {URL_SQL}) AS matches,
                    regexp_extract(url, '\b\w+\b://[^/\s]+/\b\w+\b/\b[1-9][0-9]*\b(?:\?(\S+))?', 1) <> '' AS complete FROM pages""",
    ),
    "token_frequencies": (
        frequencies,
        r"""SELECT token, count(*) AS n FROM (
                SELECT CASE WHEN t[1] NOT IN ('"', '''') THEN t
                            WHEN length(t) > 1 AND t[-1] = t[1] THEN t[2:-2]
                            ELSE regexp_replace(regexp_replace(t[2:], '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') END AS token
                FROM (SELECT unnest(regexp_extract_all(text, '"[^"]*(?:"|$)|''[^'']*(?:''|$)|[^\s\p{Z}''"]+')) AS t FROM documents))
            WHERE token <> '' GROUP BY token""",
    ),
    "tokenize": (
        tokens_of_props,
        """SELECT event_id, 4::BIGINT AS n, '{|k|:|' || json_extract_string(props, '$.k') || '}' AS tokens FROM events""",
    ),
    "token_kinds": (
        kinds,
        r"""SELECT CASE WHEN regexp_full_match(p, '[\p{L}\p{N}]+') THEN 'word' WHEN regexp_full_match(p, '[\s\p{P}\p{Z}]+') THEN 'separator'
                        WHEN regexp_full_match(p, '[^\p{L}\p{N}\s\p{P}\p{Z}]+') THEN 'unknown' END AS kind, count(*) AS n, sum(length(p))::BIGINT AS characters
            FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[\s\p{P}\p{Z}]+|[^\p{L}\p{N}\s\p{P}\p{Z}]+')) AS p FROM documents)
            GROUP BY ALL""",
    ),
    "word_counts": (
        words_by_language,
        r"""SELECT lang, word, count(*) AS n FROM (
                SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents) GROUP BY ALL""",
    ),
    "bad_patterns": (bad_patterns, r"""SELECT page_id, regexp_extract(url, '^(\b\w+\b):', 1) AS found FROM pages WHERE regexp_matches(url, '^\b\w+\b:')"""),
    "nb_model": (
        nb_model,
        TRAIN_SQL + "SELECT label, token, n, label_tokens, vocabulary, round(ln((n + 1) / (label_tokens + vocabulary)), 6) AS log_prob FROM c JOIN t USING (label), v",
    ),
    "log_category": (
        log_category,
        TRAIN_SQL + SCORE_SQL.format(id="struct_pack(c := conv_id, t := turn)", table="conversations") + """
        SELECT conv_id, turn, role, coalesce(category, (SELECT label FROM fallback)) AS category
        FROM conversations LEFT JOIN best ON best.id = struct_pack(c := conv_id, t := turn)""",
    ),
    "gateway_log_categories": (
        gateway_log_categories,
        TRAIN_SQL + SCORE_SQL.format(id="doc_id", table="documents") + """
        SELECT doc_id, coalesce(category, (SELECT label FROM fallback)) AS category
        FROM documents LEFT JOIN best ON best.id = doc_id WHERE text IS NOT NULL""",
    ),
    "log_category_accuracy": (
        log_category_accuracy,
        TRAIN_SQL + SCORE_SQL.format(id="doc_id", table="documents") + """
        SELECT lang, count(*) AS n, count(*) FILTER (lang = coalesce(category, (SELECT label FROM fallback))) AS correct
        FROM documents LEFT JOIN best ON best.id = doc_id WHERE lang IS NOT NULL GROUP BY lang""",
    ),
}
