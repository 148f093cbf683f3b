"""Lines, tokens, grok patterns and log categories."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import text
from pulseframe.functions.fields import error_band, float_to_int, json_get, metrics_from_json, time_window
from pulseframe.functions.grok import Grok, compile_or_none, grok_coverage, grok_extract, grok_lines
from pulseframe.operators import bayes


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first().r


def test_lines(spark):
    t = "  a\tb \r\n\n  c\n"
    assert one(spark, t, text.lines(F.col("t"))) == ["a b", "c"]
    assert one(spark, t, text.all_lines(F.col("t"))) == ["a b", "", "c"]
    assert one(spark, t, text.map_lines(F.col("t"), lambda l: F.when(l != "c", F.upper(l)))) == ["A B"]


@pytest.mark.parametrize("value,tokens", [
    ("a b  c", ["a", "b", "c"]), ('x "y z" w', ["x", "y z", "w"]), ("x 'y \"z' w", ["x", 'y "z', "w"]),
    ('a"b c"d', ["a", "b c", "d"]), ('open "rest of it ', ["open", "rest of it"]), ('""', []), ("", []),
    (r'a \"b c\" d', ["a", '"b', 'c"', "d"]), (r"a\ b c", ["a b", "c"]), (r"a\\b", [r"a\b"]),
])
def test_quoted_tokens(spark, value, tokens):
    df = spark.createDataFrame([(value,)], "t string")
    assert text.tokenize(df, "t", []).first().tokens == tokens
    counted = {r.token: r.n for r in text.token_frequencies(df, "t").collect()}
    assert counted == {t: tokens.count(t) for t in tokens}


def test_kinds(spark):
    rows = text.token_kinds(spark.createDataFrame([("Héllo, wörld 5€",)], "t string"), "t", []).collect()
    assert [(r.value, r.kind) for r in rows] == [
        ("héllo", "word"), (", ", "separator"), ("wörld", "word"), (" ", "separator"), ("5", "word"), ("€", "unknown"),
    ]


def test_grok_apache_line(spark):
    line = '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a.gif HTTP/1.0" 200 2326'
    row = grok_extract(spark.createDataFrame([(line,), ("junk",)], "t string"), "t", "%{COMMONAPACHELOG}", ["clientip", "verb", "request", "response", "bytes"]).collect()
    assert len(row) == 1 and tuple(row[0])[1:] == ("127.0.0.1", "GET", "/a.gif", "200", "2326")


def test_grok_syslog_and_user_pattern(spark):
    g = Grok("%{SYSLOGBASE} %{MOOD:mood}", {"MOOD": "(good|bad)"})
    got = one(spark, "Jan  2 03:04:05 host1 sshd[77]: bad", g.captures(F.col("t"), ["timestamp", "logsource", "program", "pid", "mood"]))
    assert got == {"timestamp": "Jan  2 03:04:05", "logsource": "host1", "program": "sshd", "pid": "77", "mood": "bad"}


def test_unnamed_references_are_captured_by_name(spark):
    g = Grok("%{IP} %{NUMBER}")
    assert one(spark, "10.0.0.1 5.5", g.captures(F.col("t"))) == {"IP": "10.0.0.1", "IPV4": "10.0.0.1", "NUMBER": "5.5", "BASE10NUM": "5.5"}


def test_grok_match_needs_full_captures(spark):
    g = Grok("%{WORD:a}-%{DATA:b}$")
    assert one(spark, "x-y", g.is_match(F.col("t"))) and not one(spark, "x-", g.is_match(F.col("t")))
    assert one(spark, "x-", g.captures(F.col("t"))) == {"a": "x"}


def test_bad_grok_pattern(spark):
    df = spark.createDataFrame([("x",)], "t string")
    assert compile_or_none("%{NOSUCH}") is None and grok_extract(df, "t", "%{NOSUCH}").count() == 0
    rows = {r.pattern: (r.matched, r.total) for r in grok_coverage(df, "t", {"bad": "%{NOSUCH}", "good": "%{WORD}"}).collect()}
    assert rows == {"bad": (0, 1), "good": (1, 1)}


def test_every_default_pattern_compiles(spark):
    from pulseframe.functions.grok import PATTERNS

    df = spark.createDataFrame([("x",)], "t string")
    df.select(*[Grok(f"%{{{name}}}").matches(F.col("t")).alias(name) for name in PATTERNS]).collect()
    assert all(re.fullmatch(r"\w+", name) for name in PATTERNS)


def test_grok_of_empty_lines(spark):
    df = spark.createDataFrame([(1, "a=1\n\nb=2")], "id int, t string")
    rows = grok_lines(df, "t", "%{WORD:k}=%{INT:v}", ["id"], ["k", "v"]).orderBy("line_no").collect()
    assert [r.captures for r in rows] == [{"k": "a", "v": "1"}, {}, {"k": "b", "v": "2"}]


TRAINING = [("ssh", "Failed password from root"), ("ssh", "Invalid user from root"), ("linux", "kernel memory zone")]


def test_categories(spark):
    model = bayes.train(spark.createDataFrame(TRAINING, "label string, text string"))
    texts = ["syslog: Failed password from root", "memory zone memory", "unheard", None, "memory zone memory"]
    df = spark.createDataFrame([("ID7" if i % 2 else None, t) for i, t in enumerate(texts)], "id string, t string")
    found = sorted((r.t or "", r.category) for r in model.categorize(df, "t").collect())
    assert found == sorted([(texts[0], "ssh"), (texts[1], "linux"), ("unheard", "ssh"), ("", None), (texts[4], "linux")], key=lambda r: r[0])


def test_category_without_a_shared_token(spark):
    """Many tokens of a large class can leave a small class, which has none of them, ahead."""
    rows = [("large", "a b c " * 500), ("small", "x"), ("small", "y"), ("small", "z")]
    model = bayes.train(spark.createDataFrame(rows, "label string, text string"))
    from math import log

    text, tokens = "a", {"large": 1500, "small": 3}
    want = max(tokens, key=lambda k: log({"large": 1, "small": 3}[k] / 4) + log((500 if k == "large" else 0) + 1) - log(tokens[k] + 6))
    assert model.categorize(spark.createDataFrame([(text,)], "t string"), "t").first().category == want


def test_rare_tokens_count_as_they_do_among_all(spark):
    """Whether a token's weights are broadcast or joined makes no difference to any category."""
    dice = random.Random(7)
    pick = lambda: " ".join(f"w{min(int(dice.expovariate(0.08)), 60)}" for _ in range(dice.randint(1, 12)))
    training = spark.createDataFrame([(f"l{dice.randint(0, 5)}", pick()) for _ in range(150)], "label string, text string")
    texts = [pick() + dice.choice(["", " unheard", " unheard unheard"]) for _ in range(80)] + ["unheard", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = bayes.train(training)
    assert whole.rare is None
    want = {r.t: r.category for r in whole.categorize(df, "t").collect()}
    for most in (0, 40, 120):
        parts = bayes.train(training, most_sent=most)
        assert parts.weights.count() <= most < parts.weights.unionByName(parts.rare).count() == whole.weights.count()
        assert {r.t: r.category for r in parts.categorize(df, "t").collect()} == want


def test_tokens_are_not_moved_to_be_scored(spark, tmp_path):
    """A text meets the frequent tokens' weights where it is."""
    spark.createDataFrame([(i, "from root " * 40 + str(i)) for i in range(200)], "i int, t string").write.parquet(str(tmp_path / "t"))
    model = bayes.train(spark.createDataFrame(TRAINING, "label string, text string"))
    df = spark.read.parquet(str(tmp_path / "t"))
    sums = model._sums(df.dropDuplicates(["i"]), "i", "t")
    assert sums.count() == 400
    sums.collect()
    plan = sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_model_table(spark):
    rows = {(r.label, r.token): r for r in bayes.model_table(spark.createDataFrame(TRAINING, "label string, text string")).collect()}
    r = rows["ssh", "from"]
    assert (r.n, r.label_tokens, r.vocabulary) == (2, 8, 9)


def test_training_needs_labels(spark):
    with pytest.raises(ValueError):
        bayes.train(spark.createDataFrame([], "label string, text string"))


def test_field_functions(spark):
    row = spark.range(1).select(
        float_to_int(F.lit(-2.7)).alias("a"), float_to_int(F.lit(1e30)).alias("b"), float_to_int(F.lit(float("nan"))).alias("c"),
        error_band(F.lit(10.0), 0.1).alias("d"), error_band(F.lit(-10.0), 0.1).alias("e"), time_window(F.lit(100), 7).alias("f"),
        json_get(F.parse_json(F.lit('{"a":{"b":[1]}}')), "a", "b").alias("g"),
    ).first()
    assert (row.a, row.b, row.c) == (-2, 2**63 - 1, 0)
    assert tuple(row.d) == (9.5, 10.5) and tuple(row.e) == (-10.5, -9.5) and tuple(row.f) == (97, 103)


def test_metric_records(spark):
    df = spark.createDataFrame([('{"key":"/a/b","value":1.5}',), ('{"value":1}',), ("oops",)], "j string")
    rows = metrics_from_json(df, "j").collect()
    assert len(rows) == 1 and (rows[0].skey, rows[0].platform, rows[0].tags, rows[0].src) == ("b", "local", {}, "localhost")


def test_trained_tables_are_files(spark):
    """A checkpoint holds rows as they are in memory; files of the same rows are a fraction of that."""
    for most in (bayes.MOST_SENT, 3):
        model = bayes.train(spark.createDataFrame(TRAINING, "label string, text string"), most_sent=most)
        assert model.weights.inputFiles() and (model.rare is None) == (most > 3)
    assert model.rare.inputFiles()
    found = model.categorize(spark.createDataFrame([(1, TRAINING[0][1]), (2, TRAINING[0][1]), (3, None)], "id int, text string"), "text")
    assert {r.id: r.category for r in found.collect()} == {1: TRAINING[0][0], 2: TRAINING[0][0], 3: None}
