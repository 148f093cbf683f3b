"""Anomalies, breakouts, Markov chains, suppression and pairing on small planted inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import alerts, anomaly, breakout, dedup, frames, joins, markov, scale, stl
from test_fuzzy import edits


def test_planted_spike():
    values = np.array([10 + 3 * (i % 7) + 0.1 * ((i * 37) % 11) for i in range(128)], dtype=float)
    values[60] += 40
    assert anomaly.seasonal_esd(values, 7) == [60]


def test_short_and_constant_series_have_no_anomalies():
    assert anomaly.seasonal_esd(np.arange(13.0), 7) == []
    assert anomaly.seasonal_esd(np.ones(128), 7) == []


def test_t_quantile():
    for p, dof, want in [(0.975, 10, 2.228139), (0.95, 1, 6.313752), (0.9995, 120, 3.373454)]:
        assert anomaly.student_t_quantile(p, dof) == pytest.approx(want, rel=1e-5)


def test_planted_level_shift():
    noise = random.Random(3)
    values = np.array([noise.gauss(0, 0.1) for _ in range(64)] + [noise.gauss(10, 0.1) for _ in range(64)])
    assert breakout.breakpoints(values) == [64]
    assert breakout.breakpoints(values[:13]) == [] and breakout.breakpoints(np.ones(50)) == []


def test_records_of_a_growing_buffer_share_a_search(monkeypatch):
    rng, searched, search = np.random.default_rng(6), [], breakout._best_breaks
    series = [np.concatenate([[0.0, 30.0], 10 + 10 * (np.arange(n) > 60) + rng.random(n)]) for n in (120, 3, 90)]
    series.append(np.concatenate([series[0][:80], [np.nan], np.arange(9.0)]))
    buffers = [s[:i + 1] for s in series for i in range(len(s))]
    buffers += [series[0][i:i + 40] for i in range(20)]
    alone = [breakout.breakpoints(b) for b in buffers]
    monkeypatch.setattr(breakout, "_best_breaks", lambda z, *rest: searched.append(z.shape[1]) or search(z, *rest))
    marks = breakout.break_marks(*frames.padded(buffers))
    assert [np.flatnonzero(m).tolist() for m in marks] == alone and any(alone)
    assert sum(searched) <= 3 + 20 < len(buffers) / 10


def test_two_level_shifts():
    noise = random.Random(4)
    values = np.array([noise.gauss(m, 0.1) for m in (0, 10, 3) for _ in range(40)])
    assert breakout.breakpoints(values) == [40, 80]


def test_segment_medians_by_brute_force():
    dice = random.Random(5)
    z = np.array([[dice.random(), dice.randrange(3), 1.0] for _ in range(20)])
    m = breakout._segment_medians(z)
    assert all((m[i, j] == np.median(z[i:j], axis=0)).all() for i in range(20) for j in range(i + 1, 21))


@pytest.mark.parametrize("seed", range(6))
def test_breakpoints_by_trying_all(seed):
    """The gain of the breaks found is that of a plain search over all last cuts."""
    dice = random.Random(seed)
    values = np.array([dice.gauss(5 * (i // 12 % 2), 1 + seed / 3) for i in range(40)])
    z = (values - values.min()) / (values.max() - values.min())
    best, breaks, last = [0.0] * 41, [0] * 41, [0] * 41
    for end in range(14, 41):
        for cut in range(7, end - 6):
            s = last[cut]
            move = (np.median(z[s:cut]) - np.median(z[cut:end])) ** 2 * (cut - s) * (end - cut) / (end - s) ** 2
            gain = best[cut] + move - 0.008 * (2 * breaks[cut] + 1)
            if gain > best[end] + 1e-12:
                best[end], breaks[end], last[end] = gain, breaks[cut] + 1, cut
    want, at = [], 40
    while last[at]:
        at = last[at]
        want.insert(0, at)
    assert breakout.breakpoints(values) == want


def test_breaks_of_many_series_are_those_of_each():
    """Series of several lengths, too short, constant, empty and broken ones share one search."""
    dice = random.Random(11)
    rows = [[dice.gauss(i // 15 % 3, 0.3) for i in range(n)] for n in (0, 5, 14, 40, 77, 128, 300)]
    rows += [[1.0] * 30, [1.0, float("nan")] * 20, None, [dice.choice([0.0, 5.0]) for _ in range(60)]]
    values, lengths = frames.padded(rows)
    found = breakout.break_marks(values, lengths)
    alone = [np.array(r if r is not None else []) for r in rows]
    assert [np.flatnonzero(m).tolist() for m in found] == [breakout.breakpoints(v) for v in alone]
    assert not found[[0, 1, 7, 8, 9]].any() and found[[4, 5]].any()


def plain_local_line(x, y, at, span, degree, rho):
    """Local regression at one place by least squares."""
    far = np.abs(x - at)
    reach = np.sort(far)[min(span, len(x)) - 1] + max(0, span - len(x)) // 2
    share = far / reach
    weight = rho * np.where(share <= 0.001, 1, np.where(share <= 0.999, (1 - np.minimum(share, 1) ** 3) ** 3, 0))
    return np.polynomial.polynomial.polyfit(x - at, y, degree, w=np.sqrt(weight))[0]


@pytest.mark.parametrize("span, degree, ahead", [(5, 1, 0), (9, 1, 1), (31, 0, 1), (7, 0, 0)])
def test_loess_by_least_squares(span, degree, ahead):
    dice = np.random.default_rng(3)
    y, rho = dice.normal(size=(3, 20)), dice.uniform(0.2, 1, size=(3, 20))
    found = stl.loess(y, span, degree, rho, ahead)
    x = np.arange(20.0)
    want = [[plain_local_line(x, row, at, span, degree, r) for at in range(-ahead, 20 + ahead)] for row, r in zip(y, rho)]
    assert np.allclose(found, want)


def test_season_is_found_around_a_trend_and_outliers():
    at = np.arange(84)
    season = np.array([3.0, -1, 0, 2, -4, 1, -1])[at % 7]
    rows = np.stack([season + 0.2 * at, season - 5 + 30.0 * (at == 40)]) + np.random.default_rng(2).normal(size=(2, 84)) * 0.1
    assert np.abs(stl.seasonal(rows, 7) - season).max() < 0.1
    assert np.abs(stl.seasonal(rows, 7, rounds=0) - season).max() > 1


def plain_esd(left, share, alpha):
    """Generalised ESD with median and MAD, value by value."""
    left, held, taken, count = left - np.median(left), list(range(len(left))), [], 0
    for i in range(1, min(int(len(left) * share), len(left) - 3) + 1):
        now = left[held]
        spread = 1.4826 * np.median(np.abs(now - np.median(now)))
        if spread == 0:
            break
        scores = np.abs(now - np.median(now)) / spread
        worst = int(np.argmax(scores))
        taken.append(held.pop(worst))
        count = i if scores[worst] > anomaly._critical(len(left), i, alpha) else count
    return sorted(taken[:count])


def test_anomalies_of_many_series_are_those_of_each():
    dice = np.random.default_rng(4)
    rows = [dice.standard_t(2, size=n) for n in (3, 14, 30, 30, 77, 128)] + [np.round(dice.normal(size=50)), np.ones(40), np.empty(0)]
    values, lengths = frames.padded(rows)
    assert [np.flatnonzero(m).tolist() for m in anomaly.anomaly_marks(values, lengths, 1)] == [plain_esd(r, 0.1, 0.05) if len(r) > 1 else [] for r in rows]
    whole = [np.flatnonzero(m).tolist() for m in anomaly.anomaly_marks(values, lengths, 7)]
    want = [plain_esd(r - stl.seasonal(r[None, :], 7)[0], 0.1, 0.05) if len(r) >= 14 else [] for r in rows[:6]]
    assert whole[:6] == want and any(want) and whole[7:] == [[], []]


def test_a_drifting_season_needs_a_span():
    at = np.arange(128)
    values = np.where(at % 7 == 3, 10 + at * 0.5, 0) + np.where(at % 7 == 5, 80 - at * 0.5, 0) + (at * 37 % 11) / 100 + 40.0 * (at == 59)
    assert anomaly.seasonal_esd(values, 7, span=7) == [59]
    assert anomaly.seasonal_esd(values, 7) != [59]


def test_arrays_that_are_missing_or_empty(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None] * 20), (4, [1.0] * 20)], "k int, s array<double>")
    found = df.select("k", anomaly.anomaly_column(F.col("s")).alias("a"), breakout.breakout_column(F.col("s")).alias("b"), markov.forecast_column(F.col("s")).alias("m"))
    assert [tuple(r) for r in found.orderBy("k").collect()] == [
        (1, None, None, None), (2, [], [], []), (3, [], [], [None] * 8), (4, [], [], [1.0] * 8)]


def test_generated_paths_follow_the_counts(spark):
    """A cycle is followed, a fork is taken in proportion, an unseen run ends a path, short and missing keys do no harm."""
    rows = [("cycle", i, float(i % 3)) for i in range(30)] + [(None, i, float(i % 2)) for i in range(9)] + [("short", 0, 1.0)]
    rows += [("end", i, float(i)) for i in range(6)]
    dice = random.Random(9)
    fork = [0.0]
    for _ in range(4000):
        fork.append(0.0 if fork[-1] else (1.0 if dice.random() < 0.25 else 2.0))
    rows += [("fork", i, x) for i, x in enumerate([*fork, 0.0] if fork[-1] else fork)]
    df = spark.createDataFrame(rows, "k string, i bigint, x double")
    run = lambda: markov.generated(df, ["k"], ["i"], "x", states=1, steps=3, paths=400, seed=5)
    found = sorted(map(tuple, run().collect()), key=str)
    by = lambda k, step: [v for key, _, s, v in found if key == k and s == step]
    assert by("cycle", 1) == [0.0] * 400 and by("cycle", 2) == [1.0] * 400 and by(None, 1) == [1.0] * 400
    assert not by("short", 1) and not by("end", 1)
    share = by("fork", 1).count(1.0) / 400
    assert len(by("fork", 1)) == 400 and 0.17 < share < 0.33 and by("fork", 2) == [0.0] * 400
    assert found == sorted(map(tuple, run().collect()), key=str)


def test_detectors_over_a_table(spark):
    noise = random.Random(6)
    rows = [("shift", i, noise.gauss(0 if i < 64 else 10, 0.1)) for i in range(128)]
    rows += [("spike", i, 10.0 + 3 * (i % 7) + (40 if i == 90 else 0.1 * ((i * 37) % 11))) for i in range(128)]
    df = spark.createDataFrame(rows, "key string, i bigint, x double")
    found = {r.key: r.breakouts for r in breakout.breakouts(df, ["key"], ["i"], "x").collect()}
    assert found["shift"] == [rows[64][2]]
    odd = {r.key: r.anomalies for r in anomaly.anomalies(df, ["key"], ["i"], "x").collect()}
    assert odd["spike"] == [rows[128 + 90][2]]


def test_markov_repeats_a_cycle():
    values = [1.0, 2.0, 3.0] * 20
    assert markov._chain(values, 8, 8, None, False) == [1, 2, 3, 1, 2, 3, 1, 2]
    assert markov._chain(values, 8, 4, None, True) == [1, 2, 3, 1]
    assert markov._chain(values, 8, 8, 7, False) == markov._chain(values, 8, 8, 7, False)
    assert markov._chain([4.0], 8, 8, None, False) == [4.0]


def test_markov_transitions_in_blocks(spark):
    df = spark.range(1000).select(F.lit("a").alias("key"), "id", (F.col("id") % 5).cast("double").alias("x"))
    cut = markov.transitions(df, ["key"], ["id"], "x", 3, hot_rows=100, block_rows=128)
    uncut = markov.transitions(df, ["key"], ["id"], "x", 3, hot_rows=None)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, uncut.collect()))


def kept(spark, values, q, **kw):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "key string, i bigint, x double")
    return [r.x for r in dedup.tolerance_dedup(df, ["key"], ["i"], "x", q, **kw).orderBy("i").collect()]


def brute_force(values, q, size=128):
    held, out = [], []
    for v in values:
        if not any(min(d - d * q / 2, d + d * q / 2) <= v <= max(d - d * q / 2, d + d * q / 2) for d in held):
            out.append(v)
            held = [*held, v][-size:]
    return out


def test_tolerance(spark):
    assert kept(spark, [10, 10.2, 11], 0.1) == [10, 11]
    assert kept(spark, [-10, -10.2, -11], 0.1) == [-10, -11]


@pytest.mark.parametrize("q", [0.3, 0.004])
def test_tolerance_in_blocks(spark, q):
    """A wide band keeps few values; a narrow one keeps more than 128, so old ones are forgotten."""
    dice = random.Random(9)
    values = [round(dice.expovariate(0.03) + 0.01, 2) for _ in range(2500)]
    want = brute_force(values, q)
    assert kept(spark, values, q, hot_rows=None) == want
    assert kept(spark, values, q, hot_rows=100, block_rows=200) == want
    assert q == 0.3 or len(want) > 128


@pytest.mark.parametrize("q", [0.02, 0.4])
def test_rounds_do_not_grow_with_blocks(spark, q):
    """Blocks that forget what they started from, and blocks that keep next to nothing, settle in a few rounds."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select("event_type", "ts", "event_id", "value")
    blocks = scale.consecutive_blocks(events, ["event_type"], ["ts", "event_id"], 0, 4096, events.count()).drop("__carry")
    fold = dedup._tolerance_fold(q, 128)
    _, rounds = dedup.settled_states(blocks, events.schema, ["event_type"], ["ts", "event_id"], "value", fold, 128)
    assert rounds <= 3


def test_states_with_nan_settle(spark):
    values = [1.0, float("nan"), 2.0, float("nan"), 1.01, 3.0] * 5
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "key string, i bigint, x double")
    run = lambda **kw: [str(r.x) for r in dedup.tolerance_dedup(df, ["key"], ["i"], "x", 0.1, **kw).orderBy("i").collect()]
    assert run(hot_rows=3, block_rows=7) == run(hot_rows=None)


def plain_similarity(texts, q, near, size):
    state, out = [], []
    for t in texts:
        apart = [edits(t, s) for s in state]
        if all(d < q for d in apart) if near else (t not in state and all(d >= q for d in apart)):
            out.append(t)
            state = [*state, t][-size:]
    return out


@pytest.mark.parametrize("near", [False, True])
@pytest.mark.parametrize("q", [0, 1, 3])
def test_similarity_fold_by_brute_force(near, q):
    dice = random.Random(q)
    texts = ["".join(dice.choices("abé", k=dice.choice([0, 1, 3, 5, 70]))) for _ in range(700)]
    for size in (3, 128):
        kept, state = dedup._similarity_fold(q, size, near)(texts, [])
        want = plain_similarity(texts, q, near, size)
        assert [t for t, k in zip(texts, kept) if k] == want and state == want[-size:]


def test_blocks_that_fill_a_state_twice_settle_in_few_rounds(spark):
    """Every text comes twice, so that a block of 112 rows keeps less than four states of 32, but more than one."""
    rng, fold = random.Random(9), dedup._similarity_fold(2, 32, False)
    texts = [f"{rng.randrange(100)} {int(rng.expovariate(0.02))}" for _ in range(1500)]
    df = spark.createDataFrame([("k", 2 * i + copy, text) for i, text in enumerate(texts) for copy in (0, 1)], "key string, i long, t string")
    blocks = scale.consecutive_blocks(df, ["key"], ["i"], 0, 112, 3000).drop("__carry")
    _, rounds = dedup.settled_states(blocks, df.schema, ["key"], ["i"], "t", fold, 32)
    assert rounds <= 5


def test_short_texts_are_found_by_their_deletions(monkeypatch):
    """Texts an edit apart meet in an index: no short text is compared with the others, and a long one changes nothing."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\U0001f600") for _ in range(rng.choice([0, 1, 2, 4, 5]))) for _ in range(400)]
    mixed = [*texts, *("a" * n + "b" for n in range(62, 68)), *texts]
    want, left = dedup._fold(dedup.Texts, lambda held, some: dedup.distances(held, some) < 2, 4)(mixed, texts[:3])
    got, state = dedup._similarity_fold(2, 4, False)(mixed, texts[:3])
    assert got.tolist() == want.tolist() and state == left
    monkeypatch.setattr(dedup, "distances", None)
    assert dedup._similarity_fold(2, 4, False)(texts, texts[:3])[0].tolist() == want[:400].tolist()


def test_similarity(spark):
    texts = ["abcd", "abcf", "wxyz", "abcd", "wxy"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "key string, i bigint, t string")
    far = [r.t for r in dedup.similarity_dedup(df, ["key"], ["i"], "t", 2).orderBy("i").collect()]
    near = [r.t for r in dedup.similarity_dedup(df, ["key"], ["i"], "t", 2, near=True).orderBy("i").collect()]
    cut = dedup.similarity_dedup(df, ["key"], ["i"], "t", 2, hot_rows=2, block_rows=2)
    assert far == ["abcd", "wxyz"] and near == ["abcd", "abcf", "abcd"]
    assert [r.t for r in cut.orderBy("i").collect()] == far


def alert_rows(spark, rows):
    return spark.createDataFrame(rows, "at bigint, value bigint, eventid bigint, p_eventid bigint")


ALERTS = [
    (1, 1, 51, None), (2, 0, 52, 51), (3, 0, 53, 51), (4, 2, 54, None), (5, None, 55, None), (6, 0, 56, 99),
    (7, 1, 60, None), (8, 1, 60, None), (9, 0, 61, 60), (10, 1, 70, None),
]


def test_alert_pairing(spark):
    pairs = {r.at: r for r in alerts.alert_pairs(alert_rows(spark, ALERTS), ["at"]).collect()}
    assert sorted(pairs) == [1, 2, 7, 8, 9, 10]
    assert pairs[1].alert_id == pairs[2].alert_id
    assert pairs[9].alert_id == pairs[8].alert_id != pairs[7].alert_id
    assert [r["at"] for r in alerts.alerts_orphan(alert_rows(spark, ALERTS), ["at"]).orderBy("at").collect()] == [3, 6]
    assert [r.problem for r in alerts.alerts_open(alert_rows(spark, ALERTS), ["at"]).collect()] == [70]


def test_hot_problem(spark):
    rows = [(i, i % 3 % 2, 7, 7) for i in range(900)]
    cut = alerts.alert_pairs(alert_rows(spark, rows), ["at"], hot_rows=50, block_rows=100)
    uncut = alerts.alert_pairs(alert_rows(spark, rows), ["at"], hot_rows=None)
    assert sorted(map(tuple, cut.select("at", "state", "alert_id").collect())) == sorted(
        map(tuple, uncut.select("at", "state", "alert_id").collect())
    )


def test_range_labels(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (20.0,), (-1.0,), (None,)], "v double")
    want = {0.0: "low", 10.0: "mid", 20.0: None, -1.0: None, None: None}
    assert {r.v: r.label for r in joins.label_by_ranges(df, "v", [(0, 10, "low"), (10, 20, "mid"), (0, 10, "x")]).collect()} == want
    ranges = spark.createDataFrame([(0.0, 10.0, "low", 0), (10.0, 20.0, "mid", 1), (0.0, 10.0, "x", 2), (5.0, 5.0, "empty", 3)], "lo double, hi double, label string, seq int")
    assert {r.v: r.label for r in joins.label_by_range_table(df, "v", ranges).collect()} == want


@pytest.mark.parametrize("short", [100_000, 0])
def test_range_table_by_brute_force(spark, short):
    dice = random.Random(11)
    ranges = [(lo := dice.uniform(-50, 50), lo + dice.choice([0.01, 1, 7, 64, 90]), f"r{i}", i) for i in range(200)]
    values = [dice.uniform(-60, 150) for _ in range(300)] + [ranges[0][0], ranges[0][1]]
    table = spark.createDataFrame(ranges, "lo double, hi double, label string, seq int")
    got = {r.v: r.label for r in joins.label_by_range_table(spark.createDataFrame([(v,) for v in values], "v double"), "v", table, broadcast_rows=short).collect()}
    for v in values:
        fits = sorted((lo, hi, label) for lo, hi, label, _ in ranges if lo <= v < hi)
        assert got[v] == (fits[0][2] if fits else None)


def test_bands_equal_all_pairs(spark):
    dice = random.Random(2)
    make = lambda n: [(dice.choice("kl"), i, dice.choice([0.0, dice.uniform(-100, 100), dice.uniform(-1, 1), dice.uniform(-1e6, 1e6)])) for i in range(n)]
    left, right = make(80), make(80)
    a, b = spark.createDataFrame(left, "k string, a bigint, av double"), spark.createDataFrame(right, "k string, b bigint, bv double")
    found = joins.band_overlap_join(a, b, ["k"], "av", "bv", 0.1, 0.2).select("a", "b", "contains", "interior", "overlap_lo", "overlap_hi").collect()

    def band(v, q):
        return min(v - v * q / 2, v + v * q / 2), max(v - v * q / 2, v + v * q / 2)

    want = []
    for k, i, v in left:
        for m, j, w in right:
            (lo, hi), (low, high) = band(v, 0.1), band(w, 0.2)
            if k == m and lo <= high and low <= hi:
                want.append((i, j, low <= v <= high, low < lo and hi < high, max(lo, low), min(hi, high)))
    assert sorted(map(tuple, found)) == sorted(want) and want


def test_around_window_by_brute_force(spark):
    dice = random.Random(8)
    rows = [("k", i, dice.randint(0, 300), dice.uniform(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id bigint, t bigint, x double")
    got = {r.id: (r.events, r.total) for r in joins.around_window(df, df, ["k"], "id", "t", "x", 20).collect()}
    for _, i, t, _ in rows:
        near = [x for _, _, u, x in rows if t - 10 <= u <= t + 10]
        assert got[i][0] == len(near) and got[i][1] == pytest.approx(sum(near))


def test_many_overlapping_ranges_in_blocks(spark):
    """Thousands of ranges over one spot leave disjoint segments, in one block or in many."""
    dice = random.Random(12)
    ranges = [(float(dice.randint(0, 40)), float(dice.randint(41, 90)), f"r{i}", i) for i in range(2000)]
    table = spark.createDataFrame(ranges, "lo double, hi double, label string, seq int")
    whole = joins.disjoint_segments(table).orderBy("lo").collect()
    assert whole == joins.disjoint_segments(table, 100).orderBy("lo").collect()
    assert all(a.hi <= b.lo for a, b in zip(whole, whole[1:]))
    values = [v / 2 for v in range(-4, 190)]
    got = {r.v: r.label for r in joins.label_by_range_table(spark.createDataFrame([(v,) for v in values], "v double"), "v", table, 100).collect()}
    first = {}
    for lo, hi, label, _ in ranges:
        first.setdefault((lo, hi), label)
    for v in values:
        fits = sorted((lo, hi) for lo, hi in first if lo <= v < hi)
        assert got[v] == (first[fits[0]] if fits else None)
