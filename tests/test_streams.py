"""Keyed state of streams, without a stream."""

import random

import pandas as pd

from pulseframe.streaming import jobs


class Held:
    """A value of state."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_problems_of_a_bucket_share_a_call_and_a_state():
    rng, state, got, want, opened = random.Random(3), jobs.AlertState(), [], [], {}
    state.state = Held()
    for batch, size in enumerate([1, 40, 2, 60, 60]):
        rows = [(rng.randrange(9), 100 * batch + rng.randrange(50), 1000 * batch + i, rng.randrange(2)) for i in range(size)]
        frame = pd.DataFrame(rows, columns=["problem", "at", "eventid", "value"])
        for out in state.handleInputRows((1,), iter([frame[:2], frame[2:]]), None):
            got += [(int(p), int(at), int(e), s, int(o)) for p, at, e, s, o in out.itertuples(index=False)]
        for problem, at, eventid, value in sorted(rows):
            if value:
                opened[problem] = eventid
                want.append((problem, at, eventid, "open", eventid))
            elif problem in opened:
                want.append((problem, at, eventid, "closed", opened.pop(problem)))
    assert got == want and len(want) > 80
    assert dict(zip(*state.state.get())) == opened


def test_series_of_a_bucket_share_a_call_and_a_state():
    rng, held, before = random.Random(5), Held(), {}
    state = jobs.BufferState("topic", "x", ["at", "id"], ["id", "topic", "at", "x"])
    state.state = held
    for batch, size in enumerate([1, 30, 400, 400]):
        rows = [(1000 * batch + i, rng.choice(["a", "b", None]), 100 * batch + rng.randrange(50), float(rng.randrange(9))) for i in range(size)]
        frame = pd.DataFrame(rows, columns=["id", "topic", "at", "x"]).assign(__bucket=1)
        out = pd.concat(state.handleInputRows((1,), iter([frame[:2], frame[2:]]), None))
        assert list(out) == ["id", "topic", "at", "x", jobs.BUFFER]
        got = {i: (None if pd.isna(t) else t, at, x, list(b)) for i, t, at, x, b in out.itertuples(index=False)}
        assert len(out) == len(got) == size
        for i, topic, at, x in sorted(rows, key=lambda r: (r[2], r[0])):
            before[topic] = [*before.get(topic, []), x][-128:]
            assert got[i] == (topic, at, x, before[topic])
    keys, lengths, values = held.get()
    assert sorted(lengths) == [128] * 3 and values == [x for k in keys for x in before[k]]
