"""Types of a stream in buckets: calls and state grow with the buckets, and types do not touch one another."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from test_lifecycle import CLOCK, fold, run

from lectern.streaming import lifecycle as lc


@pytest.mark.parametrize("buckets", [1, 3])
def test_types_of_a_bucket(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(lc, "BUCKETS", buckets)
    rng = random.Random(buckets)
    updates = {t: list({a: (a, rng.randrange(9), rng.choice([*lc.NEXT][1:])) for a in rng.sample(range(300), 12)}.values()) for t in "abcdefg"}
    flat = sorted(((t, *u) for t, own in updates.items() for u in own), key=lambda r: r[1] + rng.randrange(28))
    got = run(spark, tmp_path, [flat[:30], flat[30:50], flat[50:], [CLOCK]])
    assert got == {t: fold(own) for t, own in updates.items()}


def test_calls_do_not_grow_with_types():
    calls, timers = [], []

    def store(**more):
        held: list = []
        one = lambda name, run: lambda *x: (calls.append(name), run(*x))[1]
        put = lambda x: held.__setitem__(slice(None), x if isinstance(x, list) else [x])
        return SimpleNamespace(held=held, exists=lambda: bool(held), appendValue=one("append", held.append), put=one("put", put), update=one("update", put), clear=one("clear", held.clear), **more)

    state, waiting = store(), store()
    state.get, waiting.get = lambda: state.held[0], lambda: iter(list(waiting.held))
    p = lc.Lifecycles(10**9)
    p.init(SimpleNamespace(registerTimer=timers.append, getValueState=lambda *_: state, getListState=lambda *_: waiting))
    one = pd.DataFrame({"updated": pd.to_datetime([3000, 1000, 2000, 9000], unit="ms"), "seq": [1, 2, 3, 4], "status": ["completed", "validating", "in_progress", "deleted"]})
    rows = pd.concat([one.assign(type=f"t{k}") for k in range(500)])
    list(p.handleInputRows((0,), iter([rows]), None))
    assert timers == [1000] and calls == ["append"]
    at = lambda now: [x for pdf in p.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None) for x in pdf.itertuples(index=False, name=None)]
    moves = at(5000)
    assert len(moves) == 1500 and [x[1:] for x in moves if x[0] == "t7"] == [(1000, 2, "validating", "accepted"), (2000, 3, "in_progress", "accepted"), (3000, 1, "completed", "accepted")]
    assert timers == [1000, 9000] and calls == ["append", "put", "update"]
    assert at(5000) == [] and {x[1:] for x in at(9000)} == {(9000, 4, "deleted", "accepted")}
    assert set(timers) == {1000, 9000} and calls[3:] == ["clear", "update"]
