"""The states of batches as a stream against plain folds: late, repeated and disordered updates, silence, restarts."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from lectern.streaming import lifecycle as lc

SCHEMA = "type string, status string, updated timestamp, seq long"
START = datetime(2026, 1, 1, tzinfo=UTC)
SILENCE = 50


def fold(updates, silence=SILENCE):
    """The whole history of one type, update by update, in seconds; at the end everything has gone silent."""
    state, since, out = "", None, []
    for at, seq, new in sorted(updates):
        if state in ("validating", "in_progress") and at > since + silence:
            state, since = "expired", since + silence
            out.append((since, -1, "expired", "expired"))
        if new == state:
            out.append((at, seq, new, "repeated"))
        elif new in lc.NEXT[state]:
            out.append((at, seq, new, "accepted"))
        else:
            out.append((at, seq, new, "rejected"))
            continue
        state, since = new, at
    if state in ("validating", "in_progress"):
        out.append((since + silence, -1, "expired", "expired"))
    return sorted(out)


def run(spark, tmp_path, files):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    row = lambda t, at, seq, s: (t, s, START + timedelta(seconds=at), seq)
    for batch in files:
        spark.createDataFrame([row(*r) for r in batch], SCHEMA).coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(SCHEMA).json(src)
        lc.run_transitions(stream, SILENCE, "30 seconds", out, mark).awaitTermination()
    got = {}
    zero = int(START.timestamp() * 1000)
    for r in spark.read.schema(lc.TRANSITIONS).parquet(out).collect():
        got.setdefault(r["type"], []).append(((r["at"] - zero) // 1000, r["seq"], r["status"], r["outcome"]))
    return {k: sorted(v) for k, v in got.items()}


CLOCK = ("clock", 10**6, 0, "validating")


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    updates = {t: [(at, rng.randrange(100), rng.choice([*lc.NEXT, "odd"][1:])) for at in rng.sample(range(300), 25)] for t in "abc"}
    for t in updates:
        updates[t] = list({(a, s): (a, s, x) for a, s, x in updates[t]}.values())
        updates[t] += updates[t][::5]  # some come twice
    flat = sorted(((at, t, seq, s) for t, own in updates.items() for at, seq, s in own), key=lambda r: r[0] + rng.randrange(28))  # late by less than is allowed
    rows = [(t, at, seq, s) for at, t, seq, s in flat]
    third = len(rows) // 3
    got = run(spark, tmp_path, [rows[:third], rows[third : 2 * third], rows[2 * third :], [CLOCK]])
    assert got == {t: fold(own) for t, own in updates.items()}


def test_each_transition():
    """Every pair of states by the table."""
    for old, follow in lc.NEXT.items():
        for new in [*lc.NEXT, "odd"][1:]:
            state, since, out = lc.applied(old, 0, [(10, 1, new)], 10, 100)
            good = new in follow or new == old
            assert out == [(10, 1, new, "repeated" if new == old else "accepted" if new in follow else "rejected")]
            assert (state, since) == ((new, 10) if good else (old, 0))


def test_silence():
    """Expiry after silence alone, not at its very end; a repeated state is a sign of life, a rejected one none."""
    a = lambda *u, now: lc.applied("", 0, list(u), now, 50)[2]
    assert a((0, 1, "validating"), (50, 2, "in_progress"), now=99)[-1] == (50, 2, "in_progress", "accepted")
    assert a((0, 1, "validating"), (51, 2, "in_progress"), now=99)[1:] == [(50, -1, "expired", "expired"), (51, 2, "in_progress", "rejected")]
    assert a((0, 1, "validating"), (40, 2, "validating"), now=89)[-1][3] == "repeated"
    assert a((0, 1, "validating"), (40, 2, "processed"), now=89)[-1] == (50, -1, "expired", "expired")
    assert a((0, 1, "validating"), (10, 2, "completed"), now=500)[-1][2] == "completed"


def test_restart_and_new_batch(spark, tmp_path):
    """State and timers outlive a run; a deleted batch may start anew; rows without time or status say nothing."""
    life = [(0, 1, "validating"), (5, 2, "in_progress"), (9, 3, "completed"), (12, 4, "processed"), (13, 5, "deleted"), (20, 6, "validating")]
    rows = [("t", *u) for u in life]
    got = run(spark, tmp_path, [rows[:2], rows[2:5], rows[5:], [CLOCK]])
    assert got == {"t": fold(life)}
    moves = spark.read.schema(lc.TRANSITIONS).parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in lc.last_states(moves).collect()] == [("t", "expired", 6, 0, 0, 1)]


def test_one_timer_for_many_updates():
    """However many updates of a type come at once, one timer waits for the first; the next is set for those that are not due yet."""
    from types import SimpleNamespace

    import pandas as pd

    timers, held = [], []
    value = SimpleNamespace(exists=lambda: False, get=lambda: None, update=lambda x: None)
    store = SimpleNamespace(exists=lambda: bool(held), get=lambda: iter(list(held)), appendList=held.extend, put=lambda x: (held.clear(), held.extend(x)), clear=held.clear)
    p = lc.Lifecycle(10**9)
    p.init(SimpleNamespace(registerTimer=timers.append, getValueState=lambda *_: value, getListState=lambda *_: store))
    rows = pd.DataFrame({"updated": pd.to_datetime([3000, 1000, 2000, 9000], unit="ms"), "seq": [1, 2, 3, 4], "status": ["completed", "validating", "in_progress", "deleted"]})
    list(p.handleInputRows(("t",), iter([rows]), None))
    assert timers == [1000]
    out = pd.concat(p.handleExpiredTimer(("t",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 5000), None))
    assert out["at"].tolist() == [1000, 2000, 3000] and timers == [1000, 9000] and held == [(9000, 4, "deleted")]
