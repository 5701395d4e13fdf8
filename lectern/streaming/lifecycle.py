"""The states of external batches as a keyed stream: updates may come late, twice or in the wrong order; silence ends a batch.

Each batch type has its own state. Types are kept in buckets by a hash, which are the keys of the stream: calls and state are those
of a bucket, so their number does not grow with the types. Updates wait until the watermark has passed them and are applied in the order of
their times (then of their numbers), so results depend neither on the order of arrival nor on micro-batches, as long as no
update is later than the lateness allowed; later ones are dropped by the watermark, which the query's progress counts (a watermark starts at 1970, so times lie after that).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .batches import TERMINAL

#: States that an update may lead to. A batch that was deleted may be submitted anew.
NEXT = {
    "": ("validating",),
    "validating": ("in_progress", *TERMINAL),
    "in_progress": TERMINAL,
    "completed": ("processed", "deleted"),
    "failed": ("deleted",),
    "expired": ("deleted",),
    "cancelled": ("deleted",),
    "processed": ("deleted",),
    "deleted": ("validating",),
}
ACTIVE = ("validating", "in_progress")
TRANSITIONS = "type string, at long, seq long, status string, outcome string"
#: Buckets of types; checkpoints are bound to their number.
BUCKETS = 1024
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def applied(status: str, since: int, updates: list[tuple[int, int, str]], now: int, silence: int) -> tuple[str, int, list[tuple[int, int, str, str]]]:
    """Applies updates (time, number, status) up to ``now``: the new state, the time of its last sign of life, and what became
    of each update (accepted, repeated or rejected), with expiries between them. A repeated state is a sign of life, a rejected one is
    none; a batch expires when it is active and silent for longer than ``silence``."""
    out: list[tuple[int, int, str, str]] = []
    for at, seq, new in sorted(updates):
        if status in ACTIVE and since + silence < at:
            status, since = "expired", since + silence
            out.append((since, -1, status, "expired"))
        outcome = "repeated" if new == status else "accepted" if new in NEXT[status] else "rejected"
        if outcome != "rejected":
            status, since = new, at
        out.append((at, seq, new, outcome))
    if status in ACTIVE and since + silence <= now:
        status, since = "expired", since + silence
        out.append((since, -1, status, "expired"))
    return status, since, out


class Lifecycle(StatefulProcessor):
    """The last state of a type, and the updates that wait for the watermark: for a stream of few types, keyed by them."""

    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, since long")
        self.waiting = handle.getListState("waiting", "at long, seq long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t.value // 1_000_000), int(n), s) for pdf in rows for t, n, s in zip(pdf["updated"], pdf["seq"], pdf["status"], strict=True)]
        if new:
            self.waiting.appendList(new)
            # One timer for the first of them: when it expires, all that are due are applied, and the rest get the next timer.
            self.handle.registerTimer(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = [x for x in waiting if x[0] <= now]
        status, since = self.state.get() if self.state.exists() else ("", 0)
        status, since, out = applied(status, since, due, now, self.silence)
        if due:
            left = [x for x in waiting if x[0] > now]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(min(left)[0])
            else:
                self.waiting.clear()
        if out:
            self.state.update((status, since))
            if status in ACTIVE:
                self.handle.registerTimer(since + self.silence)
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["type", "at", "seq", "status", "outcome"])

    def close(self) -> None:
        pass


def _packed(**columns: list) -> tuple[bytes]:
    """Columns as one value of a state: a row of its own for each type or update would be a call of the store each."""
    table, out = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return (out.getvalue().to_pybytes(),)


def _unpacked(value: tuple) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in pa.ipc.open_stream(bytes(value[0])).read_all().columns), strict=True)


class Lifecycles(StatefulProcessor):
    """The last states of a bucket of types, and the updates that wait for the watermark; types do not touch one another."""

    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("states", "states binary")
        self.waiting = handle.getListState("updates", "updates binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in rows if len(pdf)]
        if parts:
            new = pd.concat(parts)
            at = new["updated"].astype("datetime64[ms]").astype("int64").tolist()
            self.waiting.appendValue(_packed(type=new["type"].tolist(), at=at, seq=new["seq"].tolist(), status=new["status"].tolist()))
            self.handle.registerTimer(min(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known = {t: (status, since) for t, status, since in _unpacked(self.state.get())} if self.state.exists() else {}
        due: dict[str, list[tuple[int, int, str]]] = {t: [] for t, (status, since) in known.items() if status in ACTIVE and since + self.silence <= now}
        left, came = [], False
        for t, *update in (x for value in self.waiting.get() for x in _unpacked(value)) if self.waiting.exists() else ():
            if update[0] > now:
                left.append((t, *update))
            else:
                came = True
                due.setdefault(t, []).append(tuple(update))
        if came and left:
            self.waiting.put([_packed(**dict(zip(("type", "at", "seq", "status"), map(list, zip(*left, strict=True)), strict=True)))])
        elif came:
            self.waiting.clear()
        moves = []
        for t, updates in due.items():
            status, since, out = applied(*known.get(t, ("", 0)), updates, now, self.silence)
            known[t] = status, since
            moves += [(t, *x) for x in out]
        if due:
            self.state.update(_packed(type=list(known), status=[x for x, _ in known.values()], since=[x for _, x in known.values()]))
        # One timer for whatever is next in the bucket.
        then = [x[1] for x in left] + [since + self.silence for status, since in known.values() if status in ACTIVE]
        if then:
            self.handle.registerTimer(min(then))
        if moves:
            yield pd.DataFrame(moves, columns=["type", "at", "seq", "status", "outcome"])

    def close(self) -> None:
        pass


def transitions(updates: DataFrame, silence_seconds: int, lateness: str) -> DataFrame:
    """A stream of updates (type, status, updated, seq) as a stream of transitions (type, at in milliseconds, seq, status,
    outcome). Rows without a time or status are left out; an unknown status is rejected. Timers need the RocksDB store, which the session gets if
    it has Spark's default."""
    spark = updates.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = updates.where(F.col("updated").isNotNull() & F.col("status").isNotNull()).select(F.coalesce("type", F.lit("")).alias("type"), "status", "updated", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("type"), F.lit(BUCKETS)).cast("int"))
    return rows.withWatermark("updated", lateness).groupBy("bucket").transformWithStateInPandas(Lifecycles(silence_seconds * 1000), TRANSITIONS, "append", "EventTime")


def run_transitions(updates: DataFrame, silence_seconds: int, lateness: str, target: str, checkpoint: str):
    """Transitions of what has come so far, appended to a table; the next run goes on from the checkpoint."""
    return transitions(updates, silence_seconds, lateness).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def last_states(moves: DataFrame) -> DataFrame:
    """(type, status, accepted, repeated, rejected, expired): the state that each type is in, and how many updates of each outcome."""
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    # An expiry comes before an update of its own time.
    last = F.max_by("status", F.when(F.col("outcome") != "rejected", F.struct("at", "seq"))).alias("status")
    return moves.groupBy("type").agg(last, count("accepted"), count("repeated"), count("rejected"), count("expired"))
